"""Periodic runs of words, found by recursive frequency splitting and a lag scan.

A run of period q and at least four periods holds each of its words at least four times. So a word that is rarer than that in its
segment lies in no run and splits the segment; the parts are counted again until nothing changes. Prose falls apart within a few
rounds. What survives is scanned lag by lag: short lags by comparing all neighbours at that distance, for all segments at once, and
longer lags at every q-th word only, since a run covers four such words in a row. A document is worked on in one task, and no row
depends on another one, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import WORD_BREAK

#: A run has so many words and so many periods at least.
LEAST_LENGTH, LEAST_PERIODS = 6, 4
#: Lags up to this one compare all words at that distance.
DENSE = 16
#: Texts are worked on together up to so many bytes, or one longer text.
BATCH_BYTES = 1 << 22
RUNS = "array<struct<start:long,length:long,period:long>>"
_NONE = np.zeros((0, 3), np.int64)


def surviving_segments(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(place, segment)`` of the words that can lie in a run: places in ``words``, in order, and the number of the segment of each.

    ``owner`` names the document of each word. Segments are runs of neighbouring places of one document in which every word occurs
    ``LEAST_PERIODS`` times or more.
    """
    place, segment, done_place, done_segment, made = np.arange(len(words)), owner, [], [], 0
    n_words = int(words.max(initial=0)) + 1
    while len(place):
        _, at, times = np.unique(segment * n_words + words[place], return_inverse=True, return_counts=True)
        keeps = times[at] >= LEAST_PERIODS
        starts = np.flatnonzero(np.diff(segment, prepend=-1))
        whole = np.logical_and.reduceat(keeps, starts)
        stable = np.repeat(whole, np.diff(starts, append=len(place)))
        numbers = np.cumsum(np.diff(segment, prepend=-1) != 0)
        done_place.append(place[stable])
        done_segment.append(numbers[stable] + made)
        made += len(starts)
        rest = keeps & ~stable
        place, before = place[rest], segment[rest]
        segment = np.cumsum((np.diff(place, prepend=-2) != 1) | (np.diff(before, prepend=-1) != 0)) - 1
        long_enough = np.bincount(segment, minlength=1)[segment] >= LEAST_LENGTH if len(place) else np.zeros(0, bool)
        place, segment = place[long_enough], segment[long_enough]
    place, segment = np.concatenate([np.zeros(0, np.int64), *done_place]), np.concatenate([np.zeros(0, np.int64), *done_segment])
    order = np.argsort(place)
    place, segment = place[order], segment[order]
    fits = np.unique(segment, return_inverse=True, return_counts=True) if len(segment) else None
    long_enough = fits[2][fits[1]] >= LEAST_LENGTH if fits else np.zeros(0, bool)
    return place[long_enough], segment[long_enough]


def _stretches(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of each maximal stretch of true values that is long enough."""
    edge = np.diff(np.concatenate([[0], same.view(np.int8), [0]]))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    fits = ends - begins >= least
    return begins[fits], (ends - begins)[fits]


def short_lags(words: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Rows of (start, length, period), for lags up to ``DENSE``, over all segments at once; starts are indices of ``words``."""
    label = segment * (int(words.max(initial=0)) + 1) + words
    index, sizes = np.arange(len(label)), np.unique(segment, return_inverse=True, return_counts=True)
    room, found = sizes[2][sizes[1]] if len(label) else np.zeros(0, int), []
    for lag in range(1, DENSE + 1):
        fits = room[index] >= LEAST_PERIODS * lag
        index = index[fits]
        if len(index) <= lag:
            break
        part = label[index]
        begins, lengths = _stretches(part[:-lag] == part[lag:], max(LEAST_LENGTH - lag, (LEAST_PERIODS - 1) * lag))
        found.append(np.stack([index[begins], lengths + lag, np.full(len(begins), lag)], axis=1))
    return np.concatenate([_NONE, *found])


def _agrees(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The widest range around ``at`` in which every word equals the one ``lag`` further on, by pieces of growing size."""
    end, step, limit = at, 256, len(words) - lag
    while end < limit:
        differs = np.flatnonzero(words[end : min(end + step, limit)] != words[end + lag : min(end + step, limit) + lag])
        if len(differs):
            end += int(differs[0])
            break
        end, step = min(end + step, limit), 2 * step
    start, step = at, 256
    while start > 0:
        low = max(0, start - step)
        differs = np.flatnonzero(words[low:start] != words[low + lag : start + lag])
        if len(differs):
            start = low + int(differs[-1]) + 1
            break
        start, step = low, 2 * step
    return start, end


def long_lags(words: np.ndarray, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one segment with a period over ``DENSE``. ``known`` are its runs of shorter periods.

    A run covers four checkpoints (multiples of the lag) in a row, with equal words, and so do the places at any shift from the first three
    of them. Checkpoints inside a known run whose period divides the lag would find that run again.
    """
    found, known = [], [r for r in known if r[1] >= LEAST_PERIODS * DENSE]
    for lag in range(DENSE + 1, len(words) // LEAST_PERIODS + 1):
        marks = words[::lag]
        same = marks[:-1] == marks[1:]
        at = np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) * lag
        if not len(at):
            continue
        known = [r for r in known if r[1] >= LEAST_PERIODS * lag]
        for start, length, period in known:
            if lag % period == 0:
                at = at[(at < start) | (at + 2 * lag > start + length)]
        if not len(at):
            continue
        for shift in (1, lag // 7, lag // 3, lag // 2, 2 * lag // 3, lag - 1):
            first = words[at + shift]
            at = at[(first == words[at + shift + lag]) & (first == words[at + shift + 2 * lag])]
        passed = -1
        for place in at.tolist():
            if place < passed:
                continue
            start, passed = _agrees(words, place, lag)
            if passed - start >= (LEAST_PERIODS - 1) * lag:
                run = (start, passed - start + lag, lag)
                found.append(run)
                known.append(run)
    return found


def runs_of(words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Rows of (start, length, period) of all runs, ordered by start and period; starts are indices of ``words``.

    Of equal ranges the smallest period counts: a range of four periods whose words also repeat at a shorter distance has that
    shorter one as a divisor, and both give the same range.
    """
    place, segment = surviving_segments(words, owner)
    if not len(place):
        return _NONE
    held, found = words[place], short_lags(words[place], segment)
    _, begins, sizes = np.unique(segment, return_index=True, return_counts=True)
    longer = []
    for begin, size in zip(begins.tolist(), sizes.tolist()):
        if size >= LEAST_PERIODS * (DENSE + 1):
            inside = found[(found[:, 0] >= begin) & (found[:, 0] < begin + size)] - np.array([begin, 0, 0])
            longer += [(begin + s, n, p) for s, n, p in long_lags(held[begin : begin + size], [tuple(r) for r in inside.tolist()])]
    found = np.concatenate([found, np.array(longer, np.int64).reshape(-1, 3)])
    found[:, 0] = place[found[:, 0]]
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    found = found[np.concatenate([[True], np.any(np.diff(found[:, :2], axis=0) != 0, axis=1)])[: len(found)]]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _once(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that lie in no run, or in the first period of each run that holds them."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def _batch(texts: list[str | None]) -> tuple[list[int], np.ndarray, list[bytes]]:
    """How many words each text has, how many runs, the runs themselves and the collapsed texts."""
    split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    sizes, numbers = np.array([len(w) for w in split], np.int64), {}
    words = np.array([numbers.setdefault(w, len(numbers)) for each in split for w in each], np.int64)
    firsts = np.cumsum(sizes) - sizes
    runs = runs_of(words, np.repeat(np.arange(len(split)), sizes))
    owner = np.searchsorted(firsts + sizes, runs[:, 0], side="right")
    runs[:, 0] -= firsts[owner]
    cuts = np.searchsorted(owner, np.arange(len(split) + 1))
    return cuts, runs, [_once(w, runs[a:b]) for w, a, b in zip(split, cuts.tolist(), cuts[1:].tolist())]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, runs, text`` for every row of ``docs`` (``doc_id``, ``text``).

    Words are maximal pieces without ASCII blanks, numbered from 0. A run (``start``, ``length``, ``period``) is a stretch of words with
    smallest period q, at least ``LEAST_LENGTH`` words and ``LEAST_PERIODS`` periods long, that no neighbouring word extends. ``runs`` are
    ordered by start, then period. ``text`` holds the words without those that any run contains after its first period, joined by
    one blank. Null, empty and blank texts have no words, no runs and an empty text. Runs may overlap; equal ranges count once. Rows are
    independent: repeated rows come back repeated, null ids stay null, an empty table gives an empty table, other columns are not read.
    Texts of any length are worked on whole.
    """

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
            marks = np.arange(1, int(size[-1]) // BATCH_BYTES + 1) * BATCH_BYTES if len(size) else []
            cuts = np.unique([0, *(np.searchsorted(size, marks) + 1), batch.num_rows]).tolist()
            for a, b in zip(cuts, cuts[1:]):
                ends, runs, texts = _batch(batch.column("text").slice(a, b - a).to_pylist())
                rows = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in range(3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows), pa.array([t.decode("utf-8", "surrogatepass") for t in texts], pa.string())],
                    ["doc_id", "runs", "text"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scanned, f"doc_id long, runs {RUNS}, text string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length by period, compared exactly; of equal ones the first by start, then period. Null without runs."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def with_repeated_tail(docs: DataFrame) -> DataFrame:
    """``doc_id, text``; about one text in ten, by its id's hash, repeats some of its words up to its end.

    With h = crc32 of the id and g = h / 10: where h % 10 = 0, word i >= a becomes word a + (i - a) % p, with a = g % n and
    p = 1 + (n - a) / (3 + g % 8), of n words. Texts without words and rows with a null id stay as they are.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    words = F.filter(F.split("text", WORD_BREAK), lambda w: w != "")
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("g", F.floor(F.col("h") / 10)).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    head = F.slice("words", F.lit(1), F.col("a"))
    tail = F.transform(F.sequence(F.lit(0), F.col("n") - F.col("a") - 1), lambda i: F.get(F.col("words"), F.col("a") + i % F.col("p")))
    return rows.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(F.array_join(F.concat(head, tail), " ")).alias("text"))
