"""Alignment of two tokenizers, with counts of the id pairs that meet in the corpus.

A text is cut before every blank between two other characters; both tokenizers end a token there, so each distinct piece is tokenized and
aligned once per worker. The links of a batch of texts (a *run*) become records (pair, document, times), which are dealt by radix of the
B id and written as zstd rows of a table in the shared folder, sorted by B id, A id and document. Runs of a radix are then merged
by a heap, a bounded number at a time, in as many rounds as needed: equal pairs are added up, and as the order is by B id, the highest
count of each B id is known when its pairs have passed. The counts of a radix meet its runs again, and each run streams what its
documents gain back to the run's document list.

A pair that a third of all links hold is one entry per run before the merge, and its documents stay spread over the runs.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
import types
import zlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import stored

#: Texts are aligned together up to so many bytes, or one longer text; pieces known to a worker, before it forgets them all.
RUN_BYTES, KNOWN_PIECES = 1 << 22, 300_000
#: New pieces worked on together.
LEARN_PIECES = 16_384
#: Parts by B id, runs merged at a time, and runs that meet one copy of a radix's counts.
RADIXES, FAN_IN, RUNS_PER_COPY = 64, 256, 64
#: Pieces tokenized in a row.
IN_A_ROW = 256
_A_BITS, _DOC_BITS = 17, 24
_LONE_BLANK = re.compile(r"(?<=\S) (?=\S)")
_ODD_BLANK = re.compile(r"\A\s| (?=\s)|\s (?=\S)|\s\Z")
_DOCS = "array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string>>"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of equal length as one zstd frame."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.ascontiguousarray(c, dtype=np.int64).tobytes() for c in columns]))


def _unpacked(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int64).reshape(columns, -1)


class PieceAligner:
    """Tokens, groups and links of text pieces, each worked on once until too many are known.

    ``a`` is the JSON of a byte-level tokenizer, ``b`` a sentence-piece model that puts a blank before the text. ``pieces`` numbers the
    known pieces; a piece stands for a blank and its characters.
    """

    def __init__(self, a: str, b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a), sentencepiece.SentencePieceProcessor(model_proto=b)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        self.a_bytes = [bytes(letters.get(c, 63) for c in self.a.id_to_token(i)) for i in range(self.a.get_vocab_size())]
        spelled = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(spelled)]
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.forget()

    def forget(self) -> None:
        self.pieces, self.fresh, self.groups = {}, [], []
        self.fits, self.counts = np.zeros(0, bool), np.zeros((0, 4), np.int64)
        self.links, self.link_ends = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def split(self, text: str) -> list[int]:
        """Numbers of the pieces of a text; new pieces are noted and must be ``learn``\\ ed before their facts are used."""
        parts = _LONE_BLANK.split(text) if _ODD_BLANK.search(text) else text.split(" ")
        known, fresh = self.pieces, self.fresh
        out = []
        for part in parts:
            number = known.get(part)
            if number is None:
                number = known[part] = len(known)
                fresh.append(part)
            out.append(number)
        return out

    def _tokens(self, parts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides for some texts."""
        a = [np.array(e.ids, np.int64) for e in self.a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]
        return a, [np.array(x, np.int64) for x in self.b.encode(parts, num_threads=1)]

    def _whole(self, a: np.ndarray, b: np.ndarray, raw: bytes) -> bool:
        """Whether the tokens of both sides spell the bytes."""
        return self.a_size[a].sum() == len(raw) == self.b_size[b].sum() and b"".join([self.a_bytes[i] for i in a.tolist()]) == raw == b"".join([self.b_bytes[i] for i in b.tolist()])

    def learn(self) -> None:
        """Tokenizes and aligns the noted pieces, a bounded number at a time."""
        fresh, self.fresh = self.fresh, []
        for first in range(0, len(fresh), LEARN_PIECES):
            self._learn(fresh[first : first + LEARN_PIECES])
        self.link_ends = np.cumsum(self.counts[:, 3])

    def _learn(self, fresh: list[str]) -> None:
        # Only pieces without blanks at their ends keep their tokens apart when they stand in a row.
        apart = [bool(p) and not p[0].isspace() and not p[-1].isspace() for p in fresh]
        rows = [i for i, x in enumerate(apart) if x]
        blocks = [rows[i : i + IN_A_ROW] for i in range(0, len(rows), IN_A_ROW)]
        a_of, b_of = [None] * len(fresh), [None] * len(fresh)
        alone = [i for i, x in enumerate(apart) if not x]
        for block, a, b in zip(blocks, *self._tokens([" ".join([fresh[i] for i in block]) for block in blocks])):
            raw = [b" " + fresh[i].encode("utf-8", "surrogatepass") for i in block]
            ends = np.cumsum([len(x) for x in raw])
            a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
            a_cut, b_cut = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
            if not self._whole(a, b, b"".join(raw)) or (a_ends[a_cut] != ends).any() or (b_ends[b_cut] != ends).any():
                alone += block
                continue
            for i, x, y in zip(block, np.split(a, a_cut[:-1] + 1), np.split(b, b_cut[:-1] + 1)):
                a_of[i], b_of[i] = x, y
        fits = np.ones(len(fresh), bool)
        for i, a, b in zip(alone, *self._tokens([fresh[i] for i in alone])):
            fits[i] = self._whole(a, b, b" " + fresh[i].encode("utf-8", "surrogatepass"))
            a_of[i], b_of[i] = (a, b) if fits[i] else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self._align(a_of, b_of, fits)

    def _align(self, a_of: list[np.ndarray], b_of: list[np.ndarray], fits: np.ndarray) -> None:
        """Groups and links of new pieces, all at once: their bytes stand one after the other, and every piece ends both a and b tokens."""
        a, b = np.concatenate(a_of), np.concatenate(b_of)
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        a_starts, b_starts = a_ends - self.a_size[a], b_ends - self.b_size[b]
        a_of_piece, b_of_piece = (np.repeat(np.arange(len(fits)), [len(x) for x in side]) for side in (a_of, b_of))
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_group, b_group = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
        first, behind = np.searchsorted(b_ends, a_starts, side="right"), np.searchsorted(b_starts, a_ends)
        met = behind - first
        a_at = np.repeat(np.arange(len(a)), met)
        b_at = np.arange(len(a_at)) - np.repeat(np.cumsum(met) - met, met) + first[a_at]
        piece_of_cut = a_of_piece[np.searchsorted(a_ends, cuts)]
        sizes = [np.bincount(x, minlength=len(fits)) for x in (a_of_piece, b_of_piece, piece_of_cut, a_of_piece[a_at])]
        self.counts = np.concatenate([self.counts, np.stack(sizes, axis=1)])
        self.fits = np.concatenate([self.fits, fits])
        self.links = np.concatenate([self.links, (b[b_at] << _A_BITS) | a[a_at]])
        sides = []
        for ids, group in ((a, a_group), (b, b_group)):
            spelled, bounds = [str(i) for i in ids.tolist()], np.searchsorted(group, np.arange(len(cuts) + 1)).tolist()
            sides.append([",".join(spelled[x:y]) for x, y in zip(bounds, bounds[1:])])
        shown = [x + "|" + y for x, y in zip(*sides)]
        bounds = np.concatenate([[0], np.cumsum(sizes[2])]).tolist()
        self.groups += [";".join(shown[x:y]) for x, y in zip(bounds, bounds[1:])]


def _shared_aligner(a: str, b: bytes) -> PieceAligner:
    """The worker process keeps its aligner from task to task."""
    shelf = sys.modules.setdefault("_larkspur_worker", types.ModuleType("_larkspur_worker"))
    key = (zlib.crc32(a.encode()), zlib.crc32(b))
    if key not in shelf.__dict__.setdefault("aligners", {}):
        shelf.aligners[key] = PieceAligner(a, b)
    return shelf.aligners[key]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Ids and texts of bounded parts of the batches."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
        marks = np.arange(1, int(size[-1]) // RUN_BYTES + 1) * RUN_BYTES if len(size) else []
        cuts = np.unique([0, *(np.searchsorted(size, marks) + 1), batch.num_rows]).tolist()
        for a, b in zip(cuts, cuts[1:]):
            yield batch.column("doc_id").slice(a, b - a).to_pylist(), batch.column("text").slice(a, b - a).to_pylist()


def _pieces_of(aligner: PieceAligner, texts: list[str | None]) -> list[np.ndarray]:
    """Piece numbers of each text; none for a null or empty one and for one whose tokens do not spell it."""
    if len(aligner.pieces) > KNOWN_PIECES:
        aligner.forget()
    split = [np.array(aligner.split(t) if t else [], np.int64) for t in texts]
    aligner.learn()
    return [x if aligner.fits[x].all() else x[:0] for x in split]


def _records(aligner: PieceAligner, pieces: list[np.ndarray]) -> list[tuple[int, bytes, bytes]]:
    """Per radix of the B id: the pairs with their totals and numbers of documents, and their documents with the times of each."""
    flat, owner = np.concatenate(pieces), np.repeat(np.arange(len(pieces)), [len(x) for x in pieces])
    held, times = np.unique(owner * len(aligner.fits) + flat, return_counts=True)
    owner, flat = np.divmod(held, max(len(aligner.fits), 1))
    n = aligner.counts[flat, 3]
    at = np.repeat(aligner.link_ends[flat] - n, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    keys = (aligner.links[at] << _DOC_BITS) | np.repeat(owner, n)
    order = np.argsort(keys)
    keys, times = keys[order], np.repeat(times, n)[order]
    begins = np.flatnonzero(np.diff(keys, prepend=-1))
    keys, times = keys[begins], np.add.reduceat(times, begins) if len(begins) else times
    radix = (keys >> (_DOC_BITS + _A_BITS)) % RADIXES
    order = np.argsort(radix.astype(np.uint8), kind="stable")
    bounds, keys, times, out = np.searchsorted(radix[order], np.arange(RADIXES + 1)), keys[order], times[order], []
    for r in range(RADIXES):
        part, n = keys[bounds[r] : bounds[r + 1]], times[bounds[r] : bounds[r + 1]]
        if len(part):
            pairs = part >> _DOC_BITS
            first = np.flatnonzero(np.diff(pairs, prepend=-1))
            out.append((r, _packed(pairs[first], np.add.reduceat(n, first), np.diff(first, append=len(pairs))), _packed(part & ((1 << _DOC_BITS) - 1), n)))
    return out


def spill_runs(docs: DataFrame, a: str, b: str) -> DataFrame:
    """``run, radix, docs, pairs, records``: the runs of ``docs`` as a table in the shared folder.

    Radix -1 holds the run's documents; the others hold its pairs, sorted by B id and A id, and the documents of each. ``a`` and
    ``b`` are paths of the tokenizers that the driver can read; they travel with the job.
    """
    spark = docs.sparkSession
    models = spark.sparkContext.broadcast((Path(a).read_text(encoding="utf-8"), Path(b).read_bytes()))

    def spilled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, task = _shared_aligner(*models.value), TaskContext.get().partitionId()
        for turn, (ids, texts) in enumerate(_runs(batches)):
            pieces = _pieces_of(aligner, texts)
            facts = np.array([aligner.counts[x].sum(axis=0) for x in pieces], np.int64).reshape(-1, 4)
            digests = [hashlib.sha256(";".join([aligner.groups[i] for i in x.tolist()]).encode()).hexdigest() if len(x) else "" for x in pieces]
            rows = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c) for c in facts.T], pa.array(digests, pa.string())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
            listed = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            run, records = f"{task}-{turn}", _records(aligner, pieces)
            yield pa.RecordBatch.from_arrays([pa.array([run]), pa.array([-1], pa.int32()), listed, pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())], ["run", "radix", "docs", "pairs", "records"])
            if records:
                radix, pairs, own = zip(*records)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([run] * len(radix)), pa.array(radix, pa.int32()), pa.nulls(len(radix), listed.type), pa.array(pairs, pa.binary()), pa.array(own, pa.binary())], ["run", "radix", "docs", "pairs", "records"]
                )

    return stored(_rows(docs).mapInArrow(spilled, f"run string, radix int, docs {_DOCS}, pairs binary, records binary"), "alignment-runs")


def heap_merged(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in order and their totals over sorted runs of (pair, total, ...)."""
    def entries(data: bytes) -> Iterator[tuple[int, int]]:
        columns = _unpacked(data, 3)
        return zip(columns[0].tolist(), columns[1].tolist())

    pairs, totals = [], []
    for pair, same in groupby(heapq.merge(*map(entries, payloads)), key=itemgetter(0)):
        pairs.append(pair)
        totals.append(sum(map(itemgetter(1), same)))
    return np.array(pairs, np.int64), np.array(totals, np.int64)


def _highest(pairs: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 for the pairs with the highest count of their B id, whose pairs stand together."""
    side = pairs >> _A_BITS
    first = np.flatnonzero(np.diff(side, prepend=-1))
    return (totals == np.repeat(np.maximum.reduceat(totals, first), np.diff(first, append=len(side)))).astype(np.int64)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per (radix, slot) of rows that come sorted by them; at most a group's payloads are held."""

    def closed(key: tuple[int, int], payloads: list[bytes]) -> pa.RecordBatch:
        pairs, totals = heap_merged(payloads)
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([str(key[1])]), pa.array([_packed(pairs, totals, _highest(pairs, totals))], pa.binary())], ["radix", "run", "pairs"])

    held, payloads = None, []
    for batch in batches:
        for radix, slot, data in zip(batch.column("radix").to_pylist(), batch.column("slot").to_pylist(), batch.column("pairs")):
            if held not in (None, (radix, slot)):
                yield closed(held, payloads)
                payloads = []
            held = (radix, slot)
            payloads.append(data.as_py())
    if payloads:
        yield closed(held, payloads)


def merged_counts(runs: DataFrame, n_runs: int, fan_in: int = FAN_IN) -> DataFrame:
    """``radix, run, pairs``: one row per radix with (pair, count, whether it is the highest of its B id), sorted by pair."""
    level = runs.filter("radix >= 0").select("radix", "run", "pairs")
    while True:
        slots = -(-n_runs // fan_in)
        slotted = level.withColumn("slot", F.pmod(F.xxhash64("run"), F.lit(max(slots, 1))).cast("long"))
        level = stored(slotted.repartition("radix", "slot").sortWithinPartitions("radix", "slot").select("radix", "slot", "pairs").mapInArrow(_merge, "radix int, run string, pairs binary"), "alignment-counts")
        if slots <= 1:
            return level
        n_runs = slots


def _gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the documents of each run gain from one radix. The radix's counts come before its runs."""
    key, counts = None, None
    for batch in batches:
        out = []
        for radix, slot, run, pairs, records in zip(*[batch.column(c) for c in ("radix", "slot", "run", "pairs", "records")]):
            columns = _unpacked(pairs.as_py(), 3)
            if not records.is_valid:
                key, counts = (radix, slot), columns
                continue
            if key != (radix, slot):
                raise ValueError("the counts of a radix are missing")
            doc, times = _unpacked(records.as_py(), 2)
            at = np.repeat(np.searchsorted(counts[0], columns[0]), columns[2])
            best, total = np.zeros(int(doc.max()) + 1, np.int64), np.zeros(int(doc.max()) + 1, np.int64)
            np.add.at(best, doc, times * counts[2][at])
            np.add.at(total, doc, times * counts[1][at])
            named = np.unique(doc)
            out.append((run.as_py(), _packed(named, best[named], total[named])))
        if out:
            run, gains = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(run), pa.array(gains, pa.binary())], ["run", "gains"])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each run with the sums of their gains; a run's document list comes before its gains."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]

    def closed(docs: pa.StructArray, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*docs.flatten(), pa.array(sums[0]), pa.array(sums[1])], names)

    docs, sums = None, None
    for batch in batches:
        for listed, gains in zip(batch.column("docs"), batch.column("gains")):
            if listed.is_valid:
                if docs is not None:
                    yield closed(docs, sums)
                docs, sums = listed.values, np.zeros((2, len(listed.values)), np.int64)
            else:
                at, best, total = _unpacked(gains.as_py(), 3)
                sums[0][at] += best
                sums[1][at] += total
    if docs is not None:
        yield closed(docs, sums)


def alignment(docs: DataFrame, a: str, b: str, fan_in: int = FAN_IN) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum`` for every row of ``docs`` (``doc_id``, ``text``).

    ``a`` (a byte-level tokenizer's JSON) reads the text behind a blank, ``b`` (a sentence-piece model) puts that blank there itself; the
    strings of special tokens are plain text. Two tokens are linked where their byte ranges overlap; places where
    tokens of both sides end cut them into groups. A pair of ids counts all links of the corpus that hold it. ``n_best`` are the links
    whose count is the highest of their B id (ties included), ``count_sum`` adds up the counts of the links.
    Null and empty texts, and texts that the tokens of one side do not spell byte by byte, have no tokens: zeros, and an empty
    ``groups_sha256``. Every row counts by itself, also repeated ones and those with null ids. An empty table gives an empty table.
    Texts of any length are read whole; other columns are not read.
    """
    runs = spill_runs(docs, a, b)
    n_runs = runs.filter("radix < 0").count()
    copies = max(1, -(-n_runs // RUNS_PER_COPY))
    counts = merged_counts(runs, n_runs, fan_in)
    spread = counts.select("radix", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))).alias("slot"), F.lit(None).cast("string").alias("run"), "pairs", F.lit(None).cast("binary").alias("records"))
    own = runs.filter("radix >= 0").select("radix", F.pmod(F.xxhash64("run"), F.lit(copies)).cast("long").alias("slot"), "run", "pairs", "records")
    met = spread.unionByName(own).repartition("radix", "slot").sortWithinPartitions("radix", "slot", F.col("run").asc_nulls_first())
    gains = met.mapInArrow(_gains, "run string, gains binary").select("run", F.lit(None).cast(_DOCS).alias("docs"), "gains")
    lists = runs.filter("radix < 0").select("run", "docs", F.lit(None).cast("binary").alias("gains"))
    back = lists.unionByName(gains).repartition("run").sortWithinPartitions("run", F.col("gains").isNotNull()).select("docs", "gains")
    return back.mapInArrow(_documents, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")


def pair_counts(docs: DataFrame, a: str, b: str, fan_in: int = FAN_IN) -> DataFrame:
    """``a_id, b_id, n, is_best`` of every pair of ids that is linked somewhere in ``docs``."""
    runs = spill_runs(docs, a, b)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("pairs"):
                pair, n, best = _unpacked(data.as_py(), 3)
                yield pa.RecordBatch.from_arrays([pa.array(pair & ((1 << _A_BITS) - 1)), pa.array(pair >> _A_BITS), pa.array(n), pa.array(best == 1)], ["a_id", "b_id", "n", "is_best"])

    return merged_counts(runs, runs.filter("radix < 0").count(), fan_in).select("pairs").mapInArrow(listed, "a_id long, b_id long, n long, is_best boolean")


def aligned_groups(docs: DataFrame, a: str, b: str) -> DataFrame:
    """``doc_id, groups``: the groups of each text as ``a1,a2|b1;a3|b2,b3``; an empty text where ``alignment`` has no tokens."""
    models = docs.sparkSession.sparkContext.broadcast((Path(a).read_text(encoding="utf-8"), Path(b).read_bytes()))

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _shared_aligner(*models.value)
        for ids, texts in _runs(batches):
            groups = [";".join([aligner.groups[i] for i in x.tolist()]) for x in _pieces_of(aligner, texts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(groups, pa.string())], ["doc_id", "groups"])

    return _rows(docs).mapInArrow(shown, "doc_id long, groups string")
