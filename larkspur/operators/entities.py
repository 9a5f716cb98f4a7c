"""Sections, dictionary mentions of entities, and their counts."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import text as fx
from larkspur.session import written

#: Words of the longest terms, terms of a block when pairs are counted, tasks that a pair of blocks is dealt to, pairs worked out at once.
MOST_WORDS, PAIR_BLOCK, PAIR_DEALS, PAIR_STEP = 5, 1024, 8, 1 << 20
#: Bits of the map of words that begin a term; words that share one are told apart by the join.
_MAP_BITS = 1 << 20
#: Bits of a term's number inside its block: for more terms than any block has.
_BITS = 20
#: Count columns by kind of document.
KINDS = {"publications": "article", "trials": "trial"}
#: What is summed per pair of terms: documents of each kind, and of any or none.
_COUNTED = (*KINDS, "documents")


def part_offsets(text: Column | str, separator: str) -> Column:
    """Character offset of each part of a text split at single characters; ``separator`` is an RE2 pattern."""
    literal = len(separator) == 1

    def offsets(column: pa.Array) -> pa.Array:
        texts = pc.fill_null(column.cast(pa.string()), "")
        parts = pc.split_pattern(texts, separator) if literal else pc.split_pattern_regex(texts, separator)
        bounds = parts.offsets.to_numpy()
        lengths = pc.utf8_length(parts.flatten()).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        before = np.concatenate([[0], np.cumsum(lengths)])
        bounds = bounds - bounds[0]
        values = before[:-1] - np.repeat(before[bounds[:-1]], np.diff(bounds))
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.astype(np.int32)))

    offsets.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf("array<int>")(offsets)(text)


def split_parts(parts: Column, starts: Column) -> Column:
    """Generator of ``position, part, start`` structs from the parts of a text and their offsets."""
    return F.posexplode(F.arrays_zip(parts.alias("part"), starts.alias("start")))


def sections(documents: DataFrame, text: str = "text") -> DataFrame:
    """One row per non-blank line: ``section_no, section_text, section_start``; no shuffle."""
    others = [c for c in documents.columns if c != text]
    lines = split_parts(F.split(text, "\n"), part_offsets(text, "\n")).alias("section_no", "_line")
    exploded = documents.select(*others, lines)
    return exploded.select(
        *others, "section_no", F.col("_line.part").alias("section_text"), F.col("_line.start").alias("section_start")
    ).filter(~fx.is_blank("section_text"))


def trial_outcomes(trials: DataFrame) -> DataFrame:
    """One row per primary outcome of a trial."""
    return trials.select("nct_id", F.posexplode("primary_outcomes").alias("outcome_no", "outcome"))


def term_prefixes(terms: DataFrame) -> DataFrame:
    """The nodes of the word trie of a dictionary (``term``, words joined by one blank): ``prefix, n, is_term`` with ``n`` words."""
    words = terms.select("term").filter(F.col("term") != "").distinct().withColumn("_words", F.split("term", " "))
    nodes = words.select("term", F.explode(F.sequence(F.lit(1), F.size("_words"))).alias("n"), "_words")
    prefix = F.array_join(F.slice("_words", F.lit(1), F.col("n")), " ")
    return nodes.select(prefix.alias("prefix"), "n", (prefix == F.col("term")).alias("is_term")).groupBy("prefix", "n").agg(F.bool_or("is_term").alias("is_term"))


_WORDS = "array<struct<at:int,word:string,following:array<string>,word_no:int,start:int>>"


@dataclass(frozen=True)
class FirstWords:
    """Bit maps, by crc32, of the words that begin a term and of those that begin one of several words. Their size is fixed."""

    begin: bytes
    longer: bytes

    def marks(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which words may begin a term, and which may begin a longer one; none that does is missed."""
        coded = pc.dictionary_encode(words)
        spelt = coded.dictionary.cast(pa.binary()).to_pylist()
        hashed = np.fromiter((zlib.crc32(w) for w in spelt), np.int64, len(spelt)) & (_MAP_BITS - 1)
        at = coded.indices.to_numpy()
        return tuple(np.unpackbits(np.frombuffer(m, np.uint8), bitorder="little").astype(bool)[hashed][at] for m in (self.begin, self.longer))


def first_words(prefixes: DataFrame) -> FirstWords:
    """The maps of a word trie; at most a row per byte of them reaches the driver."""
    place = F.crc32(F.substring_index("prefix", " ", 1)).bitwiseAND(F.lit(_MAP_BITS - 1))
    bits = prefixes.filter("n <= 2").select("n", place.alias("_bit")).withColumn("_mask", F.expr("shiftleft(1, cast(_bit % 8 AS INT))"))
    found = bits.groupBy("n", F.expr("cast(_bit div 8 AS INT)").alias("byte")).agg(F.bit_or("_mask").alias("mask")).toArrow()
    n, byte, mask = (found[c].to_numpy() for c in ("n", "byte", "mask"))
    maps = []
    for length in (1, 2):
        one = np.zeros(_MAP_BITS // 8, np.uint8)
        one[byte[n == length]] = mask[n == length]
        maps.append(one.tobytes())
    return FirstWords(*maps)


def _listed_words(text: Column | str, ahead: int, begins: FirstWords | None = None) -> Column:
    """The words of each text with their places and the next ``ahead`` words, worked out column-wise in Arrow batches.

    With ``begins`` only words that may begin a term are listed, and only those that may begin a longer one with the words behind them.
    """

    def words(original: pa.Array, lowered: pa.Array) -> pa.Array:
        def split(column: pa.Array) -> pa.Array:
            return pc.split_pattern_regex(pc.fill_null(column.cast(pa.string()), ""), fx.WHITESPACE_RE2)

        parts, bare = split(original), pc.utf8_trim(split(lowered).flatten(), characters=fx.PUNCTUATION)
        bounds = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        lengths = pc.utf8_length(parts.flatten()).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        row, before = np.repeat(np.arange(len(parts)), np.diff(bounds)), np.concatenate([[0], np.cumsum(lengths)])
        filled = np.flatnonzero(pc.not_equal(bare, "").to_numpy(zero_copy_only=False))
        word, row = bare.take(pa.array(filled)), row[filled]
        firsts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(parts)))])
        place = np.arange(len(filled))
        behind = np.minimum(ahead, firsts[row + 1] - place - 1)
        listed, own_row = place, row
        if begins is not None:
            begin, longer = begins.marks(word)
            listed = np.flatnonzero(begin)
            behind, own_row = np.where(longer, behind, 0)[listed], row[listed]
        ends = np.concatenate([[0], np.cumsum(behind)])
        at = np.arange(ends[-1]) - np.repeat(ends[:-1], behind) + np.repeat(listed + 1, behind)
        following = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), word.take(pa.array(at)))
        numbers = [listed - firsts[own_row], filled[listed] - bounds[own_row], before[filled[listed]] - before[bounds[own_row]]]
        position, number, start = (pa.array(x.astype(np.int32)) for x in numbers)
        rows = pa.StructArray.from_arrays([position, word.take(pa.array(listed)), following, number, start], ["at", "word", "following", "word_no", "start"])
        lists = np.concatenate([[0], np.cumsum(np.bincount(own_row, minlength=len(parts)))])
        return pa.ListArray.from_arrays(pa.array(lists, pa.int32()), rows)

    words.__annotations__ = {"original": pa.Array, "lowered": pa.Array, "return": pa.Array}
    return F.arrow_udf(_WORDS)(words)(text, F.lower(text))


def section_words(section_rows: DataFrame, ahead: int, keep: Sequence[str], begins: FirstWords | None = None) -> DataFrame:
    """``at, word, following, word_no, mention_start`` of the words of the sections (all, or those that may begin a term), lower-cased
    and without edge punctuation.

    ``word_no`` counts pieces between blanks, ``at`` those with something left, and ``following`` holds the next ``ahead`` words.
    """
    listed = section_rows.select(*keep, "section_no", "section_start", F.explode(_listed_words("section_text", ahead, begins)).alias("w"))
    return listed.select(*keep, "section_no", "w.at", "w.word", "w.following", "w.word_no", (F.col("section_start") + F.col("w.start")).alias("mention_start"))


def entity_mentions(section_rows: DataFrame, terms: DataFrame, most_words: int = MOST_WORDS, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Dictionary terms of one to ``most_words`` words in the sections: ``doc_id, section_no, term, word_no, mention_start``.

    Words are compared in lower case without edge punctuation. Of overlapping matches the leftmost counts, of those that start
    together the longest. The trie of the dictionary is walked by joins, a word at a time: only words that begin a term (most others fall to a bit map before they are rows), then only
    pairs that do, and so on, are rows. Spark broadcasts a level whose file is small and splits hot words of a larger one. ``keep`` names the columns
    of a section's document.
    """
    prefixes = written(term_prefixes(terms), "terms")
    words = section_words(section_rows, most_words - 1, keep, first_words(prefixes))
    level = words.withColumn("prefix", F.col("word")).join(prefixes.filter("n = 1").drop("n"), "prefix")
    matches = []
    for n in range(1, most_words + 1):
        level = written(level, "begun")
        matches.append(level.filter("is_term").select(*keep, "section_no", "at", F.lit(n).alias("n"), F.col("prefix").alias("term"), "word_no", "mention_start"))
        longer = level.filter(F.size("following") >= n).withColumn("prefix", F.concat_ws(" ", "prefix", F.get("following", F.lit(n - 1)))).drop("is_term")
        level = longer.join(prefixes.filter(F.col("n") == n + 1).drop("n"), "prefix")
    found = matches[0]
    for part in matches[1:]:
        found = found.unionByName(part)
    section = [*keep, "section_no"]
    # The hash leads the sort: keys that share a long beginning are slow to compare.
    ordered = found.withColumn("_hash", F.xxhash64(*section)).repartition(*section).sortWithinPartitions("_hash", *section, "at", F.desc("n"))
    return ordered.mapInArrow(_leftmost(len(section)), ordered.schema).select(*section, "term", "word_no", "mention_start")


def _leftmost(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keeps the matches that begin behind the last kept one; rows come sorted by section (the first columns), start and falling length."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, end = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(c) for c in range(width)]
            fresh = np.zeros(batch.num_rows, bool)
            fresh[0] = last != [c[0].as_py() for c in own]
            for c in own:
                here, before = c.slice(1), c.slice(0, len(c) - 1)
                both = pc.fill_null(pc.not_equal(here, before), False)
                fresh[1:] |= pc.or_(both, pc.xor(pc.is_null(here), pc.is_null(before))).to_numpy(zero_copy_only=False)
            picked = []
            for i, (new, at, n) in enumerate(zip(fresh.tolist(), batch.column(width).to_pylist(), batch.column(width + 1).to_pylist())):
                if new:
                    end = 0
                if at >= end:
                    picked.append(i)
                    end = at + n
            last = [c[-1].as_py() for c in own]
            yield batch.take(pa.array(picked, pa.int64()))

    return kept


def entity_counts(mentions: DataFrame) -> DataFrame:
    """``term, mentions, publications, trials`` per entity; repeats inside a document are combined before the second shuffle."""
    per_doc = mentions.groupBy("term", "doc_id", "source_type").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("term").agg(F.sum("n").alias("mentions"), *[F.count_if(F.col("source_type") == t).alias(c) for c, t in KINDS.items()])


def _numbered_terms(terms: DataFrame, block: int) -> DataFrame:
    """``term, code`` of the distinct terms: blocks by hash that hold about ``block`` terms, ``code`` is the block, then ``_BITS`` bits for the number inside it."""
    distinct = written(terms.select("term").filter("term IS NOT NULL").distinct(), "vocabulary")
    blocks = max(1, -(-distinct.count() // block))
    inside = F.row_number().over(Window.partitionBy("_block").orderBy("term")) - 1
    numbered = distinct.withColumn("_block", F.pmod(F.xxhash64("term"), F.lit(blocks))).select("term", (F.col("_block") * 2**_BITS + inside).cast("long").alias("code"))
    return written(numbered, "term-codes")


def _dealt_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``i, j, deal, left, right`` and the counts for each pair of blocks that a sorted set of codes has terms of."""
    for batch in batches:
        rows, held = [], 0

        def packed() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.int64()] * len(_COUNTED)]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["i", "j", "deal", "left", "right", *_COUNTED])

        sets, counts = batch.column("codes"), zip(*(batch.column(c).to_pylist() for c in ("deal", *_COUNTED)))
        bounds, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
        for first, last, (deal, *own) in zip(bounds[:-1], bounds[1:], counts):
            codes = flat[first:last]
            block, number = codes >> _BITS, (codes & (2**_BITS - 1)).astype(np.int32)
            cuts = np.flatnonzero(np.diff(block)) + 1
            names, parts = block[np.concatenate([[0], cuts])].tolist(), np.split(number, cuts)
            for a, left in enumerate(parts):
                for b in range(a, len(parts)):
                    rows.append((names[a], names[b], deal, left, parts[b], *own))
                    held += len(left) + len(parts[b])
                    if held > PAIR_STEP:
                        yield packed()
                        rows, held = [], 0
        if rows:
            yield packed()


def _pair_codes(left: pa.ListArray, right: pa.ListArray, counts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """The pairs of both lists of each row as ``left``, then ``_BITS`` bits of ``right``, with the row's counts, some millions at a time."""
    (at, lengths, values), (to, widths, others) = ((x.offsets.to_numpy()[:-1], pc.list_value_length(x).to_numpy().astype(np.int64), x.values.to_numpy()) for x in (left, right))
    # One line per element of a left list: its row, its value, and the right list to run along.
    row = np.repeat(np.arange(len(lengths)), lengths)
    value = values[np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + at[row]].astype(np.int64)
    ends = np.cumsum(widths[row])
    first = 0
    while first < len(row):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + PAIR_STEP, side="right")))
        mine, width = row[first:last], widths[row[first:last]]
        begin = np.cumsum(width) - width
        place = np.arange(int(width.sum())) + np.repeat(to[mine] - begin, width)
        yield np.repeat(value[first:last] << _BITS, width) + others[place], [np.repeat(c[mine], width) for c in counts]
        first = last


class _PairCounts:
    """Counts of the pairs of one pair of blocks: few of them as a list, many as a table of a cell per pair."""

    def __init__(self) -> None:
        self.listed, self.size, self.cells, self.side = [], 0, None, 0

    def add(self, codes: np.ndarray, counts: list[np.ndarray]) -> None:
        self.listed.append((codes, counts))
        self.size += len(codes)
        if self.size > PAIR_STEP:
            self._fold()

    def _fold(self) -> None:
        for codes, counts in self.listed:
            a, b = codes >> _BITS, codes & (2**_BITS - 1)
            side = max(self.side, int(max(a.max(), b.max())) + 1)
            if side > self.side:
                grown = [np.zeros((side, side), np.int64) for _ in counts]
                for new, old in zip(grown, self.cells or []):
                    new[: self.side, : self.side] = old
                self.cells, self.side = grown, side
            for cells, count in zip(self.cells, counts):
                cells += np.bincount(a * side + b, weights=count, minlength=side * side).astype(np.int64).reshape(side, side)
        self.listed, self.size = [], 0

    def pairs(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        if self.cells is not None:
            self._fold()
            a, b = np.nonzero(self.cells[-1])
            return a, b, [cells[a, b] for cells in self.cells]
        codes, group = np.unique(np.concatenate([c for c, _ in self.listed]), return_inverse=True)
        sums = [np.bincount(group, weights=np.concatenate([n[k] for _, n in self.listed])).astype(np.int64) for k in range(len(_COUNTED))]
        return codes >> _BITS, codes & (2**_BITS - 1), sums


def _counted_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b`` (codes) with their counts over the rows of each pair of blocks; rows come sorted by it."""
    pair, counted = None, None

    def closed() -> Iterator[pa.RecordBatch]:
        a, b, sums = counted.pairs()
        # Inside one block each pair was met in both orders and each term with itself.
        wanted = a < b if pair[0] == pair[1] else np.ones(len(a), bool)
        columns = [(pair[0] << _BITS) + a[wanted], (pair[1] << _BITS) + b[wanted], *(n[wanted] for n in sums)]
        out = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", *_COUNTED])
        for first in range(0, out.num_rows, 100_000):
            yield out.slice(first, 100_000)

    for batch in batches:
        i, j = batch.column("i").to_numpy(), batch.column("j").to_numpy()
        cuts = (np.flatnonzero((np.diff(i) != 0) | (np.diff(j) != 0)) + 1).tolist()
        for first, last in zip([0, *cuts], [*cuts, batch.num_rows]):
            if first == last:
                continue
            if pair != (int(i[first]), int(j[first])):
                if counted is not None:
                    yield from closed()
                pair, counted = (int(i[first]), int(j[first])), _PairCounts()
            part = batch.slice(first, last - first)
            left, right = (pa.concat_arrays([part.column(c)]) for c in ("left", "right"))
            for codes, counts in _pair_codes(left, right, [part.column(c).to_numpy() for c in _COUNTED]):
                counted.add(codes, counts)
    if counted is not None:
        yield from closed()


def cooccurrence(mentions: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """``term_a, term_b, publications, trials``: how many documents of each kind hold both terms (``term_a < term_b``).

    The terms are numbered in blocks. Documents with the same set of terms (copies above all) are counted together first; a set is dealt out by
    the pairs of blocks it has terms of, and its pairs are never rows: a task adds them up in a table of a pair of blocks, or in a
    list where they are few. What leaves the tasks is one row per pair of terms and deal, however many documents hold it.
    """
    held = written(mentions.select("doc_id", "source_type", "term"), "held-terms")
    terms = _numbered_terms(held, block)
    sets = held.join(terms, "term").groupBy("doc_id", "source_type").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    weights = [F.count_if(F.col("source_type") == t).alias(c) for c, t in KINDS.items()]
    weighted = sets.filter(F.size("codes") > 1).groupBy("codes").agg(*weights, F.count(F.lit(1)).alias("documents")).withColumn("deal", F.pmod(F.xxhash64("codes"), F.lit(PAIR_DEALS)).cast("int"))
    lists = ", ".join(f"{c} long" for c in _COUNTED)
    cut = weighted.mapInArrow(_dealt_sets, f"i long, j long, deal int, left array<int>, right array<int>, {lists}")
    dealt = cut.repartition("i", "j", "deal").sortWithinPartitions("i", "j")
    counted = dealt.mapInArrow(_counted_pairs, f"a long, b long, {lists}")
    one, two = terms.select(F.col("code").alias("a"), F.col("term").alias("_one")), terms.select(F.col("code").alias("b"), F.col("term").alias("_two"))
    named = counted.join(one, "a").join(two, "b").select(F.least("_one", "_two").alias("term_a"), F.greatest("_one", "_two").alias("term_b"), *KINDS)
    return named.groupBy("term_a", "term_b").agg(*[F.sum(c).alias(c) for c in KINDS])
