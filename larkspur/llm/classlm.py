"""Brown class-based bigram language model.

Every word belongs to one class; P(word | previous word) = P(class | previous class) * P(word | class). Classes come from the exchange
algorithm: words move to the class that raises the likelihood of the class bigrams most. All counts are over the whole training
corpus.

The exchange works on units: the most frequent words one by one, and all other words by their ending. So any word has a class
that follows from itself and a bounded table, transitions are counted where the text is, and just the counts of the words
outside that table are joined by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import stored

#: The end of a text, counted as a token. No word can be it, as words hold no blank.
END = b"\n"
#: Groups of endings of the words that are not units by themselves.
ENDINGS = 1024
#: Bytes of text whose words are counted together, or one longer text; and whose words get their units together: few enough that
#: the distinct ones stay in the processor's cache.
COUNT_BYTES, UNIT_BYTES = 1 << 24, 1 << 22
#: Pairs that a task counts before it hands them on.
ROOM_PAIRS = 8_000_000


def ending_unit(word: bytes) -> int:
    """The group of a word's last three letters (a number below ``ENDINGS``), the same in every process."""
    tail, value = word.decode("utf-8", "replace").rstrip(".,;:!?")[-3:], 7
    for c in tail:
        value = (value * 1_000_003 + ord(c)) & 0x7FFFFFFF
    return (value ^ (value >> 13)) % ENDINGS


def _own_text(words: pa.Array) -> pa.Array:
    """The same strings in buffers of their own, from 0 on: some of Arrow's text functions go wrong on what was cut out of a longer array and cast."""
    return words.take(pa.array(np.arange(len(words)))).cast(pa.large_binary()).cast(pa.large_string(), safe=False)


def ending_units(words: pa.Array) -> np.ndarray:
    """``ending_unit`` of every word of a binary array."""
    words = _own_text(words)
    plain = pc.string_is_ascii(words).to_numpy(zero_copy_only=False)
    tails = pc.ascii_rtrim(words, ".,;:!?")
    offsets = np.frombuffer(tails.buffers()[1], np.int64, len(tails) + 1, tails.offset * 8) if len(tails) else np.zeros(1, np.int64)
    data = np.frombuffer(tails.buffers()[2] or b"", np.uint8)
    begins, ends, value = offsets[:-1], offsets[1:], np.full(len(tails), 7, np.int64)
    for back in (3, 2, 1):
        has = np.flatnonzero(ends - back >= begins)
        value[has] = (value[has] * 1_000_003 + data[ends[has] - back]) & 0x7FFFFFFF
    units = (value ^ (value >> 13)) % ENDINGS
    others = np.flatnonzero(~plain)
    units[others] = [ending_unit(w) for w in words.cast(pa.large_binary()).take(pa.array(others)).to_pylist()]
    return units


@dataclass(frozen=True)
class Vocabulary:
    """Units: endings first, then the end token, then the most frequent words; with the words' counts in training."""

    units: dict[bytes, int]
    counts: np.ndarray

    @property
    def size(self) -> int:
        return ENDINGS + len(self.units)

    @cached_property
    def _listed(self) -> pa.Array:
        return pa.array(list(self.units), pa.large_binary())

    def of(self, words: pa.Array | list[bytes]) -> np.ndarray:
        words = pa.array(words, pa.large_binary()) if isinstance(words, list) else words
        at = pc.index_in(words, value_set=self._listed)
        units, others = at.fill_null(0).to_numpy() + np.int64(ENDINGS), at.is_null()
        units[others.to_numpy(zero_copy_only=False)] = ending_units(words.filter(others))
        return units


def _runs(batches: Iterator[pa.RecordBatch], run_bytes: int) -> Iterator[pa.Array]:
    """The texts, small batches together and large ones cut to so many bytes, or one longer text; null texts are empty."""
    held, size = [], 0
    for batch in batches:
        texts = batch.column("text").cast(pa.large_string()).fill_null("")
        sizes = pc.binary_length(texts).to_numpy()
        first = 0
        for i, n in enumerate(sizes.tolist()):
            if size and size + n > run_bytes:
                yield pa.concat_arrays([*held, texts.slice(first, i - first)])
                held, size, first = [], 0, i
            size += n
        held.append(texts.slice(first))
    if held:
        yield pa.concat_arrays(held)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words (binary) of texts without nulls, and all words as positions among them; the end token, the first of them, ends each text."""
    trimmed = pc.ascii_trim(pc.ascii_lower(_own_text(texts)), " \t\n\v\f\r")
    split = pc.ascii_split_whitespace(trimmed)
    coded = split.flatten().dictionary_encode()
    at, ends = coded.indices.to_numpy() + np.int32(1), split.offsets.to_numpy()[1:] - split.offsets[0].as_py()
    blank = pc.equal(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
    if blank.any():  # the one empty word of a text without words
        at = np.delete(at, ends[blank] - 1)
        ends = ends - np.cumsum(blank)
    words = pa.concat_arrays([pa.array([END], pa.large_binary()), coded.dictionary.cast(pa.large_binary())])
    return words, np.insert(at, ends, 0)


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` (binary), ``n``: tokens of all texts, ends included. Each task counts before the shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _runs(batches, COUNT_BYTES):
            words, at = _words(texts)
            n = np.bincount(at, minlength=len(words))
            met = np.flatnonzero(n)  # an empty word is not
            yield pa.RecordBatch.from_arrays([words.take(pa.array(met)).cast(pa.binary()), pa.array(n[met])], ["word", "n"])

    return docs.select("text").mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _unit_pairs(docs: DataFrame, vocabulary) -> DataFrame:
    """``a, b, n``: how often unit ``b`` follows ``a``; the end token also stands before every text."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = vocabulary.value
        end, size, held, seen = words_of.units[END], words_of.size, [], 0
        # The smaller the numbers, the faster they are sorted.
        kind = np.uint32 if size * size < 1 << 32 else np.int64

        def rows() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate([np.zeros(0, kind), *held]), return_counts=True)
            a, b = np.divmod(pairs, kind(size))
            return pa.RecordBatch.from_arrays([pa.array((a.astype(np.int64) << 32) | b), pa.array(n)], ["pair", "n"])

        for texts in _runs(batches, UNIT_BYTES):
            words, at = _words(texts)
            units = words_of.of(words).astype(kind)[at]
            held.append(np.append(kind(end), units[:-1]) * kind(size) + units)
            seen += len(units)
            if seen > ROOM_PAIRS:
                yield rows()
                held, seen = [], 0
        yield rows()

    # A pair is one number until it is counted: that is less to hash and to shuffle than two.
    pairs = docs.select("text").mapInArrow(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return pairs.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), "n")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def _first_classes(vocabulary: Vocabulary, totals: np.ndarray, classes: int) -> np.ndarray:
    """Start: the end token alone in class 0, the other units dealt in turn by descending frequency."""
    order = np.lexsort((np.arange(len(totals)), -totals))
    order = order[order != vocabulary.units[END]]
    own = np.zeros(len(totals), dtype=np.int64)
    own[order] = 1 + np.arange(len(order)) % (classes - 1)
    return own


def exchange(pairs: DataFrame, vocabulary: Vocabulary, classes: int, rounds: int) -> np.ndarray:
    """The class of every unit. ``pairs`` is a table of unit pairs and is read once per round.

    A round joins the pairs with the classes of both neighbours, gathers each unit's counts by neighbouring class and lets every unit
    choose the class with the best gain against fixed class counts. A seeded half of the units may move per round, as moves made
    at the same time can undo each other. The tables sent out are bounded by the units and the squared classes.
    """
    spark = pairs.sparkSession
    sums = pairs.groupBy("b").agg(F.sum("n").alias("n")).toPandas()  # one row per unit
    totals = np.zeros(vocabulary.size, dtype=np.int64)
    totals[sums["b"]] = sums["n"]
    own = _first_classes(vocabulary, totals, classes)
    end = vocabulary.units[END]
    for turn in range(rounds):
        shipped = spark.sparkContext.broadcast(own)

        def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # A task adds up in a table of its own, whose size is bounded by the units and classes.
            at = shipped.value
            cells = np.zeros((2, len(at), classes), np.int64)
            for part in batches:
                a, b, n = (part.column(c).to_numpy(zero_copy_only=False) for c in "abn")
                np.add.at(cells[0].reshape(-1), b * classes + at[a], n)
                np.add.at(cells[1].reshape(-1), a * classes + at[b], n)
            side, unit, other = np.nonzero(cells)
            yield pa.RecordBatch.from_arrays([pa.array(unit), pa.array(side, pa.int32()), pa.array(other), pa.array(cells[side, unit, other])], ["unit", "side", "other", "n"])

        sides = pairs.mapInArrow(labelled, "unit long, side int, other long, n long").groupBy("unit", "side", "other").agg(F.sum("n").alias("n"))
        sides = stored(sides, "exchange")
        table = sides.filter("side = 0").join(spark.createDataFrame(pd.DataFrame({"unit": np.arange(len(own)), "own": own})), "unit").groupBy("other", "own").agg(F.sum("n").alias("n")).toPandas()
        grid = np.zeros((classes, classes))
        grid[table["other"], table["own"]] = table["n"]

        sent = spark.sparkContext.broadcast((own, grid))

        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, grid = sent.value
            for batch in batches:
                for first in range(0, batch.num_rows, 256):
                    part = batch.slice(first, 256)
                    unit = part.column("unit").to_numpy(zero_copy_only=False)
                    m = len(unit)
                    counts = np.zeros((m, 2, classes))
                    for i, cells in enumerate(part.column("cells").to_pylist()):
                        for cell in cells:
                            counts[i, cell["side"], cell["other"]] = cell["n"]
                    before, after, here, every = counts[:, 0], counts[:, 1], at[unit], np.arange(m)
                    # Counts without the unit, then the gain of adding it to each class.
                    rest = np.repeat(grid[None], m, axis=0)
                    rest[every, :, here] -= before
                    rest[every, here, :] -= after
                    rest = np.maximum(rest, 0)
                    left, right, now = rest.sum(axis=2), rest.sum(axis=1), _xlogx(rest)
                    gain = (_xlogx(rest + before[:, :, None]) - now).sum(axis=1) + (_xlogx(rest + after[:, None, :]) - now).sum(axis=2)
                    gain -= _xlogx(left + after.sum(axis=1, keepdims=True)) - _xlogx(left) + _xlogx(right + before.sum(axis=1, keepdims=True)) - _xlogx(right)
                    gain[:, 0] = -np.inf  # the end token's own class
                    gain[every, here] += 1e-9  # a move must gain something
                    yield pa.RecordBatch.from_arrays([pa.array(unit), pa.array(gain.argmax(axis=1))], ["unit", "choice"])

        # At most two cells per class and unit.
        rows = sides.groupBy("unit").agg(F.collect_list(F.struct("side", F.col("other").cast("int").alias("other"), "n")).alias("cells"))
        moves = rows.mapInArrow(chosen, "unit long, choice long").toPandas()
        may = np.random.default_rng(turn).random(len(own)) < (1.0 if turn == 0 else 0.5)
        new = own.copy()
        new[moves["unit"]] = moves["choice"]
        new[end] = 0
        moved = may & (new != own)
        own = np.where(may, new, own)
        if not moved.any():
            break
    return own


@dataclass(frozen=True)
class ClassModel:
    """Classes of the units, log10 transition probabilities, and per class the log10 of its emission denominator."""

    vocabulary: Vocabulary
    own: np.ndarray
    transition: np.ndarray
    emission_base: np.ndarray
    train_tokens: int
    distinct: int


def train(docs: DataFrame, words: int = 16_384, classes: int = 32, rounds: int = 4) -> tuple[ClassModel, DataFrame]:
    """The model of all texts of ``docs``, and the stored table of their word counts.

    ``words`` bounds the words that are units by themselves, ``classes`` the classes. Transitions and emissions are smoothed by
    added counts; every class keeps one count for unknown words, so the probabilities of all words and the unknown one add up to 1.
    """
    counts = stored(word_counts(docs), "words")
    top = counts.filter(F.col("word") != F.lit(END)).orderBy(F.desc("n"), "word").limit(words).toPandas()
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = counts.filter(F.col("word") == F.lit(END)).toPandas()["n"].sum()
    listed = [END, *map(bytes, top["word"])]
    vocabulary = Vocabulary({w: ENDINGS + i for i, w in enumerate(listed)}, np.array([ends, *top["n"]], dtype=np.int64))
    spark = docs.sparkSession
    pairs = stored(_unit_pairs(docs, spark.sparkContext.broadcast(vocabulary)), "pairs")
    own = exchange(pairs, vocabulary, classes, rounds)

    at = spark.createDataFrame(pd.DataFrame({"unit": np.arange(len(own)), "own": own}))
    left, right = at.toDF("a", "x"), at.toDF("b", "y")
    table = pairs.join(left, "a").join(right, "b").groupBy("x", "y").agg(F.sum("n").alias("n")).toPandas()
    grid = np.zeros((classes, classes))
    grid[table["x"], table["y"]] = table["n"]
    after = (grid.sum(axis=0) + 1) / (grid.sum() + classes)
    transition = (grid + 5 * after) / (grid.sum(axis=1, keepdims=True) + 5)

    # Distinct words per class: those that are units, and the others by their ending.
    def endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, n = np.unique(ending_units(batch.column("word")), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(unit), pa.array(n)], ["unit", "v"])

    known = spark.createDataFrame(pd.DataFrame({"word": pd.Series([bytearray(w) for w in listed], dtype=object)}), "word binary")
    rare = counts.join(known, "word", "left_anti").select("word").mapInArrow(endings, "unit long, v long").groupBy("unit").agg(F.sum("v").alias("v")).toPandas()
    distinct = np.bincount(own[ENDINGS:], minlength=classes) + np.bincount(own[rare["unit"]], rare["v"], minlength=classes)
    base = np.log10(grid.sum(axis=0) + distinct + 1)
    return ClassModel(vocabulary, own, np.log10(transition), base, int(sums["n"]), int(sums["v"])), counts


def score(docs: DataFrame, model: ClassModel, counts: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` for every row of ``docs`` (``doc_id``, ``text``).

    ``score`` is the model's log10 probability of the text with its end, ``base_score`` that of the add-one unigram model. A null text is
    an empty one: just the end. Rows are told apart by ``row`` if they have that column, else by ``doc_id``; rows of equal id
    and text give equal results.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)
    total = float(np.log10(model.train_tokens + model.distinct + 1))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        units, end = m.vocabulary.units, m.vocabulary.units[END]
        logs = np.log10(m.vocabulary.counts + 1.0)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                piece = batch.slice(first, 500)
                distinct, codes = _words(piece.column("text").cast(pa.large_string()).fill_null(""))
                at = m.vocabulary.of(distinct)[codes]
                classes, frequent = m.own[at], at >= ENDINGS
                ends = np.flatnonzero(codes == 0) + 1
                cuts = [0, *ends.tolist()]
                # A text's first word follows the end token, as the end of the text before it is one.
                steps, spread = m.transition[np.append(m.own[end], classes[:-1]), classes], m.emission_base[classes]
                frequents = np.append(0, np.cumsum(frequent))[cuts]
                known_logs = logs[at[frequent] - ENDINGS]
                n_tokens = np.diff(cuts)
                n_known = np.diff(frequents) if m.train_tokens else np.zeros(len(ends), np.int64)
                emitted = np.array([known_logs[a:b].sum() for a, b in zip(frequents, frequents[1:])])
                path = np.array([steps[a:b].sum() for a, b in zip(cuts, cuts[1:])])
                spent = np.array([spread[a:b].sum() for a, b in zip(cuts, cuts[1:])])
                base, own_score = emitted - total * n_tokens, path + emitted - spent
                # Rare words of each text, with how often it has them.
                text_of = np.repeat(np.arange(len(ends)), n_tokens)
                rare, times = np.unique(text_of[~frequent] * len(distinct) + codes[~frequent], return_counts=True)
                sizes = pa.array(np.searchsorted(rare, np.arange(len(ends) + 1) * len(distinct)), pa.int32())
                words_flat, times_flat = distinct.take(pa.array(rare % len(distinct))).cast(pa.binary()), pa.array(times, pa.int64())
                lists = [pa.ListArray.from_arrays(sizes, words_flat), pa.ListArray.from_arrays(sizes, times_flat)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), *[pa.array(x, pa.int64()) for x in (n_tokens, n_known)], *[pa.array(x, pa.float64()) for x in (base, own_score)], *lists],
                    ["doc_id", "n_tokens", "n_known", "base", "own", "words", "times"],
                )

    schema = "doc_id long, n_tokens long, n_known long, base double, own double, words array<binary>, times array<long>"
    rated = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(parts, schema)
    rated = rated.withColumn("row", F.monotonically_increasing_id())
    fixed = stored(rated, "rated")
    rare = fixed.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    # Counts are looked up once per word: the rows of a word meet in the join, which splits hot words.
    # Logs are added up in whole billionths, so that the order of the rows does not matter.
    logs = counts.select("word", F.log10(F.col("n") + 1).alias("log"))
    looked = rare.join(logs, "word").select("row", F.col("times").alias("known"), F.rint(F.col("times") * F.col("log") * 1e9).cast("long").alias("emitted"))
    added = looked.groupBy("row").agg(F.sum("known").alias("known"), (F.sum("emitted") / 1e9).alias("emitted"))
    both = fixed.drop("words", "times").join(added, "row", "left").na.fill({"known": 0, "emitted": 0.0})
    return both.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.col("known")).alias("n_known"), (F.col("base") + F.col("emitted")).alias("base_score"), (F.col("own") + F.col("emitted")).alias("score")
    )


def perplexity(log10_probability: Column, tokens: Column) -> Column:
    """Perplexity per token."""
    return F.pow(F.lit(10.0), -log10_probability / tokens)
