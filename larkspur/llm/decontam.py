"""Benchmark decontamination with SimHash over item-sized windows, in DataFrame functions only.

Windows of as many words as an item are fingerprinted (64-bit SimHash of their 5-word shingles); a document that is shorter than the
item is one window as a whole. Fingerprints are cut into blocks;
item blocks are listed with all their allowed bit errors, so an equi-join on blocks meets every window within the radius
(pigeonhole). Candidates are confirmed by the exact weighted similarity of the shingle multisets.

A window can reach the similarity only if it holds enough of an item's shingles. Just windows that do are fingerprinted; the
rest of the corpus is met by one scan that joins shingles with those of the items.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import stored

SHINGLE = 5
LEAST_PERCENT = 75
#: Fingerprints within this many bits are candidates. At a similarity of 0.75 two windows differ in 11 bits on average with a
#: deviation of 3; 23 = 8 blocks * 3 - 1 leaves out about one in 10,000 of those right at the threshold.
BLOCKS, BLOCK_ERRORS = 8, 2
BLOCK_BITS = 64 // BLOCKS
#: Item shingles that are sent out at once: about 40 MB.
SLICE_ROWS = 1_000_000
RADIUS = BLOCKS * (BLOCK_ERRORS + 1) - 1


def words_of(text: Column) -> Column:
    """Lower-cased words of a text; none for null."""
    return F.coalesce(F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), F.array().cast("array<string>"))


def shingles_of(words: Column) -> Column:
    """Hashes of the 5-word shingles in order; a shorter text has one shingle of all its words, an empty one none."""
    last = F.size(words) - SHINGLE
    many = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(SHINGLE)]))
    return F.when(last >= 0, many).when(F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))


def with_shingles(rows: DataFrame, *kept: str) -> DataFrame:
    """``kept`` and ``shingles`` of ``text``. The words are a column of their own, so that they are split once per row; a filter on the
    shingles (also the one that ``explode`` implies) would be pushed below it and split them for every shingle."""
    return rows.select(*kept, words_of(F.col("text")).alias("words")).select(*kept, shingles_of(F.col("words")).alias("shingles"))


def needed(n: Column, size: Column) -> Column:
    """Shingles that a window of ``size`` shingles must share with an item of ``n``: 100 * same >= 75 * (n + size - same)."""
    return F.ceil(F.lit(LEAST_PERCENT) * (n + size) / (100 + LEAST_PERCENT)).cast("int")


def fingerprint(rows: DataFrame, keys: list[str], hashed: str) -> DataFrame:
    """SimHash per group of ``keys``: bit i is set if more than half of the shingles have it. Two 32-bit counters share a long."""
    lanes = 0x0000000100000001
    sums = rows.groupBy(*keys).agg(F.count("*").alias("__n"), *[F.sum(F.shiftrightunsigned(hashed, i).bitwiseAND(F.lit(lanes))).alias(f"__{i}") for i in range(32)])
    bits = []
    for i in range(32):
        low, high = F.col(f"__{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"__{i}", 32)
        bits += [F.when(low * 2 > F.col("__n"), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")]
        top = (1 << (i + 32)) - (1 << 64 if i == 31 else 0)
        bits += [F.when(high * 2 > F.col("__n"), F.lit(top)).otherwise(F.lit(0)).cast("long")]
    return sums.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fingerprint"))


def _blocks(print_: Column) -> Column:
    mask = (1 << BLOCK_BITS) - 1
    return F.array(*[F.shiftrightunsigned(print_, b * BLOCK_BITS).bitwiseAND(F.lit(mask)).cast("int") for b in range(BLOCKS)])


def _errors() -> Column:
    """All ways in which a block may differ."""
    changes = [sum(1 << i for i in chosen) for k in range(BLOCK_ERRORS + 1) for chosen in combinations(range(BLOCK_BITS), k)]
    return F.array(*[F.lit(x) for x in changes])


def item_shingles(benchmark: DataFrame) -> DataFrame:
    """``item_id, n (shingles), shingles`` of the items that have words; items of equal id are one row each."""
    hashed = with_shingles(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.col("item_id").isNotNull() & F.col("text").rlike("[^\\x20\\x09-\\x0D]")), "item_id")
    return hashed.select("item_id", F.size("shingles").alias("n"), "shingles").distinct()


def _met(placed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Join on ``shingle`` by sending ``wanted`` to the corpus, in slices of a bounded number of rows, so that no corpus shingle is
    shuffled. Nearly always there is one slice."""
    slices = max(1, -(-wanted.count() // SLICE_ROWS))
    parts = [F.broadcast(wanted.filter(F.pmod("shingle", F.lit(slices)) == i)) for i in range(slices)]
    return reduce(DataFrame.unionAll, [placed.join(part, "shingle") for part in parts])


def leaking_windows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, start, n, size, same``: every window of a document that is similar enough to an item.

    ``start`` is the window's first word (from 0), ``n`` the item's shingles, ``size`` the window's: as many, or those of the whole
    document where it has fewer. ``same`` are the shingles it shares with the item, counted as often as both have them.
    Similarity: 100 * same >= 75 * (n + size - same). Items of fewer than five words are one shingle and are met by
    whole documents of the same words only. Null ids, null texts and texts without words leak nothing. Rows that repeat an id
    are one document each and give their windows once. Other columns are not read.
    """
    items = stored(item_shingles(benchmark), "items")
    item_counts = items.select("item_id", "n", F.explode("shingles").alias("shingle")).groupBy("item_id", "n", "shingle").agg(F.count("*").alias("item_times"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")

    # 1. Shingles of the corpus that an item has; rare, as most of a corpus has nothing to do with a benchmark.
    placed = with_shingles(texts, "doc_id").select("doc_id", F.size("shingles").alias("m"), F.posexplode_outer("shingles").alias("at", "shingle"))
    hits = _met(placed, item_counts.select("shingle", "item_id", "n")).select("doc_id", "m", "item_id", "n", "at").distinct()

    # 2. Window starts that leave room for enough hits: the i-th hit is the first in the window and the needed-th is inside. A
    # document shorter than the item has one window only, from 0.
    runs = hits.groupBy("doc_id", "m", "item_id", "n").agg(F.array_sort(F.collect_list("at")).alias("at")).filter(F.size("at") >= 1)
    need = needed(F.col("n"), F.least("n", "m"))

    def starts(i: Column) -> Column:
        first, last = F.get("at", i), F.get("at", i + F.col("need") - 1)
        low = F.greatest(last - F.col("n") + 1, F.coalesce(F.get("at", i - 1) + 1, F.lit(0)), F.lit(0))
        return F.when(low <= first, F.sequence(low, F.greatest(low, first))).otherwise(F.array().cast("array<int>"))

    dense = runs.withColumn("need", need).filter(F.size("at") >= F.col("need"))
    several = F.flatten(F.transform(F.sequence(F.lit(0), F.size("at") - F.col("need")), starts))
    opened = dense.select("doc_id", "item_id", "n", F.when(F.col("m") < F.col("n"), F.array(F.lit(0))).otherwise(several).alias("starts"))
    windows = stored(opened.select("doc_id", "item_id", "n", F.explode(F.array_distinct("starts")).alias("start")), "windows")

    # 3. Fingerprints of those windows, from the whole texts of their documents.
    asked = windows.groupBy("doc_id").agg(F.collect_set(F.struct("start", "n")).alias("asked"))
    hashed = with_shingles(texts.join(asked, "doc_id"), "doc_id", "asked").distinct()
    cut = hashed.select("doc_id", F.xxhash64("shingles").alias("version"), "shingles", F.explode("asked").alias("w"))
    cut = cut.select("doc_id", "version", F.col("w.start").alias("start"), F.col("w.n").alias("n"), F.slice("shingles", F.col("w.start") + 1, F.col("w.n")).alias("part"))
    cut = cut.withColumn("size", F.size("part")).filter((F.col("size") == F.col("n")) | (F.col("start") == 0))
    keys = ["doc_id", "version", "start", "n", "size"]
    inside = stored(cut.select(*keys, F.explode("part").alias("shingle")), "inside")
    prints = stored(fingerprint(inside, keys, "shingle"), "prints")

    # 4. Multi-index join on blocks, then the radius.
    item_prints = stored(fingerprint(items.select("item_id", "n", F.explode("shingles").alias("shingle")), ["item_id", "n"], "shingle"), "item-prints")
    listed = item_prints.select("item_id", "n", F.col("fingerprint").alias("item_print"), F.posexplode(_blocks(F.col("fingerprint"))).alias("block", "value"))
    listed = listed.select("item_id", "n", "item_print", "block", F.explode(F.transform(_errors(), lambda e: F.col("value").bitwiseXOR(e))).alias("value"))
    blocks = prints.select(*keys, "fingerprint", F.posexplode(_blocks(F.col("fingerprint"))).alias("block", "value"))
    within = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print"))) <= RADIUS
    close = blocks.join(listed, ["n", "block", "value"]).filter(within).select("item_id", *keys).distinct()

    # 5. Exact weighted similarity.
    window_counts = inside.groupBy(*keys, "shingle").agg(F.count("*").alias("times"))
    both = window_counts.join(close, keys).join(item_counts, ["item_id", "n", "shingle"])
    same = both.groupBy("item_id", *keys).agg(F.sum(F.least("times", "item_times")).alias("same"))
    sure = same.filter(100 * F.col("same") >= LEAST_PERCENT * (F.col("n") + F.col("size") - F.col("same")))
    return sure.groupBy("doc_id", "item_id", "start", "n", "size").agg(F.max("same").alias("same"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per leaking document and item: ``doc_id, item_id, start, n_shingles, similarity`` of the best window (the first of
    equals). ``n_shingles`` are the window's."""
    best = leaking_windows(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max(F.struct("same", (-F.col("start")).alias("before"), "size", (-F.col("n")).alias("less"))).alias("top"))
    flat = best.select("doc_id", "item_id", (-F.col("top.before")).cast("long").alias("start"), F.col("top.size").alias("size"), (-F.col("top.less")).alias("n"), F.col("top.same").alias("same"))
    return flat.select("doc_id", "item_id", "start", F.col("size").cast("long").alias("n_shingles"), (F.col("same") / (F.col("n") + F.col("size") - F.col("same"))).alias("similarity"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no benchmark item. Same columns; rows with a null id are kept."""
    leaking = stored(leaking_windows(docs, benchmark).select("doc_id").distinct(), "leaking")
    return docs.join(leaking, "doc_id", "left_anti").select(*docs.columns)
