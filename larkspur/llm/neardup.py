"""Near-duplicates by MinHash signatures and a multi-index Hamming join.

A signature is 50 MinHash values of 12 bits, five to a chunk. Two signatures that differ in at most 19 values have, by the
pigeonhole principle, a chunk with at most one error. All chunks with one position left out are enumerated as keys, so an
equi-join on keys meets every such pair. Nodes that share a key also get a sharper signature of one-bit MinHash values, whose
Hamming distance sorts out most candidates; the rest are confirmed on the full shingle sets.

Groups of copies are never expanded into all pairs. Equal sets are one node. Nodes of a key are first compared with the most
central node of the key only; components of the links found so are formed, and just pairs of different components that
share a key are compared further.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import start_afresh, stored, word_list

SHINGLE = 5
#: Values in a signature, values in a chunk (one long), bits of a value.
VALUES, CHUNK, BITS = 50, 5, 12
CHUNKS = VALUES // CHUNK
#: One-bit values of the sharper signature, 64 to a long.
SHARP = 2048
#: Pairs whose sharper signatures differ in more bits are no candidates. At a similarity of 0.75 a pair differs in 256 on average, with
#: a deviation of 15; 312 leaves out one pair in 10,000 of those right at the threshold.
MAX_DISTANCE = 312
LEAST_PERCENT = 75
_SIGNATURE = [f"s{i}" for i in range(CHUNKS)]
_SHARP = [f"b{i}" for i in range(SHARP // 64)]
_FACTORS = np.random.default_rng(20).integers(1, 2**63, VALUES + SHARP, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    """64-bit hashes of words; a bounded memo."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < 200_000:
            self[word] = value
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, known: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; of a shorter text, the one hash of all its words."""
    words = word_list(text)
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], dtype=np.uint64)
    ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(ids) - SHINGLE + 1
    rolled = ids[:n].copy()
    for i in range(1, SHINGLE):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n]
    return np.unique(_mixed(rolled))


def _least(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """MinHash values of a non-empty set, one per factor; a few shingles at a time, so memory is bounded."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    step = max(1, (1 << 18) // len(factors))
    for first in range(0, len(hashes), step):
        np.minimum(least, (factors[:, None] * hashes[None, first : first + step]).min(axis=1), out=least)
    return _mixed(least)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The signature of a non-empty set, five values to a long."""
    short = _least(hashes, _FACTORS[:VALUES]) >> np.uint64(64 - BITS)
    shifts = (np.arange(CHUNK, dtype=np.uint64) * np.uint64(BITS))[None, :]
    return (short.reshape(CHUNKS, CHUNK) << shifts).sum(axis=1, dtype=np.uint64)


def sharp_signature(hashes: np.ndarray) -> np.ndarray:
    """One bit per MinHash value, 64 to a long."""
    bits = (_least(hashes, _FACTORS[VALUES:]) >> np.uint64(63)).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def document_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, digest`` (of the whole set; null if empty) and the signature for every row."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_afresh()
        known = _WordHashes()
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                sizes, digests, signs = [], [], np.zeros((part.num_rows, CHUNKS), dtype=np.uint64)
                for i, text in enumerate(part.column("text").to_pylist()):
                    hashes = shingle_hashes(text, known)
                    sizes.append(len(hashes))
                    digests.append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
                    if len(hashes):
                        signs[i] = signature(hashes)
                columns = [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(signs[:, i].astype(np.int64)) for i in range(CHUNKS)]], ["doc_id", "n_shingles", "digest", *_SIGNATURE])

    fields = ", ".join(f"{s} long" for s in _SIGNATURE)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(built, f"doc_id long, n_shingles long, digest binary, {fields}")


def _near(a: str, b: str) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in _SHARP]) <= MAX_DISTANCE


def _left_out(i: int) -> Column:
    """Mask of a chunk without its position ``i``."""
    return F.lit(~(((1 << BITS) - 1) << (BITS * i)))


def _keys() -> Column:
    """All (chunk, left-out position) keys of a signature; ``turn`` numbers them."""
    made = []
    for j in range(CHUNKS):
        for i in range(CHUNK):
            turn = F.lit(j * CHUNK + i)
            made.append(F.struct(F.xxhash64(turn, F.col(f"s{j}").bitwiseAND(_left_out(i))).alias("key"), turn.alias("turn")))
    return F.array(*made)


def keyed(nodes: DataFrame) -> DataFrame:
    """``node, key, turn``: every key of every node.

    The nodes, few bytes each, are dealt out first: their files are few, and a task that counts the keys of a whole file holds a map of
    fifty entries per node.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return nodes.repartition(parts, "node").select("node", *_SIGNATURE, F.explode(_keys()).alias("k")).select("node", "k.key", "k.turn")


def _met_first(a: str, b: str) -> Column:
    """True for just one of the keys that a pair shares, the first in turn. A function over arrays keeps the generated code short."""
    one, two = (F.array(*[F.col(f"{side}.{s}") for s in _SIGNATURE]) for side in (a, b))

    def turn(j: Column) -> Column:
        change, found = F.get(one, j).bitwiseXOR(F.get(two, j)), F.lit(VALUES)
        for i in reversed(range(CHUNK)):
            found = F.when(change.bitwiseAND(_left_out(i)) == 0, j * CHUNK + i).otherwise(found)
        return found

    return F.col(f"{a}.turn") == F.array_min(F.transform(F.sequence(F.lit(0), F.lit(CHUNKS - 1)), turn))


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every end of a link (``a``, ``b``): the smallest node that can be reached.

    Labels spread along links and then jump to their label's label, so the rounds grow with the logarithm of a chain, and each
    round is a written table.
    """
    edges = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = stored(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        offered = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("offer"))
        moved = labels.join(offered, labels["node"] == offered["a"]).select("node", F.col("component").alias("before"), F.least("component", "offer").alias("component"))
        lookup = labels.select(F.col("node").alias("via"), F.col("component").alias("further"))
        moved = moved.join(lookup, moved["component"] == lookup["via"], "left")
        after = stored(moved.select("node", "before", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        labels = after.select("node", "component")
        if after.filter("component < before").isEmpty():
            return labels


def sketches(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node``, its whole shingle set and the sharper signature, for the documents in ``wanted`` (``node``)."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_afresh()
        known = _WordHashes()
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                sets = [shingle_hashes(t, known) for t in part.column("text").to_pylist()]
                signs = np.array([sharp_signature(x) if len(x) else np.zeros(len(_SHARP), np.int64) for x in sets])
                ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("node"), lists, *[pa.array(x) for x in signs.T]], ["node", "shingles", *_SHARP])

    asked = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text")).join(wanted, "node", "left_semi")
    return asked.mapInArrow(built, "node long, shingles array<long>, " + ", ".join(f"{s} long" for s in _SHARP))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) whose full shingle sets are similar enough."""
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left_set")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("right_set"))
    same = F.size(F.array_intersect("left_set", "right_set")).cast("long")
    union = F.size("left_set").cast("long") + F.size("right_set") - F.col("same")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", same.alias("same"), "left_set", "right_set")
    return both.filter(100 * F.col("same") >= LEAST_PERCENT * union).select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (``doc_id``, ``text``).

    Documents with ``100 * intersection >= 75 * union`` of their 5-word shingle sets are linked; a component is named by its smallest
    id, whose document is kept. A text of fewer than five words is one shingle; a null text or one without words has
    an empty set and is linked with nothing. Rows that share an id are one document: it is linked if any of its texts is. A row
    with a null id is its own component (null) and is kept. Other columns are not read.
    """
    sets = stored(document_sets(docs), "signatures")
    full = sets.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    nodes = stored(full.groupBy("digest", *_SIGNATURE).agg(F.min("doc_id").alias("node")), "nodes")

    keys = keyed(nodes)
    crowded = keys.select("key", "node").groupBy("key").agg(F.count("*").alias("crowd")).filter("crowd > 1")
    shared = stored(keys.join(crowded, "key"), "shared")

    central = shared.groupBy("node").agg(F.sum("crowd").alias("weight"))
    weighed = shared.join(central, "node").select("key", "node", "weight")
    hubs = weighed.groupBy("key").agg(F.max(F.struct("weight", -F.col("node"))).alias("top")).select("key", (-F.col("top.col2")).alias("hub"))
    spokes = shared.select("key", "node").join(hubs, "key").filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    known = stored(sketches(docs, central.select("node")), "sketches")
    sharp = known.select("node", *_SHARP)
    met_hub = spokes.join(sharp.alias("x"), F.col("a") == F.col("x.node")).join(sharp.alias("y"), F.col("b") == F.col("y.node")).filter(_near("x", "y"))
    first = stored(confirmed(stored(met_hub.select("a", "b").distinct(), "spokes"), known).distinct(), "links")
    early = components(first)

    placed = shared.join(early, "node", "left").withColumn("component", F.coalesce("component", "node"))
    groups = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    split = groups.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("top")).filter("parts > 1").select("key", F.col("top.component").alias("main"))
    signed = nodes.select("node", *_SIGNATURE).join(sharp, "node")
    open_rows = stored(placed.join(split, "key").join(signed, "node").select("key", "turn", "node", "component", "main", *_SIGNATURE, *_SHARP), "open")
    minor = open_rows.filter("component <> main").alias("x")
    apart = (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
    met = minor.join(open_rows.alias("y"), (F.col("x.key") == F.col("y.key")) & apart & _near("x", "y") & _met_first("x", "y"))
    later = met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    second = confirmed(stored(later, "pairs"), known)
    found = components(first.union(second)).select(F.col("node"), F.col("component").alias("component_id"))

    members = full.select("doc_id", "digest").join(nodes.select("digest", "node"), "digest").join(found, "node", "left")
    placed_ids = members.select("doc_id", F.coalesce("component_id", "node").alias("component_id")).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    rows = sets.select("doc_id", "n_shingles").join(placed_ids, "doc_id", "left")
    return rows.select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that their component keeps; rows that share an id stay together. Same columns."""
    dropped = near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
