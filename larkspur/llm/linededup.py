"""Line dedup: lines that many documents share stay in the first document only.

Lines are exploded and normalised to a key, and a key travels as a 128-bit hash. Documents are counted per hash with partial sums before
the shuffle, so a line that a third of all documents hold arrives as one row per task. The drop lists are then made from hashes and
positions only; texts are moved once, when each row meets its own drop list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import stored

#: A key needs so many code points, and a line is dropped if so many documents hold its key.
LEAST_LENGTH, LEAST_DOCUMENTS = 10, 2
#: A key with at least one of so many parts of all line rows is joined by broadcast. There are never more such keys than parts.
PARTS = 20_000
_BLANKS = " \t\n\x0b\x0c\r"
_HASH = ["h1", "h2"]


def split_lines(text: Column) -> Column:
    """The lines of a text between line feeds; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII blanks at both ends and with A-Z lower-cased; other letters stay as they are."""
    return F.translate(F.btrim(line, F.lit(_BLANKS)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rows(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and the text's hash, which tells apart rows that share an id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("version", F.xxhash64("text"))


def line_hashes(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """``doc_id, version, position, h1, h2`` of every line whose key is long enough; rows with a null id are left out."""
    lines = _rows(docs).filter("doc_id IS NOT NULL").select("doc_id", "version", F.posexplode(split_lines(F.col("text"))).alias("position", "line"))
    keyed = lines.select("doc_id", "version", "position", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= least_length)
    return keyed.select("doc_id", "version", "position", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def shared_lines(lines: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """``h1, h2, first_id, n_rows`` of the keys that at least ``least_documents`` documents hold."""
    per_document = lines.groupBy(*_HASH, "doc_id").agg(F.count("*").alias("n"))
    counted = per_document.groupBy(*_HASH).agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_id"), F.sum("n").alias("n_rows"))
    return counted.filter(F.col("documents") >= least_documents).select(*_HASH, "first_id", "n_rows")


def dropped_positions(lines: DataFrame, shared: DataFrame, n_lines: int) -> DataFrame:
    """``doc_id, version, dropped``: the positions of the lines that a smaller id keeps.

    Keys with many of the ``n_lines`` rows are at most ``PARTS``, so they are sent to all tasks, and their lines are not shuffled.
    """
    often = F.col("n_rows") > n_lines // PARTS
    hot = F.broadcast(shared.filter(often).drop("n_rows"))
    rare = shared.filter(~often).drop("n_rows")
    met = lines.join(hot, _HASH, "left").select(*lines.columns, "first_id")
    by_hot = met.filter("first_id IS NOT NULL")
    by_rare = met.filter("first_id IS NULL").drop("first_id").join(rare, _HASH).select(*lines.columns, "first_id")
    lost = by_hot.union(by_rare).filter(F.col("doc_id") > F.col("first_id"))
    return lost.groupBy("doc_id", "version").agg(F.collect_set("position").alias("dropped"))


def without_repeated_lines(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, least_length: int = LEAST_LENGTH) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text`` for every row of ``docs`` (``doc_id``, ``text``); ``text`` holds the lines that stay.

    A line whose key has at least ``least_length`` code points and is found in at least ``least_documents`` documents stays in the
    smallest ``doc_id`` only, there as often as it occurs. All other lines stay, in their order. A null or empty text is one empty line
    and comes back as an empty text. Rows that share an id are one document. Rows with a null id do not count as documents
    and keep all lines. Texts of any length are split whole; an empty table gives an empty table. Other columns are not read.
    """
    lines = stored(line_hashes(docs, least_length), "lines")
    shared = stored(shared_lines(lines, least_documents), "shared-lines")
    lists = dropped_positions(lines, shared, lines.count())
    # Referred to more than once below, so the split is a column of its own and not made anew for every line.
    rows = _rows(docs).join(lists, ["doc_id", "version"], "left").withColumn("lines", split_lines(F.col("text")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    text = F.when(F.col("dropped").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n"))
    return rows.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), text.alias("text")
    )
