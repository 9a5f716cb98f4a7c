"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import re
import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.session import written

#: Words are maximal runs of anything but the six ASCII blanks.
WORD_BREAK = "[\\x20\\x09-\\x0D]+"


def word_list(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8, A-Z lower-cased. ``bytes`` methods know just the ASCII letters and blanks, as wanted."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """At most ``rows`` rows of this session cross to Python at once. The default of 10,000 whole texts fills tens of MB on both sides of
    every running task. Results do not depend on it; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= rows:
        spark.conf.set(name, rows)


def give_back() -> None:
    """What this Python process has freed goes back to the system. Spark keeps workers for later tasks, and both allocators keep what was
    freed, so a worker would go on holding about as much as the largest step of any of its tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def start_afresh() -> None:
    """For a task's start: tokenizers that earlier stages left in this worker go too. A stage that needs them again makes them again."""
    shelf = sys.modules.get("_larkspur_worker")
    if shelf:
        vars(shelf).pop("encoders", None)
        vars(shelf).pop("aligners", None)
    give_back()


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids are fold -1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends here, and a lost executor costs no earlier stage."""
    return written(df, f"llm-{purpose}")


def bounded_rows(df: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` rows, those whose key hashes lowest: the same sample for the same rows, however they are dealt.

    The rows are counted first, and only those below a hash bound that leaves about four times ``limit`` are ordered, so
    what meets in one task does not grow with the number of partitions.
    """
    share = min(1.0, (4 * limit + 100) / max(df.count(), 1))
    bound = min(int(share * 2**64) - 2**63, 2**63 - 1)
    return df.filter(F.xxhash64(key) <= F.lit(bound).cast("long")).orderBy(F.xxhash64(key), key).limit(limit)


def plain_name(text: str) -> str:
    return re.sub(r"\W+", "_", text)
