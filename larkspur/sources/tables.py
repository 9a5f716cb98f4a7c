"""Parquet tables that are written in parts: by run, and by hash bucket of a key.

Both are plain partitioned folders: a job replaces the partitions it has rows for and no others, and a repeated job replaces its
own. Readers use partition filters; the driver never lists rows, only bucket numbers.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.operators.dedup import latest_per_key
from larkspur.session import written

BUCKET = "key_bucket"


def _replace_parts(df: DataFrame, path: str, part: str) -> None:
    """Write a table's partitions that ``df`` holds rows of; the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


@dataclass
class RunTable:
    """Rows by the run that delivered them. A run that is written again replaces itself, also by nothing."""

    spark: SparkSession
    path: str
    schema: T.StructType
    run: str = "ingestion_run_id"

    def write(self, rows: DataFrame, run_id: str) -> None:
        """Write all rows of a run to its own partition folder."""
        if not re.fullmatch(r"[\w.-]+", run_id):
            raise ValueError(f"run ids are made of letters, digits and ._- only, not {run_id!r}")
        names = [c for c in self.schema.names if c != self.run]
        rows.select(*names).write.mode("overwrite").parquet(f"{self.path}/{self.run}={run_id}")

    def read(self, runs: Sequence[str] | None = None) -> DataFrame:
        """All rows, or those of some runs; the runs are a partition filter, so other folders are not opened."""
        if not _exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        rows = rows if runs is None else rows.filter(F.col(self.run).isin(*runs))
        return rows.select(*self.schema.names)


@dataclass
class KeyedTable:
    """One row per key, the first by ``order`` (columns or sort orders over the row's own columns) of all that were ever upserted.

    Rows lie in ``buckets`` folders by key hash. An upsert reads and rewrites only the folders that its change set touches, so
    a delivery that holds few keys costs little however large the table is. Upserting the same rows again changes nothing. Rows
    without a key take no part.
    """

    spark: SparkSession
    path: str
    key: str
    order: Sequence[str]
    buckets: int = 64
    schema: T.StructType | None = field(default=None)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _rank(self) -> Column:
        """What decides between rows of one key; the row hash makes it total."""
        return F.struct(*self.order)

    def read(self, only: Sequence[int] | None = None) -> DataFrame:
        """The table, or some buckets of it."""
        if not _exists(self.spark, self.path):
            if self.schema is None:
                raise ValueError(f"nothing was written to {self.path} yet")
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.parquet(self.path)
        rows = rows if only is None else rows.filter(F.col(BUCKET).isin(*only))
        return rows.drop(BUCKET)

    def upsert(self, rows: DataFrame, unique: bool = False) -> DataFrame:
        """Bring in rows; later ``order`` wins, at equal order the new row. Returns the rows that are new or changed.

        The change set is written first, so it is computed once. Old rows are compared by key and order only; those that lose are
        left out of their bucket by an anti join, which adaptive execution broadcasts when the change set is small. Of the comparison
        just the keys of old rows that win are stored, not the change set again. ``unique`` says that no key repeats in ``rows``, as in
        what another upsert returned; they are not shuffled to find the newest then.
        """
        newest = rows.filter(F.col(self.key).isNotNull())
        if not unique:
            newest = latest_per_key(newest, [self.key], [F.desc(c) for c in self.order])
        changes = written(newest.withColumn(BUCKET, self._bucket()), "changes")
        if not _exists(self.spark, self.path):
            _replace_parts(changes.repartition(BUCKET), self.path, BUCKET)
            return changes.drop(BUCKET)
        touched = [r[0] for r in changes.select(BUCKET).distinct().collect()]
        if not touched:
            return changes.drop(BUCKET)
        old = self.spark.read.parquet(self.path).filter(F.col(BUCKET).isin(*touched))
        slim = changes.select(self.key, self._rank().alias("_new"))
        later = old.select(self.key, self._rank().alias("_old")).join(slim, self.key).filter("_old > _new").select(self.key)
        # Stored before the buckets are replaced: the old files are gone after that.
        wins = changes.join(written(later, "later-keys"), self.key, "left_anti")
        kept = old.join(wins.select(self.key), self.key, "left_anti")
        _replace_parts(kept.unionByName(wins.repartition(BUCKET)), self.path, BUCKET)
        return wins.drop(BUCKET)
