"""Snapshot tables on plain Parquet: data folders plus a commit log.

A snapshot's data is written to its own folder first; the table changes only when one row is appended to the log.
Readers trust the log alone, so a lost executor or a repeated run never shows half-written data. The log holds one
row per commit; only that metadata is ever read on the driver.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "unknown"

LOG_SCHEMA = T.StructType(
    [
        T.StructField("table_name", T.StringType(), False),
        T.StructField("snapshot_id", T.StringType(), False),
        T.StructField("committed_at", T.TimestampType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("operation", T.StringType(), False),
        T.StructField("paths", T.ArrayType(T.StringType()), False),
        T.StructField("job_version", T.StringType()),
    ]
)


def latest_snapshots(log: DataFrame, as_of: dt.datetime | None = None) -> DataFrame:
    """Newest commit per table (``table_name, snapshot_id, committed_at``), optionally not after ``as_of``."""
    seen = log if as_of is None else log.filter(F.col("committed_at") <= F.lit(as_of))
    newest = F.max_by(F.struct("snapshot_id", "committed_at"), F.struct("committed_at", "seq"))
    return (
        seen.groupBy("table_name").agg(newest.alias("s"))
        .select("table_name", F.col("s.snapshot_id").alias("snapshot_id"), F.col("s.committed_at").alias("committed_at"))
    )


def _in_order(commits: list[Row]) -> list[Row]:
    return sorted(commits, key=lambda c: (c["table_name"], c["committed_at"], c["seq"]))


def _folders(commits: list[Row]) -> list[str]:
    """Folders of a table after its commits: those of the last replacing commit and of every append since."""
    base = max((i for i, c in enumerate(commits) if c["operation"] != "append"), default=0)
    return list(dict.fromkeys(p for c in commits[base:] for p in c["paths"]))


@dataclass
class SnapshotStore:
    """A folder of snapshot tables. The log is read once per store and again before each commit."""

    spark: SparkSession
    root: str
    _seen: list | None = field(default=None, init=False, repr=False)

    @property
    def _log_path(self) -> str:
        return f"{self.root}/_log"

    def log(self) -> DataFrame:
        """The commit log; empty if nothing was committed yet."""
        try:
            return self.spark.read.schema(LOG_SCHEMA).parquet(self._log_path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], LOG_SCHEMA)

    def refresh(self) -> None:
        """Look at the log again; until then the store shows the commits it has seen and its own."""
        self._seen = _in_order(self.log().collect())

    def _commits(self, table: str, as_of: dt.datetime | None = None) -> list:
        if self._seen is None:
            self.refresh()
        return [c for c in self._seen if c["table_name"] == table and (as_of is None or c["committed_at"] <= as_of)]

    def latest_snapshot_id(self, table: str, as_of: dt.datetime | None = None) -> str:
        commits = self._commits(table, as_of)
        return commits[-1]["snapshot_id"] if commits else UNKNOWN

    def has(self, table: str, snapshot_id: str) -> bool:
        """Whether the snapshot id is committed, by a fresh look at the log."""
        self.refresh()
        return any(c["snapshot_id"] == snapshot_id for c in self._commits(table))

    def stage(self, table: str, df: DataFrame, snapshot_id: str) -> str:
        """Write the data of a snapshot without making it visible; a repeat before the commit replaces it.

        Every run has its own folder, so the folders are the run partitions of an appended table.
        """
        path = f"{self.root}/{table}/{snapshot_id}"
        df.write.mode("overwrite").parquet(path)
        return path

    def publish(
        self, table: str, snapshot_id: str, committed_at: dt.datetime, operation: str = "overwrite",
        paths: list[str] | None = None, job_version: str | None = None,
    ) -> str:
        """Make a staged snapshot current. A snapshot id that is already committed is left as it is.

        The log row of an append names its own folder only, so writers that append at the same time never hide each other.
        """
        if self.has(table, snapshot_id) and operation != "rollback":
            return snapshot_id
        commits = self._commits(table)
        data = paths or [f"{self.root}/{table}/{snapshot_id}"]
        values = (table, snapshot_id, committed_at, len(commits), operation, data, job_version)
        row = [
            (F.array(*[F.lit(p) for p in v]) if isinstance(v, list) else F.lit(v)).cast(f.dataType).alias(f.name)
            for v, f in zip(values, LOG_SCHEMA.fields)
        ]
        self.spark.range(1).coalesce(1).select(*row).write.mode("append").parquet(self._log_path)
        self._seen = _in_order([*self._seen, Row(**dict(zip(LOG_SCHEMA.names, values)))])
        return snapshot_id

    def write(
        self, table: str, df: DataFrame, snapshot_id: str, committed_at: dt.datetime, operation: str = "overwrite",
        job_version: str | None = None,
    ) -> str:
        """Stage and publish. Data of a committed snapshot id is never written again."""
        if self.has(table, snapshot_id):
            return snapshot_id
        self.stage(table, df, snapshot_id)
        return self.publish(table, snapshot_id, committed_at, operation, job_version=job_version)

    def append(self, table: str, df: DataFrame, snapshot_id: str, committed_at: dt.datetime, **options) -> str:
        return self.write(table, df, snapshot_id, committed_at, operation="append", **options)

    def read(self, table: str, as_of: dt.datetime | None = None, snapshot_id: str | None = None) -> DataFrame:
        """The current table, the table at a time, or a recorded snapshot."""
        commits = self._commits(table, as_of)
        if snapshot_id is not None:
            commits = self._until(commits, snapshot_id)
        if not commits:
            raise ValueError(f"no snapshot of {table!r} for as_of={as_of} snapshot_id={snapshot_id}")
        return self.spark.read.parquet(*_folders(commits))

    @staticmethod
    def _until(commits: list[Row], snapshot_id: str) -> list[Row]:
        """The commits up to the last one of a snapshot id; none if there is no such commit."""
        return commits[: max((i for i, c in enumerate(commits, 1) if c["snapshot_id"] == snapshot_id), default=0)]

    def rollback(self, table: str, snapshot_id: str, committed_at: dt.datetime) -> str:
        """Make an earlier snapshot current again by a new log row that points at its data."""
        commits = self._until(self._commits(table), snapshot_id)
        if not commits:
            raise ValueError(f"no snapshot {snapshot_id!r} of {table!r}")
        return self.publish(table, snapshot_id, committed_at, "rollback", paths=_folders(commits))

    def list_datasets(self) -> DataFrame:
        """One row per table and column: ``table_name, snapshot_id, column_name, data_type, position``."""
        rows = []
        self.refresh()
        for table in sorted({c["table_name"] for c in self._seen}):
            snapshot_id = self.latest_snapshot_id(table)
            for position, field in enumerate(self.read(table).schema.fields):
                rows.append((table, snapshot_id, field.name, field.dataType.simpleString(), position))
        schema = "table_name STRING, snapshot_id STRING, column_name STRING, data_type STRING, position INT"
        return self.spark.createDataFrame(rows, schema)


def create_table(spark: SparkSession, name: str, schema: T.StructType, partition_by: str | None = None) -> None:
    """Create a catalog database and Parquet table if they are absent."""
    if "." in name:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name.rsplit('.', 1)[0]}")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    partition = f" PARTITIONED BY (`{partition_by}`)" if partition_by else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{partition}")
