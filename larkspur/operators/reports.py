"""Tables behind the portal views: document lists, digests, recent queries, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import text as fx
from larkspur.functions.render import step_label

# Kept and shown recent queries, and the digest's texts.
RECENT_KEPT = 200
RECENT_SHOWN = 50
DIGEST_TITLE = "### 📄 Summary of Retrieved Documentation Content\n"
DIGEST_EMPTY = "No substantive snippets found in retrieved documentation."
DIGEST_NONE = "No documentation content found."


def rank_sources(citations: DataFrame) -> DataFrame:
    """Add ``source_no`` to citation rows: by score, then original position. Few rows per question."""
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "position")
    return citations.withColumn("source_no", F.row_number().over(window))


def documents_by_score(citations: DataFrame) -> DataFrame:
    """Document list of each question in score order, with display defaults."""
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("id"), F.lit("Untitled"))
    return rank_sources(citations).select(
        "query_id", "source_no", title.alias("title"), F.coalesce("type", F.lit("unknown")).alias("type"),
        F.coalesce("id", F.lit("")).alias("id"), F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("snippet", F.lit("")).alias("snippet"), F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce("snapshot_ref", F.lit("")).alias("snapshot_ref"),
    )


def source_digest(cited: DataFrame) -> DataFrame:
    """``query_id, digest``: non-empty snippets in score order; skipped snippets keep their number."""
    ordered = F.array_sort(F.transform(
        "citations", lambda c, i: F.struct((-c["score"]).alias("order"), i.alias("position"), c.alias("c"))
    ))
    numbered = F.transform(ordered, lambda x, i: F.struct((i + 1).alias("no"), fx.strip(x["c"]["snippet"]).alias("snippet"), x["c"].alias("c")))
    kept = F.filter(numbered, lambda x: F.coalesce(x["snippet"], F.lit("")) != "")
    lines = F.transform(kept, lambda x: F.concat(
        F.lit("**["), x["no"].cast("string"), F.lit("] "), F.coalesce(x["c"]["title"], x["c"]["id"], F.lit("?")), F.lit(" ("),
        F.coalesce(x["c"]["id"], F.lit("?")), F.lit(")**\n> "), x["snippet"], F.lit("\n"),
    ))
    digest = (
        F.when(F.size("citations") == 0, F.lit(DIGEST_NONE))
        .when(F.size(kept) == 0, F.lit(DIGEST_EMPTY))
        .otherwise(F.concat(F.lit(DIGEST_TITLE + "\n"), F.array_join(lines, "\n")))
    )
    return cited.select("query_id", digest.alias("digest"))


def recent_queries(log: DataFrame, query_id: str, ts: str, keep: int = RECENT_KEPT, shown: int = RECENT_SHOWN) -> DataFrame:
    """The last ``keep`` queries, oldest first (``position``); ``display_no`` numbers the newest ``shown`` ones.

    The cut is a distributed top-n; only its ``keep`` rows are numbered together.
    """
    last = log.select(F.col(query_id).alias("query_id"), F.col(ts).alias("ts")).orderBy(F.desc("ts"), F.desc("query_id")).limit(keep)
    newest_first = Window.orderBy(F.desc("ts"), F.desc("query_id"))
    oldest_first = Window.orderBy("ts", "query_id")
    numbered = last.withColumn("_new", F.row_number().over(newest_first)).withColumn("position", F.row_number().over(oldest_first))
    return numbered.withColumn("display_no", F.when(F.col("_new") <= shown, F.col("_new"))).drop("_new")


def timeline_table(manifests: DataFrame, key: str = "manifest_id", timeline: str = "execution_timeline") -> DataFrame:
    """Display rows of execution timelines: step label, elapsed and start with their defaults."""
    return manifests.select(key, F.posexplode(timeline).alias("position", "t")).select(
        key, "position",
        step_label(F.coalesce("t.step", F.lit("?"))).alias("node"),
        F.coalesce("t.elapsed_ms", F.lit(0)).cast("long").alias("elapsed_ms"),
        F.coalesce("t.started_at", F.lit("")).alias("started_at"),
    )


def event_rows(lines: DataFrame, event: Column, keep: list[str]) -> DataFrame:
    """Parsed step events; lines that do not parse are dropped."""
    return lines.withColumn("_e", event).filter(F.col("_e").isNotNull()).select(*keep, "_e.*").withColumn("label", step_label(F.col("node")))
