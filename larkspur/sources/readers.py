"""Readers of source records and staged payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.sources.json_arrays import read_json_array
from larkspur.sources.specs import SourceSpec


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, read as it is split; ``spark.sql.files.maxPartitionBytes`` sets the size of the splits."""
    return spark.read.parquet(path)


def read_source_json(spark: SparkSession, path: str | list[str], spec: SourceSpec, lines: bool = False) -> DataFrame:
    """Source records from JSON array files, or from JSON lines (``lines=True``).

    Files of both forms are read by as many tasks as they have splits. Unreadable records keep their text in ``_corrupt_record`` and
    are rejected later.
    """
    if not lines:
        return read_json_array(spark, path, spec.input_schema())
    schema = T.StructType([*spec.input_schema().fields, T.StructField("_corrupt_record", T.StringType())])
    return (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )


def as_json_lists(df: DataFrame) -> DataFrame:
    """The same table with array columns as JSON text."""
    return df.select(
        *[
            F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast to a declared schema; text that is no number becomes null, absent columns become null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
    )


_WELL_FORMED = "_corrupt_record STRING"


def article_text_from_xml(article_id: Column, xml: Column) -> Column:
    """All non-empty AbstractText blocks joined by a blank line; null for malformed XML or a non-numeric id.

    ``xml`` is the staged article document; the blocks may lie at any depth and carry attributes. Of a block with
    elements inside, the text before the first one counts. A document type declaration is skipped, never resolved.
    """
    body = F.regexp_replace(xml, r"<!DOCTYPE[^>\[]*(?:\[[^\]]*\])?[^>]*>", "")
    readable = F.from_xml(body, _WELL_FORMED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})["_corrupt_record"].isNull()
    blocks = F.xpath(body, F.lit("//AbstractText/text()[not(preceding-sibling::*)]"))
    text = F.nullif(F.array_join(F.filter(blocks, lambda t: t != ""), "\n\n"), F.lit(""))
    return F.when(article_id.rlike("^[0-9]+$") & xml.isNotNull() & readable, text)


def trial_text_from_json(trial_id: Column, payload: Column) -> Column:
    """The detailed description, else the brief summary, of a staged study document."""
    module = "$.protocolSection.descriptionModule."
    detailed = F.nullif(F.get_json_object(payload, module + "detailedDescription"), F.lit(""))
    summary = F.nullif(F.get_json_object(payload, module + "briefSummary"), F.lit(""))
    return F.when(trial_id.startswith("NCT"), F.coalesce(detailed, summary))


#: Elements that end a line of a page's text.
BLOCK_TAGS = "p|div|br|li|ul|ol|h[1-6]|tr|td|table|article|section|nav|title|head|body|html"
_ATTRIBUTES = """(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def page_text(html: Column) -> Column:
    """Text of a whole staged page, one line per block element; null without any.

    Comments, scripts, styles and tags are dropped, also tags with ``>`` inside quoted attributes; the common entities are resolved.
    Blanks in a row are one, blank lines are left out.
    """
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in ("script", "style"):
        text = F.regexp_replace(text, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    text = F.regexp_replace(text, rf"(?i)</?(?:{BLOCK_TAGS})\b{_ATTRIBUTES}>", "\n")
    text = F.regexp_replace(text, f"<[A-Za-z/!]{_ATTRIBUTES}>", "")
    text = F.regexp_replace(F.replace(text, F.lit("&nbsp;"), F.lit(" ")), r"[ \t\x0B\f\r]+", " ")
    text = F.btrim(F.regexp_replace(text, r" ?\n[ \n]*", "\n"), F.lit(" \n"))
    for entity, letter in _ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(letter))
    return F.nullif(text, F.lit(""))
