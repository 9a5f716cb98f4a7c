"""Source registry: one row of names, schema and defaults per source."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

STRING, LIST = T.StringType(), T.ArrayType(T.StringType())

PROVENANCE = ("source_name", "source_version", "source_uri", "ingested_at", "ingestion_run_id", "pipeline_version")

_PROVENANCE_FIELDS = [
    T.StructField("source_name", STRING, False),
    T.StructField("source_version", STRING),
    T.StructField("source_uri", STRING),
    T.StructField("ingested_at", T.TimestampType(), False),
    T.StructField("ingestion_run_id", STRING, False),
    T.StructField("pipeline_version", STRING, False),
]


def _schema(*fields: tuple[str, T.DataType]) -> list[T.StructField]:
    return [T.StructField(name, kind) for name, kind in fields]


_ARTICLE = _schema(
    ("pmid", STRING), ("title", STRING), ("abstract", STRING), ("authors", LIST),
    ("publication_date", STRING), ("journal", STRING),
)
_TRIAL = _schema(
    ("nct_id", STRING), ("brief_title", STRING), ("conditions", LIST), ("interventions", LIST),
    ("primary_outcomes", LIST), ("sample_size", T.IntegerType()), ("status", STRING),
    ("start_date", STRING), ("completion_date", STRING),
)
_CURATED_AT = [T.StructField("curated_at", T.TimestampType(), False)]


@dataclass(frozen=True)
class SourceSpec:
    """Everything that differs between the sources.

    The three names are the ones used at ingestion (``name``), as collection (``collection``) and in filters
    (``source_type``).
    """

    name: str
    collection: str
    source_type: str
    key: str
    key_prefix: str
    title: str
    raw_schema: T.StructType
    curated_schema: T.StructType
    raw_table: str
    curated_table: str

    def input_schema(self) -> T.StructType:
        """Schema of the source records: raw columns without the stamped ones, numbers kept as VARIANT."""
        stamped = {"source_name", "ingested_at", "ingestion_run_id", "pipeline_version"}
        fields = []
        for field in self.raw_schema.fields:
            if field.name in stamped:
                continue
            kind = T.VariantType() if field.dataType == T.IntegerType() else field.dataType
            fields.append(T.StructField(field.name, kind))
        return T.StructType(fields)


ARTICLES = SourceSpec(
    name="pubmed", collection="articles", source_type="article", key="pmid", key_prefix="PMID", title="title",
    raw_schema=T.StructType(_ARTICLE + _PROVENANCE_FIELDS),
    curated_schema=T.StructType(
        _ARTICLE + [T.StructField("snippet_count", T.IntegerType())] + _CURATED_AT + _PROVENANCE_FIELDS
    ),
    raw_table="raw_articles", curated_table="curated_articles",
)
TRIALS = SourceSpec(
    name="clinicaltrials", collection="trials", source_type="trial", key="nct_id", key_prefix="NCT",
    title="brief_title",
    raw_schema=T.StructType(_TRIAL + _PROVENANCE_FIELDS),
    curated_schema=T.StructType(_TRIAL + _CURATED_AT + _PROVENANCE_FIELDS),
    raw_table="raw_trials", curated_table="curated_trials",
)

SOURCES = {spec.name: spec for spec in (ARTICLES, TRIALS)}


def source_spec(name: str) -> SourceSpec:
    """The spec of a source by any of its names."""
    for spec in SOURCES.values():
        if name in (spec.name, spec.collection, spec.source_type):
            return spec
    raise ValueError(f"Unknown source_name: {name!r}")
