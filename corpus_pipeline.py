"""The corpus pipeline: stages from raw documents to token files, each stored before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontam, langid, mixing, neardup, queries, tokens_out
from larkspur.llm.common import small_batches, stored, table
from larkspur.session import workspace


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a determined language: no letters, or two languages about as near."""
    small_batches(spark)
    model = langid.train_languages(docs)
    return langid.keep_identified(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays."""
    small_batches(spark)
    return neardup.keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that token shares meet the targets."""
    return mixing.mix(docs, queries.marginals(), mixing.word_count(F.col("text")))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left; one row per document, read back from them."""
    small_batches(spark)
    path = workspace(spark, "llm-tokens")
    tokens_out.write_token_files(docs, path, queries.tokenizer_path(), sparing=True)
    return tokens_out.read_token_files(spark, path, sparing=True)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("source_mixing", mix_sources),
    ("token_output", write_tokens),
]

#: No stage but the third has a SQL form: models, signatures and id files are checked by brute force in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's result is written to the shared folder and read back by the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
