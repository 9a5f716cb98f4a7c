"""Samples for training are bounded and the same however rows are dealt; documents that cannot be judged stay."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import langid, quality_rank, toxicity
from larkspur.llm.common import bounded_rows, small_batches

SCHEMA = "doc_id long, text string, lang string, in_doc_id string, row int, others string"


def test_bounded_rows_take_the_lowest_hashes(spark):
    ids = spark.range(5000).withColumnRenamed("id", "doc_id")
    want = {r.doc_id for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(40).collect()}
    for parts in (1, 7):
        assert {r.doc_id for r in bounded_rows(ids.repartition(parts), "doc_id", 40).collect()} == want
    assert bounded_rows(ids.limit(0), "doc_id", 40).count() == 0 and bounded_rows(ids.limit(10), "doc_id", 40).count() == 10


def test_documents_stay_where_no_language_was_learnt(spark):
    docs = spark.createDataFrame([(i, "A text that nobody named the language of", None, "x", 1, "y") for i in range(20)], SCHEMA)
    model = langid.train_languages(docs)
    assert model is None and sorted(map(tuple, langid.keep_identified(docs, model).collect())) == sorted(map(tuple, docs.collect()))


def test_clashing_names_stay(spark):
    rows = [(i, "the cat sat on the mat and the dog ran", "en", "x", 1, "y") for i in range(9)] + [(20 + i, "der Hund und die Katze sind im Haus", "de", "x", 2, None) for i in range(9)]
    docs = spark.createDataFrame([*rows, (50, None, "en", None, None, None), (51, "12345", "en", None, None, None)], SCHEMA)
    kept = langid.keep_identified(docs, langid.train_languages(docs))
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=repr) == sorted(rows, key=repr)
    assert langid.keep_identified(docs.limit(0), langid.train_languages(docs)).columns == docs.columns


def test_repeated_ids_teach_once(spark):
    """An id that occurs very often reaches the driver as one row, in all three models."""
    rows = [(1, f"good text number {i % 3}", "en") for i in range(3000)] + [(2, "bad bad bad", "de"), (3, None, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0)], "doc_id long, y int")
    once = docs.dropDuplicates().orderBy("doc_id", "text").dropDuplicates(["doc_id"])
    assert quality_rank.train_quality(docs, labels, "y") is not None
    first, second = (toxicity.train_toxicity(d, labels, "y") for d in (docs, docs.repartition(2)))
    assert first == second
    assert langid.train_languages(docs).languages == langid.train_languages(once).languages == ["de", "en"]


def test_sample_bytes(spark):
    """Texts beyond the byte bound are not learnt from."""
    docs = spark.createDataFrame([(i, f"idiot word{i} " * 50) for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, y int")
    none = toxicity.train_toxicity(docs, labels, "y", sample_bytes=10)
    assert none == toxicity.train_toxicity(docs.limit(0), labels, "y")


def test_language_profiles_stay_on_the_executors(spark, monkeypatch):
    """The model is fitted in a task; what reaches the driver is the model alone."""
    from pyspark.sql.classic.dataframe import DataFrame

    docs = spark.createDataFrame([(i, ("der hund und die katze " if i % 2 else "the dog and the cat ") * (1 + i % 3), "de" if i % 2 else "en") for i in range(30)], "doc_id LONG, text STRING, lang STRING")
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: pytest.fail("rows of the sample were read on the driver"))
    model = langid.train_languages(docs)
    assert model.languages == ["de", "en"] and model.weight.shape[0] == langid.BINS


def test_texts_cross_in_small_batches(spark):
    """Also what comes back from the language model; a smaller setting of the session stays."""
    name, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    try:
        for given, want in (("10000", 1000), ("0", 1000), ("40", 40)):
            spark.conf.set(name, given)
            small_batches(spark)
            assert spark.range(0, 2500, 1, 1).mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] == want
        spark.conf.set(name, "10000")
        docs = spark.range(0, 1300, 1, 1).select(F.col("id").alias("doc_id"), F.lit("the cat sat").alias("text"), F.lit("en").alias("lang"))
        judged = langid.identify(docs, langid.train_languages(docs))
        assert judged.mapInArrow(sizes, "n long").agg(F.sum("n")).first()[0] == 1300
    finally:
        spark.conf.set(name, before)
