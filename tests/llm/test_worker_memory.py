"""Python workers outlive their tasks: what a stage leaves in them must not add to the next one's memory."""

import re
import sys
import types
from pathlib import Path

import numpy as np
import pyarrow as pa

from larkspur.llm import neardup, tokens_out
from larkspur.llm.common import give_back


class _Caught:
    """Stands for a table; hands out the function that its tasks would run."""

    def select(self, *columns):
        return self

    def join(self, *others):
        return self

    def mapInArrow(self, function, schema):
        return function


def _own_mb() -> float:
    return int(re.search(r"\nAnonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


def test_later_stages_drop_tokenizers(spark, monkeypatch):
    texts = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "node": [1, 2], "text": ["one two three four five six", None]})
    for made in (neardup.document_sets(_Caught()), neardup.sketches(_Caught(), None)):
        shelf = types.ModuleType("_larkspur_worker")
        shelf.encoders, shelf.aligners, shelf.slots = {1: "a tokenizer"}, {2: "two of them"}, {}
        monkeypatch.setitem(sys.modules, "_larkspur_worker", shelf)
        assert [b.num_rows for b in made(iter([texts]))] == [2]
        assert not hasattr(shelf, "encoders") and not hasattr(shelf, "aligners") and shelf.slots == {}


def test_freed_memory_goes_back():
    held = [np.ones(12_500) for _ in range(1500)]  # 150 MB in parts that are not mapped one by one
    pins = held[::100]
    del held
    before = _own_mb()
    give_back()
    assert _own_mb() < before - 50 and len(pins) == 15


def test_sparing_files_are_the_same(spark, tmp_path):
    from larkspur.llm.queries import tokenizer_path

    docs = spark.createDataFrame([(i, f"Some words, number {i}.\n" * (i % 7)) for i in range(60)] + [(70, None)], "doc_id long, text string")
    found = []
    for sparing in (False, True):
        path = str(tmp_path / f"files{sparing}")
        tokens_out.write_token_files(docs, path, tokenizer_path(), segment_ids=200, sparing=sparing)
        found.append((sorted(map(tuple, spark.read.parquet(path).collect())), sorted(map(tuple, tokens_out.read_token_files(spark, path, sparing).collect()))))
    assert found[0] == found[1] and len(found[0][1]) == 61


def test_keys_are_counted_in_many_tasks(spark):
    """However few files the nodes lie in, a task holds the keys of a share of them only."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "7")
        nodes = neardup.document_sets(spark.createDataFrame([(i, f"w{i} a b c d e f") for i in range(50)], "doc_id long, text string")).withColumnRenamed("doc_id", "node").coalesce(1)
        keys = neardup.keyed(nodes)
        assert keys.rdd.getNumPartitions() == 7 and keys.count() == 50 * neardup.VALUES
    finally:
        spark.conf.set(name, before)
