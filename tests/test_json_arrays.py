"""JSON array files in many ranges against the json module and Spark's own reader."""

import json
import random

import pytest
from pyspark.sql import types as T

from larkspur.sources.json_arrays import array_records, brackets, read_json_array

STRINGS = ["", "plain", 'quote " and \\ slash', "{ [ } ] ,", '\\"}', "é 日本 \u2028", "line\nbreak\ttab", "}" * 30, "\\\\", '{"a": "}"}', "x" * 500]


def _record(rng, depth=0):
    if depth > 2 or rng.random() < 0.4:
        return rng.choice([rng.choice(STRINGS), rng.randrange(9), None, True, 1.5])
    if rng.random() < 0.5:
        return [_record(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b}", "c{", 'd"']): _record(rng, depth + 1) for _ in range(rng.randrange(4))}


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "64"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


@pytest.mark.parametrize("indent", [None, 2])
def test_records_of_many_ranges(spark, small_ranges, tmp_path, indent):
    rng, want = random.Random(indent), []
    for i in range(3):
        records = [{"id": f"{i}-{n}", "v": _record(rng)} for n in range(25)]
        want += records
        (tmp_path / f"f{i}.json").write_text(json.dumps([*records[:5], None, 7, "{", [{"no": "record"}], *records[5:]], indent=indent, ensure_ascii=bool(i)), encoding="utf-8")
    (tmp_path / "empty.json").write_text("[]")
    (tmp_path / "bare.json").write_text("\n".join(json.dumps({"id": f"bare-{n}", "v": STRINGS}) for n in range(9)))
    want += [{"id": f"bare-{n}", "v": STRINGS} for n in range(9)]
    found = array_records(spark, str(tmp_path))
    got = [json.loads(r["text"]) for r in found.collect()]
    assert sorted(got, key=lambda r: r["id"]) == sorted(want, key=lambda r: r["id"])
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 40


def test_equals_the_multi_line_reader(spark, small_ranges, tmp_path):
    rows = [{"a": s, "b": [s, "y"], "c": n} for n, s in enumerate(STRINGS)] + [{"a": None}, {"c": 5, "extra": {"deep": ["}"]}}, {}]
    (tmp_path / "x.json").write_text("\ufeff" * 0 + json.dumps(rows, indent=1))
    schema = T.StructType.fromDDL("a STRING, b ARRAY<STRING>, c INT")
    plain = spark.read.schema(schema).option("multiLine", True).json(str(tmp_path / "x.json"))
    got = read_json_array(spark, str(tmp_path / "x.json"), schema)
    assert sorted(map(repr, got.drop("_corrupt_record").collect())) == sorted(map(repr, plain.collect()))
    assert got.filter("_corrupt_record IS NOT NULL").count() == 0


def test_unreadable_records_stay_alone(spark, small_ranges, tmp_path):
    (tmp_path / "x.json").write_text('[{"a": "1"}, {"a": "2" "b"}, {broken}, {"a": ["no", "text"]}, {"a": "3"}]')
    got = read_json_array(spark, str(tmp_path / "x.json"), T.StructType.fromDDL("a STRING, c INT")).collect()
    assert sorted(r["a"] for r in got if r["_corrupt_record"] is None)[:2] == ["1", "3"]
    assert {r["_corrupt_record"] for r in got if r["_corrupt_record"]} >= {'{"a": "2" "b"}', "{broken}"} and len(got) == 5


def test_brackets():
    assert brackets('{"a}": [1]}', False) == ([(0, 1), (7, 1), (9, -1), (10, -1)], False)
    assert brackets('b\\"}": [', True) == ([(7, 1)], False)
    assert brackets('{"open \\" string', False) == ([(0, 1)], True) and brackets("still } open", True) == ([], True)
