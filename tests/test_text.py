import uuid

import pytest
from pyspark.sql import functions as F

from larkspur.functions import text as fx
from larkspur.functions.render import parse_event_line, score_text, step_label


def test_word_count(column):
    values = ["Machine learning for cardiovascular risk today", "", "   ", None, " a  b\tc\n", "x y z\x1cw"]
    assert column(fx.word_count, values) == [6, 0, 0, 0, 3, 4]
    assert [len(v.split()) if v else 0 for v in values] == [6, 0, 0, 0, 3, 4]


def test_words_keeps_order(column):
    assert column(fx.words, ["  b a\nb ", " ", None]) == [["b", "a", "b"], [], []]


@pytest.mark.parametrize(
    "value, year",
    [("2024-03-15", 2024), ("2023-06", 2023), ("2022", 2022), (" 2021-01 ", 2021), ("not-a-date", 0), ("", 0), (None, 0),
     ("24-03", 0), ("20245", 0), ("2024 -03", 0), ("2024/03", 0)],
)
def test_publication_year(column, value, year):
    assert column(fx.publication_year, [value]) == [year]


@pytest.mark.parametrize(
    "value, kept",
    [("2024-03-15", "2024-03-15"), ("2023-06", "2023-06"), ("2023", "2023"), (" 2023 ", "2023"), ("2024-2-5", "2024-2-5"),
     ("2024-02-30", None), ("2024-13", None), ("02024", None), ("24", None), ("2024-003-5", None), ("15/03/2024", None), ("", None),
     (None, None), ("0000", None), ("2024-00", None), ("2024-1", "2024-1"), ("2024-03-15\n", "2024-03-15")],
)
def test_partial_iso_date(column, value, kept):
    assert column(fx.partial_iso_date, [value]) == [kept]


def test_date_bounds(column):
    values = ["2024", "2024-02", "2024-2-5", None]
    assert [str(d) for d in column(lambda c: fx.date_lower(F.col(c)), values)] == ["2024-01-01", "2024-02-01", "2024-02-05", "None"]
    assert [str(d) for d in column(lambda c: fx.date_upper(F.col(c)), values)] == ["2024-12-31", "2024-02-29", "2024-02-05", "None"]


def test_list_item_count(column):
    assert column(fx.list_item_count, ["a, b, c", " diabetes ,  obesity ", "", None, ", ,", "one"]) == [3, 2, 0, 0, 0, 1]
    assert column(lambda c: fx.list_item_count(c, is_array=True), [["a, b", "c"], [], None, [" "]], "array<string>") == [2, 0, 0, 0]


def test_safe_int(column):
    assert column(fx.safe_int, ["45", " 7 ", "12.0", "abc", None]) == [45, 7, None, None, None]

    def from_json(c):
        return fx.safe_int(F.variant_get(F.parse_json(c), "$.n", "variant"), variant=True)

    assert column(from_json, ['{"n":45}', '{"n":12.0}', '{"n":"45"}', '{"n":"12.0"}', '{"n":"abc"}', '{"n":null}', "{}"]) == [45, 12, 45, None, None, None, None]


def test_search_terms(column):
    asked = ["What is the effect of aspirin on stroke?", "is, it", "The of and", "  Beta-blockers (ACE): outcomes!", ""]
    assert column(fx.search_terms, asked) == ["effect aspirin stroke", "is", "The of and", "beta-blockers ace outcomes", ""]


@pytest.mark.parametrize(
    "question, given, expected",
    [("any clinical evidence", None, "trial"), ("a study of x", None, "article"), ("trial or study", None, "trial"),
     ("which trial?", None, None), ("nothing here", None, None), ("a trial", "article", "article"), ("RCT data", None, "trial")],
)
def test_source_type(spark, question, given, expected):
    df = spark.createDataFrame([(question, given)], "q STRING, g STRING")
    assert df.select(fx.implied_source_type("q", "g")).first()[0] == expected


def test_uuid5_matches_python(column):
    names = ["PMID:1", "NCT:NCT05000001", "é", ""]
    assert column(fx.uuid5, names) == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]


def test_keys(column):
    assert column(lambda c: fx.doc_key("PMID", c), ["12"]) == ["PMID:12"]
    assert column(fx.bare_id, ["PMID:12", "12", "a:b:c"]) == ["12", "12", "c"]


def test_embedding_texts(spark):
    df = spark.createDataFrame([("T", None), (None, "abs "), ("", ""), ("t" * 3000, "x")], "title STRING, abstract STRING")
    got = [r[0] for r in df.select(fx.article_text("title", "abstract")).collect()]
    assert got == ["T", "abs", "", "t" * 3000 + " x"]
    trials = spark.createDataFrame([("T", "", "i"), ("", None, "")], "a STRING, b STRING, c STRING")
    assert [r[0] for r in trials.select(fx.trial_text("a", "b", "c")).collect()] == ["T i", ""]
    assert [len(r[0]) for r in df.select(fx.snippet("title")).collect()] == [1, 0, 0, 500]


def test_placeholder(spark):
    rows = [("", "article", True), (None, "article", True), ("Abstract A", "article", True), ("Abstract of a long real text", "article", False),
            ("short", "article", False), ("short", "trial", True), ("x" * 100, "trial", False)]
    df = spark.createDataFrame(rows, "content STRING, kind STRING, want BOOLEAN")
    assert df.filter(fx.is_placeholder("content", "kind") != F.col("want")).count() == 0


def test_event_lines(column):
    got = column(lambda c: parse_event_line(F.col(c)), ['data: {"node": "cmo_router"}', "data: {bad json!!!}", "data: ", "event: x", 'data:{"node":"n","elapsed_ms":5}'])
    assert [g and (g["node"], g["elapsed_ms"]) for g in got] == [("cmo_router", None), None, None, None, ("n", 5)]


def test_labels_and_scores(column):
    assert column(lambda c: step_label(F.col(c)), ["cmo_router", "custom"]) == ["CMO Router", "custom"]
    assert column(lambda c: score_text(F.col(c)), [0.9123456, 0.1235, None, 1.0], "double") == ["0.912", "0.124", "0.000", "1.000"]


def test_json_lists(column):
    assert column(fx.json_list, [["a", "b"]], "array<string>") == ['["a","b"]']
    assert column(fx.list_from_json, ['["a, b", "c"]', "[]"]) == [["a, b", "c"], []]
