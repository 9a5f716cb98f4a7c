"""The whole corpus pipeline on small tables: odd rows, clashing columns, repeats, no labels, nothing at all."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, start long, node long, in_doc_id string, text_hash int"
BENCHMARK = "item_id long, text string"


def _prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioubcdfglmnrst") for _ in range(rng.randrange(2, 8))) for _ in range(n))


@pytest.fixture
def folder(spark, tmp_path):
    def write(rows, items):
        path = str(tmp_path / f"in{len(rows)}")
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame(items, BENCHMARK).write.parquet(f"{path}/benchmark.parquet")
        return path

    return write


def _row(doc_id, text, lang="en", source="src0"):
    return (doc_id, text, lang, source, len(text or ""), "x", 1, 2, "y", 3)


def _check_files(rows, got):
    """Kept documents are given ones, in order, with the ids of their whole texts, one after the other."""
    texts, tokenizer, start = {r[0]: r[1] for r in rows}, tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json")), 0
    for r in sorted(got, key=lambda r: r.start):
        ids = tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_pipeline_on_odd_rows(spark, folder):
    item = _prose(1, 40)
    rows = [_row(i, _prose(100 + i), None if i % 9 == 0 else "en", f"src{i % 5}") for i in range(60)]
    copies = [_row(200 + i, _prose(100)) for i in range(5)]
    leaks = [_row(300, _prose(7) + " " + item + " " + _prose(8)), _row(301, item)]
    odd = [_row(400, None), _row(401, ""), _row(402, "12 34 !!"), _row(403, _prose(9, 8000), source=None), _row(404, " \n\t")]
    every = rows + copies + leaks + odd
    got = corpus_pipeline.run(spark, folder(every, [(1, item), (2, None), (None, _prose(3)), (3, "two words"), (1, item)])).collect()
    ids = [r.doc_id for r in got]
    assert len(set(ids)) == len(ids) and not {*range(200, 205), 300, 301, 400, 401, 402, 404} & set(ids)
    assert len(ids) > 5  # the mixing stage draws a share
    _check_files(every, got)


def test_pipeline_keeps_a_corpus_without_languages(spark, folder):
    rows = [_row(i, _prose(100 + i), None, "src1") for i in range(40)]
    got = corpus_pipeline.run(spark, folder(rows, [])).collect()
    assert len(got) > 0
    _check_files(rows, got)


def test_pipeline_of_nothing(spark, folder):
    assert corpus_pipeline.run(spark, folder([], [])).count() == 0


def test_stages_keep_the_columns(spark, folder):
    rows = [_row(i, _prose(100 + i)) for i in range(30)] + [_row(5, _prose(105)), _row(None, _prose(999))]
    path = folder(rows, [(1, _prose(1, 40))])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        kept = {tuple(r) for r in out.collect()}
        assert kept <= {tuple(r) for r in docs.collect()}, name
        if name in ("language_id", "near_dedup", "decontamination"):
            assert len(kept) >= 30, name
