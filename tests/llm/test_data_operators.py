"""Edge cases and brute-force checks of the training-data operators on small tables."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from larkspur.llm import classlm, decontam, langid, mixing, neardup, quality_rank, tokencoder, tokens_out, topk, toxicity, urls
from larkspur.llm.common import fold_of, word_list

DOCS = "doc_id long, text string, lang string, source string, score string, start long"
WORDS = [f"w{i}" for i in range(60)]


def _text(seed, n=40):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_rows():
    """Nulls, empty and blank texts, a short text, repeated rows, a long text, columns with clashing names."""
    return [
        (1, None, None, None, "x", 1), (2, "", "en", "a", None, None), (3, " \n\t ", "en", "a", "x", 1), (4, "Two Words", "en", "a", "x", 1), (5, "two words", "fr", "b", "x", 1),
        (6, _text(1), "en", "a", "x", 1), (6, _text(1), "en", "a", "x", 1), (7, _text(1), "de", None, "x", 1), (8, _text(2, 9000), "de", "b", "x", 1), (None, _text(3), "de", "b", "x", 1),
        (9, "123 456 !!", "de", "b", "x", 1),
    ]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


# 1 token output


@pytest.mark.parametrize("n", [0, 1, 100, 255, 256, 257, 1500])
def test_coder_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.2, n), 50_000)
    assert (tokencoder.decode_segment(tokencoder.encode_segment(ids, 256)) == ids).all()


def test_coder_learns_and_detects_damage():
    ids = np.tile(np.arange(50), 100)
    data = tokencoder.encode_segment(ids, 1000)
    assert len(data) < len(ids)
    broken = bytearray(data)
    broken[-40] ^= 1
    with pytest.raises(ValueError):
        tokencoder.decode_segment(bytes(broken))


def test_segments_coded_together():
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 3, 3001), np.zeros(0, int), np.minimum(rng.zipf(1.2, 777), 50_000), np.tile(np.arange(50), 100), np.full(3, 50_256)]
    data = tokencoder.encode_segments(parts, 700)
    assert data == [tokencoder.encode_segment(x, 700) for x in parts]
    data.append(tokencoder.encode_segment(parts[2], 256))
    assert [x.tolist() for x in tokencoder.decode_segments(data)] == [x.tolist() for x in [*parts, parts[2]]]


def test_chunks_are_tokenized_once(monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    with open(public.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        encoder = tokens_out.ChunkEncoder(f.read())
    given, whole = [], encoder.whole
    monkeypatch.setattr(encoder, "whole", lambda texts: given.extend(texts) or whole(texts))

    def check(*texts):
        given.clear()
        assert [x.tolist() for x in encoder.encode(list(texts))] == [x.tolist() for x in whole(list(texts))]
        return "".join(given)

    assert check("one two, three", "two\nfour \u00e9t\u00e9.") != ""
    assert check("four two", "one, two. three") == ""
    assert check("one two five. four") == " five four"
    monkeypatch.setattr(tokens_out, "KEPT_CHUNKS", 12)  # full: others are kept once most are new
    for words in (" six seven eight two", " six seven eight two", " six nine ten two"):
        check(words, "a" + words)


def test_token_files(spark, docs, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(20, "a  b\n\n c <|endoftext|>"), (21, " x, it's 3.14.\n y ..z")], "doc_id long, text string"))
    tokens_out.write_token_files(more, str(tmp_path / "t"), path, segment_ids=3000, block=512)
    got = sorted((tuple(r) for r in tokens_out.read_token_files(spark, str(tmp_path / "t")).collect()), key=lambda r: r[1])
    tk, start, want = tokenizers.Tokenizer.from_file(path), 0, []
    for r in sorted(more.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = tk.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_token_files_of_nothing(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    tokens_out.write_token_files(empty(spark), str(tmp_path / "t"), public.path("byte_bpe_50k.json"))
    assert tokens_out.read_token_files(spark, str(tmp_path / "t")).count() == 0


# 2 URL filter


def test_globs_equal_regex():
    import re

    rng = random.Random(5)
    globs = ["".join(rng.choice("ab*") for _ in range(rng.randint(1, 30))) for _ in range(40)]
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    rules = [urls.GlobRule(g, "block").globs()[0] for g in globs]
    got = {i: set(hits.tolist()) for i, hits in urls.Automaton(rules).accepted([t.encode() for t in texts], lanes=16)}
    want = {i: {k for k, g in enumerate(globs) if re.fullmatch(g.replace("*", ".*"), t)} for i, t in enumerate(texts)}
    assert got == want


def test_url_rules(spark):
    rules = [urls.HostRule("net", "/", "block"), urls.HostRule("example.net", "/en/", "allow")]
    rows = [(1, "http://A.Example.NET/en/x?q"), (2, "http://x.net"), (3, "http://x.net/"), (4, None), (5, "no scheme"), (6, "http://badnet/"), (7, "http://spam.org/" + "a" * 5000), (1, "http://A.Example.NET/en/x?q")]
    df = spark.createDataFrame([(*r, "old") for r in rows], "page_id int, url string, rule string")
    got = [tuple(r) for r in urls.judge_urls(df, rules, [urls.GlobRule("spam*", "block")]).orderBy("page_id").select("page_id", "host", "rule", "verdict").collect()]
    assert got == [(1, "a.example.net", "example.net/en/", "allow")] * 2 + [
        (2, "x.net", None, "allow"), (3, "x.net", "net/", "block"), (4, "", None, "allow"), (5, "", None, "allow"), (6, "badnet", None, "allow"), (7, "spam.org", None, "block")
    ]
    assert urls.judge_urls(df.limit(0), rules, []).count() == 0


def test_host_rules_do_not_match_inside_the_path(spark):
    rules = [urls.HostRule("net", "/", "block"), urls.HostRule("example.net", "/en/", "allow")]
    want = {
        "http://example.com/asp.net/x": None, "http://a.com/old/www.example.net/en/1": None, "http://a.com/.net/": None, "http://a.com//x.example.net/en/": None, "http:///x.net/": None,
        "http://a.b.net/old/www.example.net/en/1": "net/", "http://www.example.net/de/x.example.net/en/": "net/", "http://a.www.example.net/en/asp.net/": "example.net/en/",
        "http://net/x": "net/", "http://.net/": "net/", "http://example.net.net/en/": "net/",
    }
    df = spark.createDataFrame([(u,) for u in want], "url string")
    assert {r.url: r.rule for r in urls.judge_urls(df, rules, []).collect()} == want
    # A glob still runs over the path.
    spam = urls.judge_urls(df, [], [urls.GlobRule("*asp.*", "block")]).filter("verdict = 'block'").collect()
    assert {r.url for r in spam} == {u for u in want if "asp." in u}


# 3 quality, 5 toxicity


def test_quality_learns(spark, docs):
    good = [(100 + i, _text(i), "en", "a", "x", 1) for i in range(40)]
    bad = [(200 + i, _text(i, 20).upper() + " ### $$$", "en", "a", "x", 1) for i in range(40)]
    labels = spark.createDataFrame([(i, int(i < 200)) for i, *_ in good + bad] + [(None, 1), (1, None)], "doc_id long, quality int")
    every = docs.union(spark.createDataFrame(good + bad, DOCS))
    model = quality_rank.train_quality(every, labels, "quality")
    out = quality_rank.score_quality(every, model).collect()
    assert len(out) == every.count() and all(0 <= r.score <= 1 for r in out)
    assert all(r.predicted == int(r.doc_id < 200) for r in out if r.doc_id and r.doc_id >= 100)
    none = quality_rank.train_quality(every, labels.limit(0), "quality")
    assert quality_rank.score_quality(empty(spark), none).count() == 0
    assert {r.score for r in quality_rank.score_quality(docs, none).collect()} == {1.0}


def test_toxicity_finds_the_sentence(spark, docs):
    rng = random.Random(3)
    rows = [(100 + i, ". ".join(_text(rng.random(), 8) + (" vilest" if s == 2 and i % 2 else "") for s in range(5)), "en", "a", "x", 1) for i in range(120)]
    labels = spark.createDataFrame([(i, (i - 100) % 2) for i, *_ in rows] + [(None, 1)], "doc_id long, toxic int")
    every = docs.union(spark.createDataFrame(rows, DOCS))
    out = {r.doc_id: r for r in toxicity.score_toxicity(every, toxicity.train_toxicity(every, labels, "toxic")).collect()}
    assert all(out[i].predicted == (i - 100) % 2 for i, *_ in rows)
    spans = out[101].offending
    assert len(spans) == 1 and "vilest" in rows[1][1][spans[0].start : spans[0].end]
    assert out[1].score == 0 and out[2].offending == []
    assert toxicity.score_toxicity(empty(spark), toxicity.train_toxicity(empty(spark), labels, "toxic")).count() == 0


# 4 exact search


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(120)]
    rows += [(200, None), (250, [1.0, None]), (300, [float("nan"), 1.0]), (None, [1.0]), (350, []), (400, [0.5]), (50, rows[50][1]), (3, rows[3][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    got = sorted(tuple(r) for r in topk.exact_topk(df, F.col("vec_id") % 50 == 0, query_rows=2, cell_rows=20).collect())
    f = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and x == x for x in v)}
    want = []
    for q in f:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(f[q], f[i])), i) for i in f if i != q)[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert got == sorted(want)
    assert topk.exact_topk(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# 6 mixing


def test_raking_meets_targets():
    tokens = np.random.default_rng(0).integers(1, 1000, (4, 3, 2)).astype(float)
    targets = [np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.5, 0.25, 0.25]), np.array([0.7, 0.3])]
    fitted = tokens * mixing.rake(tokens, targets)
    for axis, target in enumerate(targets):
        assert np.allclose(fitted.sum(axis=tuple(i for i in range(3) if i != axis)) / fitted.sum(), target, atol=1e-6)


def test_mix(spark, docs):
    marginals = [mixing.Marginal("source", F.col("source"), {"a": 0.5, "b": 0.5}), mixing.Marginal("lang", F.col("lang"), {"en": 0.5})]
    rated = mixing.with_probabilities(docs, marginals, mixing.word_count(F.col("text")))
    assert all(0 <= r.mix_probability <= 1 for r in rated.collect()) and rated.count() == docs.count()
    kept = mixing.mix(docs, marginals, mixing.word_count(F.col("text")))
    assert kept.columns == docs.columns and kept.collect() == mixing.mix(docs, marginals, mixing.word_count(F.col("text"))).collect()
    assert mixing.mix(empty(spark), marginals, mixing.word_count(F.col("text"))).count() == 0


def test_few_unnamed_rows_leave_the_mixture(spark):
    sources, langs = {f"s{i}": 0.1 for i in range(9)}, {"en": 0.5, "de": 0.3, "fr": 0.16}
    marginals = [mixing.Marginal("source", F.col("source"), sources), mixing.Marginal("lang", F.col("lang"), langs)]
    rows = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 9).alias("source"), F.element_at(F.array(*map(F.lit, langs)), (F.col("id") % 7 % 3 + 1).cast("int")).alias("lang"), F.lit(100).alias("n"))
    odd = spark.createDataFrame([(9000, None, "fr", 1), (9001, "new", "en", 100), (9002, "s1", None, 100), (9003, "s2", "xx", 1), (9004, None, None, 1)], "doc_id long, source string, lang string, n int")

    def kept(docs):
        rated = mixing.with_probabilities(docs, marginals, F.col("n"))
        return {r.doc_id: r.mix_probability for r in rated.collect()}

    before, one, more = kept(rows), kept(rows.union(odd.limit(1))), kept(rows.union(odd))
    assert sum(one.values()) > 0.99 * sum(before.values()) and sum(more.values()) > 0.99 * sum(before.values())
    lang_of = {r.doc_id: r.lang for r in rows.collect()}
    shares = {v: sum(p for d, p in more.items() if lang_of.get(d) == v) / sum(more.values()) for v in langs}
    assert all(shares[v] == pytest.approx(langs[v] / 0.96, abs=0.002) for v in langs)
    # Many unnamed rows still get no more than what is left.
    many = kept(rows.union(rows.select(F.col("doc_id") + 20000, F.lit("new"), "lang", "n")))
    assert sum(p for d, p in many.items() if d >= 20000) / sum(many.values()) == pytest.approx(0.1, abs=1e-6)


# 7 class model


def test_class_model(spark, docs):
    fold = fold_of(F.col("doc_id"), 7)
    model, counts = classlm.train(docs.filter(fold != 2), words=40, classes=6, rounds=2)
    seen = {}
    for r in docs.filter(fold != 2).collect():
        for w in [*word_list(r.text), classlm.END]:
            seen[w] = seen.get(w, 0) + 1
    n, v = sum(seen.values()), len(seen)
    assert (model.train_tokens, model.distinct) == (n, v)
    out = classlm.score(docs, model, counts).collect()
    assert len(out) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in out:
        words = [*word_list(texts[r.doc_id]), classlm.END]
        assert r.n_tokens == len(words) and r.n_known == sum(w in seen for w in words)
        assert r.base_score == pytest.approx(sum(math.log10((seen.get(w, 0) + 1) / (n + v + 1)) for w in words))
        assert r.score < 0
    mass = 1 / 10**model.emission_base
    for w, c in seen.items():
        k = model.own[model.vocabulary.of([w])[0]]
        mass[k] += (c + 1) / 10 ** model.emission_base[k]
    assert np.allclose(mass, 1) and np.allclose((10**model.transition).sum(axis=1), 1)
    nothing, none = classlm.train(empty(spark), words=40, classes=6, rounds=1)
    assert {r.n_known for r in classlm.score(docs, nothing, none).collect()} == {0}
    assert classlm.score(empty(spark), model, counts).count() == 0


def test_words_of_many_texts():
    rng = random.Random(5)
    letters = ["a", "B", "Z", " ", " ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x85", "\xa0", "É", "é", "😀", "\x00", "."]
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 30]))) for _ in range(400)]
    cut = pa.array(texts, pa.string()).slice(7).cast(pa.large_string())
    words, at = classlm._words(cut)
    every = words.to_pylist()
    assert [every[i] for i in at] == [w for t in texts[7:] for w in [*word_list(t), classlm.END]]
    assert classlm.ending_units(words).tolist() == [classlm.ending_unit(w) for w in every]
    vocabulary = classlm.Vocabulary({w: classlm.ENDINGS + i for i, w in enumerate(every[:9])}, None)
    assert vocabulary.of(words).tolist() == [vocabulary.units.get(w, classlm.ending_unit(w)) for w in every]
    batch = pa.RecordBatch.from_arrays([pa.array([None, *texts])], ["text"])
    for size in (1, 40, 10_000):
        runs = list(classlm._runs([batch, batch.slice(3), batch], size))
        assert [t for r in runs for t in r.to_pylist()] == ["", *texts, *texts[2:], "", *texts]
        assert all(pc.sum(pc.binary_length(r)).as_py() <= size or sum(map(bool, r.to_pylist())) == 1 for r in runs)


def test_scores_do_not_depend_on_the_batch(spark):
    rows = [(i, _text(i, 1 + i % 7)) for i in range(1300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    model, counts = classlm.train(docs, words=10, classes=6, rounds=1)
    got = {r.doc_id: r for r in classlm.score(docs, model, counts).collect()}
    seen = Counter(w for _, t in rows for w in [*word_list(t), classlm.END])
    total = math.log10(model.train_tokens + model.distinct + 1)
    for i, t in rows:
        words = [*word_list(t), classlm.END]
        assert (got[i].n_tokens, got[i].n_known) == (len(words), len(words))
        assert got[i].base_score == pytest.approx(sum(math.log10(seen[w] + 1) - total for w in words))


# 8 language


def test_languages(spark, docs):
    rows = [(1000 + i, " ".join(random.Random(i).choice(words) for _ in range(30)), lang, "a", "x", 1) for i in range(60) for lang, words in [[("en", ["the", "and", "with", "thing"]), ("de", ["und", "schön", "über", "nicht"]), ("fr", ["été", "avec", "leçon", "vous"])][i % 3]]]
    train = spark.createDataFrame(rows, DOCS)
    model = langid.train_languages(train)
    out = {r.doc_id: r for r in langid.identify(train.union(docs), model).collect()}
    assert all(out[r[0]].lang_pred == r[2] and out[r[0]].score > 0.5 for r in rows)
    assert {out[i].lang_pred for i in (1, 2, 3, 9)} == {"und"} and out[1].score == 0
    kept = langid.keep_identified(train.union(docs), model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {r[0] for r in rows} and not {1, 2, 3, 9} & {r.doc_id for r in kept.collect()}
    nothing = langid.train_languages(empty(spark))
    assert nothing is None and {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(empty(spark), model).count() == 0


# 9 near-duplicates


def _shingles(text):
    w = word_list(text)
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_duplicates_equal_brute_force(spark, docs):
    rng, rows = random.Random(9), []
    for g in range(6):
        base = _text(100 + g, 120).split()
        for c in range(12):
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            rows.append((1000 + 20 * g + c, " ".join(words), "en", "a", "x", 1))
    every = docs.union(spark.createDataFrame(rows, DOCS))
    texts = {r.doc_id: _shingles(r.text) for r in every.collect() if r.doc_id is not None}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in texts:
        for b in texts:
            same = len(texts[a] & texts[b])
            if a < b and texts[a] and texts[b] and 100 * same >= 75 * (len(texts[a]) + len(texts[b]) - same):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = neardup.near_duplicates(every).collect()
    assert len(got) == every.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(texts[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert neardup.near_duplicates(empty(spark)).count() == 0
    kept = neardup.keep_one_of_each(docs)
    assert kept.columns == docs.columns and 7 not in {r.doc_id for r in kept.collect()}


# 10 decontamination


def test_leaks_equal_brute_force(spark, docs):
    items = {1: _text(50, 30), 2: _text(51, 12), 3: "three short words", 4: None, 5: ""}
    changed = items[1].split()
    changed[15] = "other"
    rows = [
        (100, _text(60, 20) + " " + items[1] + " " + _text(61, 9), "en", "a", "x", 1), (101, _text(62) + " " + items[2].upper(), "en", "a", "x", 1), (102, " ".join(changed), "en", "a", "x", 1),
        (103, " ".join(changed[:15]), "en", "a", "x", 1), (104, "Three short WORDS", "en", "a", "x", 1), (105, (items[2] + " ") * 40, "en", "a", "x", 1),
    ]
    every = docs.union(spark.createDataFrame(rows, DOCS))
    bench = spark.createDataFrame([*items.items(), (1, items[1]), (None, items[1])], "item_id long, text string")

    def grams(words):
        return [tuple(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] * bool(words)

    want = set()
    for r in every.collect():
        d = grams((r.text or "").lower().split())
        for item, text in items.items():
            g = grams((text or "").lower().split())
            for s in range(len(d) - len(g) + 1) if g and r.doc_id is not None else []:
                window = d[s : s + len(g)]
                same = sum(min(window.count(x), g.count(x)) for x in set(window))
                if 100 * same >= 75 * (2 * len(g) - same):
                    want.add((r.doc_id, item))
    found = decontam.leaks(every, bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want and {100, 101, 104, 105} <= {d for d, _ in want}
    clean = decontam.keep_clean(every, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in every.collect()} - {d for d, _ in want}
    assert decontam.leaks(empty(spark), bench).count() == 0 and decontam.leaks(docs, bench.limit(0)).count() == 0


def test_documents_shorter_than_an_item_leak(spark):
    item = [f"x{i}" for i in range(40)]
    changed = [*item[:37]]
    changed[18] = "other"
    texts = {
        1: item[:38], 2: item[2:], 3: item[:31], 4: item[:30], 5: changed, 6: item[1:10], 7: ["x1"], 8: [*item[:20], *item[:18]],
        9: [*item[:39], "y", "z"], 10: ["a1", "a2", "a3", "a4", "a5", "a6"], 11: ["a1", "a2", "a3", "a4"], 12: [f"a{i}" for i in range(2, 9)],
    }
    rows = [(d, " ".join(words)) for d, words in texts.items()] + [(4, " ".join(item[:38])), (1, " ".join(item[:38]))]
    items = {1: item, 2: [f"a{i}" for i in range(1, 9)]}

    def grams(words):
        return [tuple(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] * bool(words)

    want = {}
    for d, text in rows:
        for k, words in items.items():
            g, own = grams(words), grams(text.split())
            for s in range(max(1, len(own) - len(g) + 1)):
                window = own[s : s + len(g)]
                same = sum(min(window.count(x), g.count(x)) for x in set(window))
                if 100 * same >= 75 * (len(g) + len(window) - same):
                    want[d, k] = max(want.get((d, k), (0,)), (same, -s, len(window), same / (len(g) + len(window) - same)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(words)) for k, words in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (-r.start, r.n_shingles, r.similarity) for r in decontam.leaks(docs, bench).collect()}
    assert got == {k: v[1:] for k, v in want.items()} and {1, 2, 3, 4, 9, 12} == {d for d, _ in want}
    assert {r.doc_id for r in decontam.keep_clean(docs, bench).collect()} == set(texts) - {d for d, _ in want}
