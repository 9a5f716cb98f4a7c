"""Alignment of two tokenizers against plain loops over the token bytes."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from larkspur.llm import align  # noqa: E402

A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, run string, n int"


class Plain:
    """The contract, token by token."""

    def __init__(self):
        self.a, self.b = tokenizers.Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        letters = align.byte_letters()
        self.a_bytes = lambda i: bytes(letters[c] for c in self.a.id_to_token(i))
        self.b_bytes = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()

    def document(self, text):
        """(a ids, b ids, groups as text, links)"""
        if not text:
            return [], [], "", []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        a_raw, b_raw = [self.a_bytes(i) for i in a], [self.b_bytes(i) for i in b]
        if not b"".join(a_raw) == b"".join(b_raw) == (" " + text).encode():
            return [], [], "", []
        spans = []
        for raw in (a_raw, b_raw):
            ends = np.cumsum([len(x) for x in raw]).tolist()
            spans.append([(e - len(x), e) for x, e in zip(raw, ends)])
        links = [(a[i], b[j]) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if s < f and t < e]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, start = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, side) if start <= s and e <= cut) for ids, side in zip((a, b), spans)))
            start = cut
        return a, b, ";".join(groups), links


def _expected(rows):
    plain = Plain()
    docs = [(doc_id, *plain.document(text)) for doc_id, text in rows]
    counts = Counter(x for *_, links in docs for x in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for doc_id, a, b, groups, links in docs:
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        out.append((doc_id, len(a), len(b), groups.count(";") + 1 if groups else 0, len(links), digest, sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links)))
    return sorted(out, key=repr), {x: (n, n == best[x[1]]) for x, n in counts.items()}


ODD = [
    None, "", " ", "  two  blanks ", "\n\tx\r\n y\n", "end <|endoftext|> <s> </s> <unk> <0x41>", "a▁b ▁ c", "naïve ﬁnd é é Ärger 北京 日本語 \U0001f600", "x y 　 z w \x1c v", "it's we'll 3.14,15 don't",
    "\x00 nul", "word" * 300, "aaaa bbbb", "aaaa bbbb", "((())) -- ... !!! $100,000.00",
]


def _rows():
    rng = random.Random(3)
    words = ["the", "The", "tokenizer", "überaus", "naïveté", "x1", "don't", "state-of-the-art", "1234567", "ﬁ", "日本", "\n", "", "antidisestablishmentarianism"]
    return [(i, t) for i, t in enumerate(ODD)] + [(None, "no id at all"), (3, "an id twice")] + [(50 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(150)]


def test_documents_by_brute_force(spark):
    docs = spark.createDataFrame([(d, t, "r", 1) for d, t in _rows()], SCHEMA).repartition(5)
    want, counts = _expected(_rows())
    for fan_in in (256, 2):
        assert sorted(map(tuple, align.alignment(docs, A, B, fan_in).collect()), key=repr) == want
    got = {(r.a_id, r.b_id): (r.n, r.is_best) for r in align.pair_counts(docs, A, B).collect()}
    assert got == counts


def test_groups(spark):
    plain = Plain()
    got = align.aligned_groups(spark.createDataFrame([(d, t, "r", 1) for d, t in _rows()], SCHEMA), A, B)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((d, plain.document(t)[2]) for d, t in _rows()), key=repr)


def test_pieces_are_forgotten_and_split_into_runs(spark, monkeypatch):
    """Small bounds: many runs, more than one merge round, and a worker that forgets its pieces."""
    aligner = align.PieceAligner(open(A, encoding="utf-8").read(), open(B, "rb").read())
    monkeypatch.setattr(align, "KNOWN_PIECES", 3)
    for d, t in _rows():
        (pieces,) = align._pieces_of(aligner, [t])
        assert ";".join(aligner.groups[i] for i in pieces.tolist()) == Plain().document(t)[2]


def test_heap_merge():
    rng = np.random.default_rng(1)
    runs, want = [], Counter()
    for _ in range(20):
        pairs = np.unique(rng.integers(0, 500, 80))
        n = rng.integers(1, 9, len(pairs))
        want.update(dict(zip(pairs.tolist(), n.tolist())))
        runs.append(align._packed(pairs, n, n))
    pairs, totals = align.heap_merged(runs)
    assert pairs.tolist() == sorted(want) and totals.tolist() == [want[p] for p in sorted(want)]


def test_one_pair_in_all_documents(spark):
    """A pair that holds nearly all links, in many runs: no document is lost and ties at the top all count."""
    docs = spark.createDataFrame([(i, "the " * 20 + ("a" if i % 2 else "b")) for i in range(2000)], "doc_id long, text string").repartition(40)
    got = align.alignment(docs, A, B, 4).collect()
    assert len(got) == 2000 and {r.n_best for r in got} == {r.n_links for r in got}


def test_empty_table(spark):
    assert align.alignment(spark.createDataFrame([], SCHEMA), A, B).count() == 0
