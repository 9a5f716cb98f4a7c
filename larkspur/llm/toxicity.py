"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability of being toxic from its words; the document is toxic unless
every sentence is clean (noisy-or). Weights are learnt from document labels alone, and afterwards tell which sentences
made a document toxic.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from math import fsum

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import bounded_rows

_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*|[.!?]+")
_EDGES = "\"'()[]{}<>.,;:!?*#$%&|~-_"
#: Words of a language that compounds share their first letters.
_STEM = 4


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Start and end of each sentence that holds a word: runs up to a full stop, mark or line end."""
    return [] if text is None else [m.span() for m in _SENTENCE.finditer(text) if not m.group().isspace()]


def sentence_terms(sentence: str) -> set[str]:
    """Lower-cased words without marks at their ends, and the stems of longer words (marked by a trailing ``*``)."""
    words = {x.strip(_EDGES) for x in sentence.lower().split()}
    words.discard("")
    return words | {w[:_STEM] + "*" for w in words if len(w) > _STEM}


class _KnownTerms(dict):
    """Terms with a weight of each raw word met so far; a bounded memo, so that frequent words are taken apart once."""

    def __init__(self, weights: dict[str, float], room: int = 200_000):
        super().__init__()
        self.weights, self.room = weights, room

    def __missing__(self, raw: str) -> frozenset[str]:
        found = frozenset(t for t in sentence_terms(raw) if t in self.weights)
        if len(self) < self.room:
            self[raw] = found
        return found


@dataclass(frozen=True)
class SentenceModel:
    """Term weights and a bias; a term counts once in a sentence, unknown terms weigh nothing."""

    weights: dict[str, float]
    bias: float

    @cached_property
    def _known(self) -> _KnownTerms:
        return _KnownTerms(self.weights)

    def sentence_scores(self, text: str | None) -> tuple[list[tuple[int, int]], np.ndarray]:
        spans, known, weights = sentences(text), self._known, self.weights
        z = []
        for a, b in spans:
            found = set().union(*filter(None, map(known.__getitem__, text[a:b].lower().split())))
            z.append(fsum([weights[t] for t in found]) if found else 0.0)
        return spans, 1 / (1 + np.exp(-np.clip(np.array(z) + self.bias, -60, 60)))

    def document(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Noisy-or of the sentence scores, and the spans that score at least a half."""
        spans, p = self.sentence_scores(text)
        score = float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) if len(p) else 0.0
        return score, [(a, b, float(q)) for (a, b), q in zip(spans, p) if q >= 0.5]


def fit_sentences(texts: list[str | None], label: np.ndarray, min_documents: int = 5, rounds: int = 200, vocabulary: int = 50_000, pace: float = 0.1, sparing: float = 2e-4) -> SentenceModel:
    """Gradient descent (Adam) on the log loss of the noisy-or, with an absolute penalty (``sparing``) that keeps most weights 0.

    Terms in fewer than ``min_documents`` texts teach nothing. With one label only, every document scores about 0.
    """
    bags = [[sorted(sentence_terms(t[a:b])) for a, b in sentences(t)] for t in texts]
    seen = Counter(w for bag in bags for w in {w for s in bag for w in s})
    kept = sorted((w for w, n in seen.items() if n >= min_documents), key=lambda w: (-seen[w], w))[:vocabulary]
    index = {w: i for i, w in enumerate(kept)}
    word, sentence, document = [], [], []
    for d, bag in enumerate(bags):
        for s in bag:
            found = [index[w] for w in s if w in index]
            word += found
            sentence += [len(document)] * len(found)
            document.append(d)
    if not document or label.min() == label.max():
        return SentenceModel({}, -40.0)
    word, sentence, document = np.array(word, np.int64), np.array(sentence, np.int64), np.array(document, np.int64)
    share = label.mean()
    weight, bias = np.zeros(len(kept)), float(np.log(share / (1 - share)) - np.log(len(document) / len(bags)))
    state = [np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)]
    for step in range(1, rounds + 1):
        z = np.bincount(sentence, weight[word], len(document)) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        clean = np.exp(np.bincount(document, np.log1p(-np.minimum(p, 1 - 1e-9)), len(bags)))
        whole = np.clip(1 - clean, 1e-9, 1.0)
        # Slope of the log loss by a sentence's logit: p where the document is clean, -p * clean / whole where it is toxic.
        pull = np.where(label[document] == 1, -clean[document] / whole[document], 1.0) * p / len(bags)
        slope = np.append(np.bincount(word, pull[sentence], len(kept)), pull.sum())
        state[0], state[1] = 0.9 * state[0] + 0.1 * slope, 0.999 * state[1] + 0.001 * slope**2
        move = pace * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-9)
        scale = pace / (np.sqrt(state[1][:-1] / (1 - 0.999**step)) + 1e-9)
        weight, bias = weight - move[:-1], bias - move[-1]
        weight = np.sign(weight) * np.maximum(np.abs(weight) - sparing * scale, 0.0)
    return SentenceModel({w: float(weight[i]) for w, i in index.items() if weight[i]}, float(bias))


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str, sample_rows: int = 4_096, sample_bytes: int = 1 << 26) -> SentenceModel:
    """A model from at most ``sample_rows`` labelled documents, half of them of each label where there are enough.

    The documents of lowest id hash are taken, as long as their texts together keep to ``sample_bytes``; of each, all sentences
    count. These bounds and the vocabulary bound are documented parameters. Null or other labels teach nothing; the higher of
    two labels of an id counts, and of rows that share an id one teaches, the first by text.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    wanted = bounded_rows(known.filter("y = 1"), "doc_id", sample_rows // 2).unionByName(bounded_rows(known.filter("y = 0"), "doc_id", sample_rows // 2))
    sampled = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    # The window orders the bounded sample only, by its sizes.
    sizes = sampled.select("doc_id", F.octet_length("text").alias("bytes"))
    summed = sizes.withColumn("all_bytes", F.sum("bytes").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")))
    fitting = summed.filter(F.col("all_bytes") <= sample_bytes).select("doc_id")
    got = sampled.join(F.broadcast(fitting), "doc_id").select("doc_id", "y", "text").toPandas().sort_values(["doc_id", "text"], kind="stable")
    return fit_sentences(got["text"].tolist(), got["y"].to_numpy())


def score_toxicity(docs: DataFrame, model: SentenceModel) -> DataFrame:
    """Every row of ``docs`` with ``score`` (double, 0 to 1), ``predicted`` (1 where it is at least 0.3) and ``offending``.

    ``offending`` lists start, end (characters) and score of the sentences that are toxic by themselves. Columns of these names are
    replaced. Null and empty texts score 0 and have no offending sentence.
    """
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
    base = docs.drop("score", "offending", "predicted")
    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("offending", spans)])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [shipped.value.document(t) for t in batch.column("text").to_pylist()]
            found = [[{"start": a, "end": b, "score": p} for a, b, p in spans] for _, spans in done]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s for s, _ in done], pa.float64()), pa.array(found, span_type)], [*batch.schema.names, "score", "offending"])

    return base.mapInArrow(scores, schema).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
