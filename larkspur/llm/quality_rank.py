"""Quality classifier learnt from pairwise preferences (Bradley-Terry).

A good document is preferred to a bad one with probability ``sigmoid(s(good) - s(bad))``, where ``s`` is linear in the features.
The logistic loss on feature differences is minimised over pairs of labelled documents; a cut at a quantile of the scores
turns the ranking into a decision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import bounded_rows

#: A document scores this at the cut: the decision threshold of the contract.
CUT_SCORE = 0.3
#: Per document: shares of byte classes, of words by form, of repeated words and lines, and lengths.
FEATURES = 24
_SYMBOLS = b"#$%&*|!~^=<>{}[]\\/@_+`"


def text_features(text: str | None) -> np.ndarray:
    """Features of one whole text, all within about 0 to 5. A null text is an empty one."""
    out = np.zeros(FEATURES)
    words = [] if text is None else text.encode("utf-8", "surrogatepass").split()
    if not words:
        out[0] = 1.0
        return out
    raw = np.frombuffer(b" ".join(words), dtype=np.uint8)
    counts = np.bincount(raw, minlength=256).astype(np.float64)
    total, n = counts.sum(), len(words)
    upper, lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    letters = upper + lower + counts[128:].sum()
    symbols = counts[list(_SYMBOLS)].sum()
    lines = [x for x in text.split("\n") if x.strip()]
    same = sum(a == b for a, b in zip(words, words[1:]))
    distinct, distinct_lines = len(set(words)), len(set(lines))
    trigrams = len(set(zip(words, words[1:], words[2:])))
    sizes = np.fromiter(map(len, words), np.int64, n)
    lowered = sum(1 for w in words if w.islower())
    rated = [
        upper / total, lower / total, digits / total, letters / total, symbols / total, counts[33] / n, counts[124] / n,
        (counts[46] + counts[44]) / n, counts[46] / n, same / n, 1 - distinct / n, 1 - trigrams / max(1, n - 2), 1 - distinct_lines / max(1, len(lines)),
        lowered / n, sizes.mean() / 20, sizes.std() / 20, sizes.max() / 200, symbols / n, digits / n, np.log1p(n) / 10, np.log1p(len(lines)) / 10,
        n / max(1, len(lines)) / 100, float(n < 20),
    ]
    out[1:] = np.minimum(rated, 5.0)
    return out


@dataclass(frozen=True)
class PreferenceModel:
    """Linear scores, standardised inputs, and the cut that maps to ``CUT_SCORE``."""

    mean: np.ndarray
    spread: np.ndarray
    weight: np.ndarray
    cut: float
    slope: float

    def raw(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.mean) / self.spread, -8, 8) @ self.weight

    def score(self, features: np.ndarray) -> np.ndarray:
        """0 to 1, rising with the preference score, ``CUT_SCORE`` at the cut."""
        z = self.slope * (self.raw(features) - self.cut) + np.log(CUT_SCORE / (1 - CUT_SCORE))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_preferences(features: np.ndarray, label: np.ndarray, rounds: int = 400, pairs: int = 20_000, seed: int = 7) -> PreferenceModel:
    """Bradley-Terry weights from pairs (label 1 preferred to label 0), drawn with a fixed seed.

    The cut is the quantile of the labelled scores at the share of label 0. With one label only, every document gets the same
    score: 1 if the label is 1 or nothing is labelled, else 0.
    """
    mean, spread = (features.mean(axis=0), features.std(axis=0) + 1e-6) if len(features) else (np.zeros(FEATURES), np.ones(FEATURES))
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return PreferenceModel(mean, spread, np.zeros(FEATURES), -1e3 if not len(bad) else 1e3, 1.0)
    x = np.clip((features - mean) / spread, -8, 8)
    rng = np.random.default_rng(seed)
    difference = x[rng.choice(good, pairs)] - x[rng.choice(bad, pairs)]
    weight, velocity = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(rounds):
        lost = 1 / (1 + np.exp(np.clip(difference @ weight, -500, 500)))  # probability of the wrong preference
        slope = -(lost @ difference) / pairs + 1e-3 * weight
        velocity = 0.9 * velocity - 0.3 * slope
        weight = weight + velocity
    scores = x @ weight
    ordered = np.sort(scores)
    at = int(np.clip(np.floor(len(ordered) * len(bad) / len(label)), 1, len(ordered) - 1))
    cut = float((ordered[at - 1] + ordered[at]) / 2)  # the quantile, halfway between its neighbours
    return PreferenceModel(mean, spread, weight, cut, 1.0)


def train_quality(docs: DataFrame, labels: DataFrame, label: str, sample_rows: int = 16_384) -> PreferenceModel:
    """A model from at most ``sample_rows`` labelled documents (a documented bound; those of lowest id hash).

    ``labels`` has ``doc_id`` and ``label`` (0 or 1; other values and nulls teach nothing; the higher of two labels of an id counts).
    Texts stay on the executors, which send one short feature row per sampled document; of rows that share an id one teaches,
    the first by text. Documents of equal features are ordered by id; without labelled documents all texts score alike.
    """
    wanted = bounded_rows(labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y")), "doc_id", sample_rows)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([text_features(t) for t in batch.column("text").to_pylist()]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    got = found.mapInArrow(features, "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(list(got["x"])).reshape(-1, FEATURES)
    return fit_preferences(x[np.lexsort((*x.T, got["doc_id"]))] if len(x) else x, got["y"].to_numpy())


def score_quality(docs: DataFrame, model: PreferenceModel) -> DataFrame:
    """Every row of ``docs`` with ``score`` (double, 0 to 1) and ``predicted`` (1 where the score is at least 0.3).

    Columns of these names are replaced, all others kept. Null texts score as empty ones; whole texts are read.
    """
    base = docs.drop("score")
    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType())])

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([text_features(t) for t in batch.column("text").to_pylist()]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x), pa.float64())], [*batch.schema.names, "score"])

    return base.mapInArrow(scores, schema).withColumn("predicted", decided(F.col("score")))


def decided(score: Column) -> Column:
    return (score >= CUT_SCORE).cast("int")
