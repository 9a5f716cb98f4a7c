"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit a binary classifier over hashed letter n-grams says on which side the text is.
Decoding sums, for each codeword, the logistic loss of the bit margins, weighted by how reliable each bit proved in
training, and takes the nearest codeword; a runner-up that is almost as near flags the text as ambiguous.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import bounded_rows, start_afresh

UNDETERMINED = "und"
BINS = 4096
#: Letters counted at a time, so that a very long text needs no more memory than this.
CHUNK = 1 << 18


def letters_of(text: str | None) -> str:
    """The text in lower case with every run of other characters as one blank; empty if there is no letter."""
    if text is None:
        return ""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) if not text.isascii() else _ascii_letters(text)


_ASCII = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(256))


def _ascii_letters(text: str) -> str:
    return " ".join(text.encode().translate(_ASCII).decode("ascii").split())


def ngram_counts(text: str) -> np.ndarray:
    """Hashed counts of the 1- to 3-grams of a text of letters and single blanks."""
    counts = np.zeros(BINS)
    codes = np.frombuffer((" " + text + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for first in range(0, len(codes) - 2, CHUNK):
        part = codes[first : first + CHUNK + 2]
        a, b, c = part[:-2], part[1:-1], part[2:]
        pair = b * np.uint32(2654435761) + c * np.uint32(40503)
        for grams in (c * np.uint32(2246822519) + np.uint32(7), pair, pair * np.uint32(31) + a * np.uint32(3266489917)):
            mixed = (grams ^ (grams >> np.uint32(15))) * np.uint32(2246822507)
            counts += np.bincount((mixed >> np.uint32(20)).astype(np.int64), minlength=BINS)
    return counts


def text_profile(text: str | None) -> np.ndarray | None:
    """Square roots of the n-gram shares (a vector of length 1); null if the text is null or has no letter."""
    letters = letters_of(text)
    if not letters:
        return None
    counts = ngram_counts(letters)
    return np.sqrt(counts / counts.sum()).astype(np.float32)


def codewords(languages: int, extra: int = 15, seed: int = 11) -> np.ndarray:
    """Rows of +1 / -1: one codeword per language, no constant bit, chosen among seeded draws for the largest least distance."""
    if languages < 2:
        return np.ones((languages, 1), dtype=np.int8)
    bits = extra + 2 * int(np.ceil(np.log2(languages)))
    rng, best, reach = np.random.default_rng(seed), None, -1
    for _ in range(200):
        draw = rng.integers(0, 2, (languages, bits), dtype=np.int8) * 2 - 1
        for b in np.flatnonzero(np.abs(draw.sum(axis=0)) == languages):
            draw[rng.integers(languages), b] *= -1
        gaps = draw.astype(np.int32) @ draw.T.astype(np.int32)
        least = int((bits - gaps[~np.eye(languages, dtype=bool)]).min()) // 2
        if least > reach:
            best, reach = draw, least
    return best


@dataclass(frozen=True)
class CodeModel:
    """Languages in order, their codewords, one linear classifier per bit and the weight of each bit."""

    languages: list[str]
    code: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, profiles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(index of the nearest codeword, its share of the soft decision, margin to the runner-up)`` per row."""
        margin = profiles @ self.weight + self.bias
        loss = np.stack([(np.logaddexp(0, -margin * word) * self.trust).sum(axis=1) for word in self.code], axis=1)
        best = loss.argmin(axis=1)
        soft = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * (4 / self.code.shape[1]))
        soft = soft / soft.sum(axis=1, keepdims=True)
        ranked = np.sort(soft, axis=1)
        runner = ranked[:, -2] if soft.shape[1] > 1 else np.zeros(len(soft))
        return best, ranked[:, -1], ranked[:, -1] - runner


def fit_codes(profiles: np.ndarray, language: list[str], rounds: int = 120) -> CodeModel | None:
    """One logistic classifier per bit by gradient descent with momentum; a bit is trusted by its training accuracy."""
    names = sorted(set(language))
    if not names:
        return None
    code = codewords(len(names))
    y = code[np.searchsorted(names, language)].astype(np.float32)
    share = np.array([language.count(n) for n in names], dtype=np.float32)
    row_weight = (1 / share)[np.searchsorted(names, language)][:, None] / len(names)  # languages count alike
    weight, bias = np.zeros((profiles.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    speed, tilt = np.zeros_like(weight), np.zeros_like(bias)
    for _ in range(rounds):
        pull = -y / (1 + np.exp(np.clip(y * (profiles @ weight + bias), -60, 60))) * row_weight
        speed, tilt = 0.9 * speed - 2.0 * (profiles.T @ pull + 1e-5 * weight), 0.9 * tilt - 2.0 * pull.sum(axis=0)
        weight, bias = weight + speed, bias + tilt
    right = ((profiles @ weight + bias) * y > 0).astype(np.float64)
    accuracy = np.clip((right * row_weight).sum(axis=0), 0.5, 0.9999)
    trust = np.log(accuracy / (1 - accuracy)) if len(names) > 1 else np.ones(code.shape[1])
    return CodeModel(names, code, weight, bias, trust / max(trust.mean(), 1e-9))


def train_languages(docs: DataFrame, sample_rows: int = 4_000) -> CodeModel | None:
    """A model from the text and ``lang`` of at most ``sample_rows`` rows (a documented bound; those of lowest id hash).

    Rows without a language, or whose text has no letter, teach nothing; with nothing to learn from the model is None. Of rows that
    share an id one teaches, the first by language and text.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    wanted = bounded_rows(known.select("doc_id").distinct(), "doc_id", sample_rows)

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_afresh()
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                found = [text_profile(t) for t in part.column("text").to_pylist()]
                packed = [None if x is None else x.tobytes() for x in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(packed, pa.binary())], ["doc_id", "lang", "profile"])

    sampled = known.select("doc_id", "lang", "text").join(F.broadcast(wanted), "doc_id")
    found = sampled.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("row")).select("doc_id", "row.lang", "row.text")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [batch.to_pydict() for batch in batches]
        rows = sorted(row for part in got for row in zip(part["doc_id"], part["lang"], part["profile"]))
        model = fit_codes(np.frombuffer(b"".join(r[2] for r in rows), dtype=np.float32).reshape(-1, BINS), [r[1] for r in rows])
        parts = model and (model.languages, model.code, model.weight, model.bias, model.trust)
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(parts)], pa.binary())})

    taught = found.mapInArrow(profiles, "doc_id long, lang string, profile binary").filter("profile is not null")
    # The sample is bounded, so one task fits the model; only the model reaches the driver.
    found = taught.repartition(1).mapInArrow(fitted, "model binary").collect()
    parts = pickle.loads(found[0]["model"]) if found else None
    return CodeModel(*parts) if parts else None


def identify(docs: DataFrame, model: CodeModel | None, least_margin: float = 0.2) -> DataFrame:
    """Every row of ``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``; columns of these names are replaced.

    ``und`` with score 0 if the text is null or has no letter, or nothing was learnt. ``ambiguous`` marks texts whose two nearest
    languages differ by less than ``least_margin`` in score. Whole texts are read.
    """
    base = docs.drop("lang_pred", "score", "ambiguous")
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_afresh()
        model = shipped.value
        # A few texts at a time, also on the way back: batches of whole texts would fill the memory of task and executor.
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                found = [None if model is None else text_profile(t) for t in part.column("text").to_pylist()]
                known = [x for x in found if x is not None]
                decoded = iter(zip(*(x.tolist() for x in model.decode(np.stack(known))))) if known else iter(())
                names: list[str] = []
                scores: list[float] = []
                unsure: list[bool] = []
                for x in found:
                    best, score, margin = (None, 0.0, 1.0) if x is None else next(decoded)
                    names.append(UNDETERMINED if best is None else model.languages[best])
                    scores.append(float(score))
                    unsure.append(margin < least_margin)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_())], [*part.schema.names, "lang_pred", "score", "ambiguous"])

    return base.mapInArrow(judge, T.StructType([*base.schema.fields, *added]))


def keep_identified(docs: DataFrame, model: CodeModel | None) -> DataFrame:
    """The documents whose language is determined; undetermined and ambiguous ones are rejected. Same columns, whatever their names.

    Without a model, as when no document names its language, nothing can be judged and every document stays.
    """
    if model is None:
        return docs
    others = [c for c in docs.columns if c != "text"]
    packed = docs.select("text", F.struct(F.lit(1).alias("row"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("others"))
    judged = identify(packed, model).filter((F.col("lang_pred") != UNDETERMINED) & ~F.col("ambiguous"))
    return judged.select(*[F.col("text") if c == "text" else F.col("others")[f"c{others.index(c)}"].alias(c) for c in docs.columns])
