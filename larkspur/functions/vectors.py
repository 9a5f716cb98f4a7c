"""Vector functions: SQL expressions for norms and cosine, and the pluggable text encoder."""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# An encoder maps a batch of texts to a (len(texts), dim) array; rows need not be normalised.
Encoder = Callable[[list[str]], np.ndarray]

HASH_DIM = 64


def _doubles(v: Column | str) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def l2_norm(v: Column | str) -> Column:
    squares = F.aggregate(_doubles(v), F.lit(0.0), lambda acc, x: acc + x * x)
    return F.sqrt(squares)


def l2_normalise(v: Column | str) -> Column:
    """Unit vector as floats; a zero vector stays zero. The norm is computed once per row, in the finish step."""
    values = _doubles(v)
    return F.aggregate(
        values,
        F.lit(0.0),
        lambda acc, x: acc + x * x,
        lambda squares: F.transform(
            values, lambda x: F.when(squares == 0, F.lit(0.0)).otherwise(x / F.sqrt(squares)).cast("float")
        ),
    )


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity, 0 where a vector has no length."""
    dot = F.aggregate(
        F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x
    )
    length = l2_norm(a) * l2_norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot / length)


def _slot(token: str) -> int:
    return int(hashlib.md5(token.encode("utf-8"), usedforsecurity=False).hexdigest()[:8], 16) % HASH_DIM


class _Slots(dict):
    """Slots of the words met so far; a bounded memo."""

    def __missing__(self, token: str) -> int:
        slot = _slot(token)
        if len(self) < 200_000:
            self[token] = slot
        return slot


def _known_slots() -> _Slots:
    """The process keeps its memo from batch to batch."""
    shelf = sys.modules.setdefault("_larkspur_worker", types.ModuleType("_larkspur_worker"))
    return shelf.__dict__.setdefault("slots", _Slots())


def hash_encoder(texts: list[str]) -> np.ndarray:
    """Default encoder: counts of lower-cased words, hashed to ``HASH_DIM`` slots."""
    words = [text.lower().split() for text in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    slots = np.fromiter(map(_known_slots().__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
    cells = np.repeat(np.arange(len(texts), dtype=np.int64) * HASH_DIM, sizes) + slots
    return np.bincount(cells, minlength=len(texts) * HASH_DIM).reshape(len(texts), HASH_DIM).astype(np.float64)


def embed(text: Column | str, encoder: Encoder = hash_encoder, batch_size: int = 512) -> Column:
    """Unit vector (``array<float>``) of a text column; texts cross to Python workers in Arrow batches.

    Only the text crosses: the other columns of the row stay in the JVM.
    """

    def encode(column: pa.Array) -> pa.Array:
        texts = [t or "" for t in column.to_pylist()]
        blocks = []
        for start in range(0, len(texts), batch_size):
            block = np.asarray(encoder(texts[start:start + batch_size]), dtype=np.float64)
            norms = np.sqrt((block * block).sum(axis=1, keepdims=True))
            blocks.append((block / np.where(norms == 0, 1.0, norms)).astype(np.float32))
        if not blocks:
            return pa.array([], pa.list_(pa.float32()))
        matrix = np.concatenate(blocks)
        offsets = np.arange(len(texts) + 1, dtype=np.int32) * matrix.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))

    encode.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf("array<float>")(encode)(text)
