"""URL filter: a bit-parallel wildcard automaton over canonical URLs.

All globs are laid side by side in one bit string of 64-bit words. For each byte of a URL the state of every glob moves on by
one shift and one mask (Shift-And); a ``*`` keeps its bit set. The star before a subdomain keeps it up to the first ``/`` only, which
is where the path begins. A batch of URLs advances together, so one numpy step moves
all globs of all URLs by one byte.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STAR = -1
#: Any bytes but ``/``.
HOST_STAR = -2


@dataclass(frozen=True)
class HostRule:
    """``host`` and all its subdomains, for paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> list[list[int]]:
        tail = list((self.host + self.path).encode())
        return [[*tail, STAR], [HOST_STAR, ord("."), *tail, STAR]]


@dataclass(frozen=True)
class GlobRule:
    """A glob over host and path; ``*`` stands for any bytes. Used where no host rule fits."""

    glob: str
    verdict: str

    def globs(self) -> list[list[int]]:
        return [[STAR if c == ord("*") else c for c in self.glob.encode()]]


class Automaton:
    """Masks of a list of globs (lists of bytes, ``STAR`` and ``HOST_STAR``) in words of 64 bits."""

    def __init__(self, globs: list[list[int]]):
        starts, ends, loops, host_loops, moves, at = [], [], [], [], [], 0
        for glob in globs:
            starts.append(at)
            for c in glob:
                if c == STAR:
                    loops.append(at)
                elif c == HOST_STAR:
                    host_loops.append(at)
                else:
                    at += 1
                    moves.append((c, at))
            ends.append(at)
            at += 1
        self.words = max(1, -(-at // 64))
        self.ends = np.array(ends, dtype=np.int64)
        self.start = self._mask(starts)
        self.loop = np.repeat(self._mask([*loops, *host_loops])[None, :], 256, axis=0)
        self.loop[ord("/")] = self._mask(loops)
        self.step = np.zeros((256, self.words), dtype=np.uint64)
        for c, bit in moves:
            self.step[c, bit >> 6] |= np.uint64(1) << np.uint64(bit & 63)

    def _mask(self, bits: list[int]) -> np.ndarray:
        mask = np.zeros(self.words, dtype=np.uint64)
        for bit in bits:
            mask[bit >> 6] |= np.uint64(1) << np.uint64(bit & 63)
        return mask

    def accepted(self, texts: list[bytes], lanes: int = 4096) -> Iterator[tuple[int, np.ndarray]]:
        """``(index of a text, matching globs)`` for each text. Lanes of similar length advance together; memory is bounded by
        ``lanes`` times the words of the automaton and by the bytes of the lanes."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        lanes = max(16, min(lanes, (1 << 22) // self.words))
        one, top = np.uint64(1), np.uint64(63)
        for first in range(0, len(order), lanes):
            own = order[first : first + lanes]
            sizes = np.array([len(texts[i]) for i in own])
            text = np.frombuffer(b"".join(texts[i] for i in own), dtype=np.uint8)
            begin = np.cumsum(sizes) - sizes
            state = np.repeat(self.start[None, :], len(own), axis=0)
            alive = len(own)
            for position in range(int(sizes[0]) if len(own) else 0):
                while alive and sizes[alive - 1] <= position:
                    alive -= 1
                now = state[:alive]
                moved = now << one
                moved[:, 1:] |= now[:, :-1] >> top
                byte = text[begin[:alive] + position]
                moved &= self.step[byte]
                state[:alive] = moved | (now & self.loop[byte])
            hit = (state[:, self.ends >> 6] >> (self.ends & 63).astype(np.uint64)) & one
            for lane, i in enumerate(own):
                yield int(i), np.flatnonzero(hit[lane])


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty if there is none."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, letters, letters.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end; empty if there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(
    pages: DataFrame,
    host_rules: list[HostRule],
    glob_rules: list[GlobRule],
    url: str = "url",
    default: str = "allow",
) -> DataFrame:
    """Adds ``host``, ``path``, ``rule``, ``glob`` and ``verdict`` to every row; columns of these names are replaced.

    The longest fitting host rule decides (``rule`` names it; of equally long ones the smaller name). Where none fits, ``rule`` is
    null and the longest fitting glob decides (``glob`` names it), else ``default``. Null URLs and URLs without ``://`` have an
    empty host and path, so only a glob that accepts the empty string can decide them. No row is dropped.
    """
    rules = sorted(set(host_rules), key=lambda r: (len(r.name.encode()), *(-b for b in r.name.encode())))
    globs = sorted(set(glob_rules), key=lambda r: (len(r.glob.encode()), *(-b for b in r.glob.encode())))
    ranked = [*globs, *rules]  # a later one outranks an earlier one
    patterns = [(rank, glob) for rank, rule in enumerate(ranked) for glob in rule.globs()]
    rank_of = np.array([rank for rank, _ in patterns], dtype=np.int64)
    automaton = Automaton([glob for _, glob in patterns])

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            winners: list[int | None] = [None] * len(hosts)
            for i, hits in automaton.accepted([(h + p).encode("utf-8", "surrogatepass") for h, p in zip(hosts, paths)]):
                if len(hits):
                    winners[i] = int(rank_of[hits].max())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(winners, pa.int32())], [*batch.schema.names, "__winner"])

    located = pages.drop("host", "path", "rule", "glob", "verdict", "__winner").select("*", host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    schema = T.StructType([*located.schema.fields, T.StructField("__winner", T.IntegerType())])
    judged = located.mapInArrow(best, schema) if patterns else located.withColumn("__winner", F.lit(None).cast("int"))

    def named(values: list[str | None]) -> Column:
        if not values:
            return F.lit(None).cast("string")
        return F.get(F.array(*[F.lit(v).cast("string") for v in values]), F.col("__winner"))

    return judged.select(
        *[c for c in located.columns],
        named([r.name if isinstance(r, HostRule) else None for r in ranked]).alias("rule"),
        named([r.glob if isinstance(r, GlobRule) else None for r in ranked]).alias("glob"),
        F.coalesce(named([r.verdict for r in ranked]), F.lit(default)).alias("verdict"),
    )
