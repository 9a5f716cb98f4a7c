"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed per cell (source, language, topic). Raking scales the cells until the token shares of every marginal meet
their targets; the factor of a cell, divided by the largest one, is the probability with which its documents are drawn. Cells that
hold next to nothing of the mixture do not count as the largest one, so that a handful of rows can't thin out all others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER = "other"
#: Share of the mixture's tokens that may be missed, so that cells of a few rows do not set the scale of the draw.
SLACK = 0.001


@dataclass(frozen=True)
class Marginal:
    """Target shares of the named values of ``column``; all further values and nulls are ``other`` and get what is left, but no more
    than they have. A share stated for ``other`` itself counts like that of a name."""

    name: str
    column: Column
    shares: dict[str, float]

    def cell(self) -> Column:
        return F.when(self.column.isin(*self.shares), self.column).otherwise(F.lit(OTHER)) if self.shares else F.lit(OTHER)

    def values(self) -> list[str]:
        return [*sorted(v for v in self.shares if v != OTHER), OTHER]

    def targets(self, tokens: np.ndarray) -> np.ndarray:
        """Targets of ``values`` that hold ``tokens``. What ``other`` lacks is spread over the names in proportion to their shares."""
        given = np.array([self.shares.get(v, 0.0) for v in self.values()])
        if OTHER in self.shares:
            return given
        left, named = max(0.0, 1.0 - given.sum()), given.sum()
        given[-1] = min(left, tokens[-1] / max(tokens.sum(), 1.0))
        given[:-1] *= (1.0 - given[-1]) / named if named > 0 else 1.0
        return given


def rake(tokens: np.ndarray, targets: list[np.ndarray], rounds: int = 500, tolerance: float = 1e-9) -> np.ndarray:
    """Factors per cell so that the scaled tokens have the target shares along every axis.

    Targets of values without tokens are spread over the others in proportion; a target of 0 empties its cells. If the targets
    can't all hold at once, the last rounds' average of the axes stands. Cells without tokens have factor 0.
    """
    if tokens.sum() <= 0:
        return np.zeros(tokens.shape)
    fitted = tokens / tokens.sum()
    for _ in range(rounds):
        worst = 0.0
        for axis, target in enumerate(targets):
            others = tuple(i for i in range(tokens.ndim) if i != axis)
            now = fitted.sum(axis=others)
            wanted = np.where(now > 0, target, 0.0)
            if wanted.sum() <= 0:
                continue
            wanted = wanted / wanted.sum()
            worst = max(worst, float(np.abs(now / now.sum() - wanted).max()))
            factor = np.divide(wanted, now, out=np.zeros_like(now), where=now > 0)
            fitted = fitted * factor.reshape([-1 if i == axis else 1 for i in range(tokens.ndim)])
        if worst < tolerance:
            break
    return np.divide(fitted, tokens, out=np.zeros(tokens.shape), where=tokens > 0)


def chances_of(tokens: np.ndarray, factors: np.ndarray, slack: float = SLACK) -> np.ndarray:
    """Drawing probabilities in proportion to ``factors``, as large as they can be.

    The cells of the largest factors that together make up at most ``slack`` of the mixture are drawn whole and lack the rest of their
    share; the next factor sets the scale. Every other cell has its exact proportion.
    """
    if factors.max() <= 0:
        return np.ones(tokens.shape)
    falling = np.argsort(-factors, axis=None, kind="stable")
    made_up = np.cumsum((tokens * factors).ravel()[falling])
    scale = factors.ravel()[falling[np.searchsorted(made_up, slack * made_up[-1], side="right")]]
    return np.minimum(1.0, factors / scale)


def with_probabilities(docs: DataFrame, marginals: list[Marginal], tokens: Column) -> DataFrame:
    """Every row of ``docs`` with ``mix_tokens`` and ``mix_probability`` (columns of these names are replaced).

    The cells are bounded by the named target values, so their sums are small whatever the data; they are summed over all rows.
    A row without tokens is in no marginal; its probability is that of its cell.
    """
    cells = [m.cell().alias(f"__{i}") for i, m in enumerate(marginals)]
    sums = docs.select(*cells, tokens.cast("long").alias("n")).groupBy(*[f"__{i}" for i in range(len(marginals))]).agg(F.sum("n").alias("n")).collect()
    places = [{v: i for i, v in enumerate(m.values())} for m in marginals]
    grid = np.zeros([len(p) for p in places])
    for row in sums:
        grid[tuple(place[row[i]] for i, place in enumerate(places))] = float(row["n"] or 0)
    totals = [grid.sum(axis=tuple(i for i in range(grid.ndim) if i != axis)) for axis in range(grid.ndim)]
    share = chances_of(grid, rake(grid, [m.targets(n) for m, n in zip(marginals, totals)]))
    place = F.lit(0)
    for marginal, size in zip(marginals, grid.shape):
        names = F.array(*[F.lit(v) for v in marginal.values()])
        place = place * size + F.array_position(names, marginal.cell()) - 1
    chances = F.array(*[F.lit(float(p)) for p in share.ravel()])
    return docs.drop("mix_tokens", "mix_probability").select("*", tokens.cast("long").alias("mix_tokens"), F.get(chances, place.cast("int")).alias("mix_probability"))


def draw(rated: DataFrame, key: Column, seed: int = 0) -> DataFrame:
    """The rows whose hashed key falls below their probability: independent of how rows are dealt, repeatable, one scan.

    Rows with equal keys (also null ones) share their fate.
    """
    uniform = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") / float(2**53)
    return rated.filter(uniform < F.col("mix_probability"))


def mix(docs: DataFrame, marginals: list[Marginal], tokens: Column, seed: int = 0) -> DataFrame:
    """Documents sampled so that the expected token shares meet the targets, with the columns of ``docs`` only."""
    return draw(with_probabilities(docs, marginals, tokens), F.col("doc_id"), seed).select(*docs.columns)


def word_count(text: Column) -> Column:
    """Words (runs of anything but ASCII blanks) of a text; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")), F.lit(0))


def length_topic(words: Column) -> Column:
    """A coarse stand-in for a topic where a table has none: the length band of the document."""
    return F.when(words < 200, "short").when(words < 1000, "medium").otherwise("long")
