"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector is a sparse row of integer terms. Candidates are dealt into cells of bounded size, queries into batches of bounded
size, and every (batch, cell) pair is one group. In a group the cell becomes posting lists; each term of a query scatters its
weighted postings into a dense score array. The best k of each array are selected by partition and the lists are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Elements of the dense score arrays that a task holds at once.
SCORE_CELLS = 1 << 21


def quantised(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of every component, as long; null if the vector or a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class Postings:
    """Posting lists of a cell: per term the rows that have it and their weights."""

    def __init__(self, vectors: list[np.ndarray]):
        self.rows = len(vectors)
        sizes = np.array([len(v) for v in vectors], dtype=np.int64)
        weight = np.concatenate([*vectors, np.zeros(0, np.int64)]).astype(np.int64)
        row = np.repeat(np.arange(self.rows), sizes)
        term = np.arange(len(weight)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        keep = weight != 0
        weight, row, term = weight[keep], row[keep], term[keep]
        order = np.argsort(term, kind="stable")
        self.weight, self.row = weight[order], row[order]
        self.first = np.searchsorted(term[order], np.arange(int(term.max()) + 2 if len(term) else 1))

    def scores(self, queries: list[np.ndarray]) -> np.ndarray:
        """Inner products of the queries with all rows, term by term."""
        out = np.zeros((len(queries), self.rows), dtype=np.int64)
        width = max((len(q) for q in queries), default=0)
        terms = np.zeros((len(queries), width), dtype=np.int64)
        for i, q in enumerate(queries):
            terms[i, : len(q)] = q
        for t in range(min(width, len(self.first) - 1)):
            a, b = self.first[t], self.first[t + 1]
            have = np.flatnonzero(terms[:, t])
            if a == b or not len(have):
                continue
            row, add = self.row[a:b], terms[have, t][:, None] * self.weight[a:b][None, :]
            if len(row) == self.rows and len(have) == len(queries):
                out += add  # a term that every row and query has needs no scatter
            else:
                out[np.ix_(have, row)] += add
        return out


def best_of(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores; ties go to the earlier position."""
    n = len(scores)
    if k >= n:
        return np.lexsort((np.arange(n), -scores))
    bound = np.partition(scores, n - k)[n - k]
    above = np.flatnonzero(scores > bound)
    found = np.concatenate([above, np.flatnonzero(scores == bound)[: k - len(above)]])
    return found[np.lexsort((found, -scores[found]))]


def exact_topk(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    scale: int = 256,
    query_rows: int = 8192,
    cell_rows: int = 16384,
) -> DataFrame:
    """Per query the k rows with the highest integer inner product: ``query_id, rank, vec_id, score``.

    Every row but the query's own id is a candidate; ties go to the smaller id; fewer than k candidates give fewer rows. Rows
    with a null id, a null vector or a null or non-finite component take no part. Vectors of different length meet in the terms
    that both have; an empty vector scores 0. Rows that repeat id and vector count once. A repeated id with other vectors is one
    more candidate each; as a query its vectors compete for the same k ranks. Sums wrap at 64 bits, as a long does.

    ``query_rows`` and ``cell_rows`` bound what a group holds; the number of groups follows the data.
    """
    rows = (
        vectors.select(F.col(id_column).cast("long").alias("vec_id"), quantised(F.col(vector_column), scale).alias("terms"), is_query.alias("asks"))
        .filter(F.col("vec_id").isNotNull() & F.col("terms").isNotNull())
    )
    sizes = vectors.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    batches, cells = max(1, math.ceil(sizes["q"] / query_rows)), max(1, math.ceil(sizes["n"] / cell_rows))
    spread = F.xxhash64("vec_id", "terms")
    every_cell, every_batch = F.sequence(F.lit(0), F.lit(cells - 1)), F.sequence(F.lit(0), F.lit(batches - 1))
    asked = rows.filter("asks").select(F.pmod(spread, F.lit(batches)).cast("int").alias("batch"), F.explode(every_cell).alias("cell"), "vec_id", "terms")
    offered = rows.select(F.explode(every_batch).alias("batch"), F.pmod(spread, F.lit(cells)).cast("int").alias("cell"), "vec_id", "terms")

    def once(part: pd.DataFrame) -> pd.DataFrame:
        """Sorted by id, rows that repeat id and vector once; such rows share a cell, which is dealt by both."""
        part = part.sort_values("vec_id", kind="stable")
        if part["vec_id"].duplicated().any():
            part = part[~pd.DataFrame({"i": part["vec_id"], "v": [v.tobytes() for v in part["terms"]]}).duplicated()]
        return part

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = once(left), once(right)
        ids = right["vec_id"].to_numpy()
        postings, found = Postings(list(right["terms"])), []
        step = max(1, SCORE_CELLS // max(1, len(ids)))
        for first in range(0, len(left), step):
            part = left.iloc[first : first + step]
            scored = postings.scores(list(part["terms"]))
            for own, line in zip(part["vec_id"], scored):
                take = best_of(line, min(len(ids), k + int(np.searchsorted(ids, own, "right") - np.searchsorted(ids, own, "left"))))
                take = take[ids[take] != own][:k]
                found.append(pd.DataFrame({"query_id": own, "vec_id": ids[take], "score": line[take]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    lists = asked.groupBy("batch", "cell").cogroup(offered.groupBy("batch", "cell")).applyInPandas(search, "query_id long, vec_id long, score long")
    # The rank limit is applied in the map tasks first, so a query's rows are few where they meet.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return lists.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
