"""Filtered exact top-k search of a table of questions over vector tables.

Vectors lie in cells: each belongs to its nearest center and to a ring of angles around it. As angles obey the triangle inequality, the
center and the ring bound the best score that a cell can hold for a question. A question first meets its most promising
cells; its k-th score so far then rules out every cell whose bound is lower, and only the others are scored. The result is that of scoring
all pairs. Cells are cut into slices of bounded size and their questions into bounded batches, so one center, one
vector with very many copies or one favourite cell is no single task's work. A few questions are sent to the vectors instead, which then
stay where they are. Scores are matrix products in Arrow batches; pairs are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions import text as fx
from larkspur.session import written

SCORE_DIGITS = 6
#: Centers, width of a ring in radians, vectors of a slice, questions of a batch, scores computed at once.
CENTERS, RING_WIDTH, SLICE_ROWS, BATCH_QUESTIONS, SCORE_BLOCK = 64, 0.05, 50_000, 4096, 4_000_000
#: A question first meets cells with so many times its limit of vectors; half a unit of the last digit and the error of an angle.
FIRST_FACTOR, SLACK = 8, 2e-6
#: Up to so many questions are sent to all tasks; more meet the vectors in a shuffle by cell.
SENT_QUESTIONS = 1024
#: Rings per center at most, as angles end at pi.
_RINGS = 1024


@dataclass(frozen=True)
class SearchColumns:
    """Names of the columns a search reads.

    ``equal`` pairs a vector column with a question column that is null or must be equal; ``within`` pairs one with a list column that
    is null or empty or must hold it; ``dates`` names the vector's first and last day and the question's range, which must overlap
    where it is given; ``limit`` is a question column with its own number of hits.
    """

    doc_id: str = "doc_id"
    vector: str = "vector"
    query_id: str = "query_id"
    query_vector: str = "query_vector"
    equal: tuple[tuple[str, str], ...] = ()
    dates: tuple[str, str, str, str] | None = None
    within: tuple[tuple[str, str], ...] = ()
    limit: str | None = None

    def vector_columns(self) -> list[Column]:
        days = [F.unix_date(c).alias(f"_d{i}") for i, c in enumerate(self.dates[:2])] if self.dates else []
        same = [F.col(v).cast("string").alias(f"_e{i}") for i, (v, _) in enumerate(self.equal)]
        member = [F.col(v).cast("string").alias(f"_w{i}") for i, (v, _) in enumerate(self.within)]
        return [F.col(self.doc_id).alias("_id"), F.col(self.vector).alias("_v"), *same, *member, *days]

    def question_columns(self, k: int) -> list[Column]:
        days = [F.unix_date(c).alias(f"_d{i}") for i, c in enumerate(self.dates[2:])] if self.dates else []
        same = [F.col(q).cast("string").alias(f"_e{i}") for i, (_, q) in enumerate(self.equal)]
        member = [F.col(q).cast("array<string>").alias(f"_w{i}") for i, (_, q) in enumerate(self.within)]
        own = F.coalesce(F.col(self.limit), F.lit(k)) if self.limit else F.lit(k)
        return [F.col(self.query_id).alias("_id"), F.col(self.query_vector).alias("_v"), own.cast("int").alias("_k"), *same, *member, *days]


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit rows of a list column, as doubles; zero vectors stay zero."""
    rows = len(column)
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(rows, -1) if rows else flat.reshape(0, 1)
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return matrix / np.where(norms == 0, 1.0, norms)


def _numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return pc.cast(column, pa.float64()).to_numpy(zero_copy_only=False)


def _codes(column: pa.ChunkedArray, values: pa.Array, absent: int) -> np.ndarray:
    return pc.fill_null(pc.index_in(column, value_set=values), absent).to_numpy()


def _allowed(questions: pa.Table, vectors: pa.Table) -> np.ndarray | None:
    """Mask (questions × vectors) of the pairs the filters let through."""
    mask = None
    for name in questions.column_names:
        if name.startswith("_e"):
            values = pc.unique(questions[name].drop_null())
            want, have = _codes(questions[name], values, -1), _codes(vectors[name], values, -2)
            part = (want[:, None] == have[None, :]) | (want == -1)[:, None]
        elif name.startswith("_w"):
            lists, values = questions[name].combine_chunks(), pc.unique(vectors[name].drop_null())
            named = np.zeros((len(lists), len(values) + 1), bool)
            rows, wanted = pc.list_parent_indices(lists).to_numpy(), pc.index_in(pc.list_flatten(lists), value_set=values)
            hit = pc.is_valid(wanted).to_numpy(zero_copy_only=False)
            named[rows[hit], wanted.drop_null().to_numpy()] = True
            free = pc.fill_null(pc.equal(pc.list_value_length(lists), 0), True).to_numpy(zero_copy_only=False)
            part = named[:, _codes(vectors[name], values, len(values))] | free[:, None]
        elif name.startswith("_d"):
            want, have = _numbers(questions[name]), _numbers(vectors["_d1" if name == "_d0" else "_d0"])
            bound = want[:, None] <= have[None, :] if name == "_d0" else want[:, None] >= have[None, :]
            part = bound | np.isnan(want)[:, None]
        else:
            continue
        mask = part if mask is None else mask & part
    return mask


def _block_best(scores: np.ndarray, ids: np.ndarray, limits: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per row of ``scores`` its best (score, id), ties by id; minus infinity is no hit."""
    out = []
    for row, k in zip(scores, limits):
        if len(row) > k > 0:
            limit = np.partition(row, len(row) - k)[len(row) - k]
            picked = np.nonzero((row >= limit) & (row > -np.inf))[0]
        else:
            picked = np.nonzero(row > -np.inf)[0]
        order = np.lexsort((ids[picked], -row[picked]))[: max(k, 0)]
        out.append((row[picked[order]], ids[picked[order]]))
    return out


def _score(questions: pa.Table, documents: pa.Table, schema: pa.Schema) -> pa.Table:
    """The best documents of one slice for each question."""
    limits, left, ids = questions["_k"].to_pylist(), _matrix(questions["_v"]), np.asarray(documents["_id"].to_pylist(), dtype=object)
    right, asked = _matrix(documents["_v"]), questions["_id"].to_pylist()
    found = []
    step = max(1, SCORE_BLOCK // max(1, documents.num_rows))
    for start in range(0, questions.num_rows, step):
        scores = np.round(left[start : start + step] @ right.T, SCORE_DIGITS) + 0.0
        mask = _allowed(questions.slice(start, step), documents)
        if mask is not None:
            scores[~mask] = -np.inf
        found += _block_best(scores, ids, limits[start : start + step])
    columns = [[q for q, (v, _) in zip(asked, found) for _ in v], [n for _, names in found for n in names], [x for v, _ in found for x in v.tolist()]]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


@dataclass(frozen=True)
class Centers:
    """What bounds the scores of cells: unit vectors of the centers, and per cell its center (-1: zero vectors), ring and rows."""

    unit: np.ndarray
    cell: np.ndarray
    center: np.ndarray
    least: np.ndarray
    most: np.ndarray
    rows: np.ndarray

    def bounds(self, questions: np.ndarray) -> np.ndarray:
        """The best score that each cell (column) can hold for each question (row)."""
        if not len(self.cell):
            return np.zeros((len(questions), 0))
        angle = np.arccos(np.clip(questions @ self.unit.T, -1, 1))[:, np.maximum(self.center, 0)]
        gap = np.maximum(0, np.maximum(angle - self.most, self.least - angle))
        best = np.where(self.center < 0, 0.0, np.cos(np.maximum(gap - SLACK, 0)))
        return np.where((questions * questions).sum(axis=1, keepdims=True) == 0, 0.0, best) + SLACK


@dataclass(frozen=True)
class ClusteredVectors:
    """Vectors in cells: ``rows`` with ``_cell``, ``_slice`` and the searched columns, ``cells`` with their slices, and their bounds."""

    rows: DataFrame
    cells: DataFrame
    centers: Centers
    names: SearchColumns
    id_type: T.DataType

    def without(self, documents: DataFrame) -> ClusteredVectors:
        """The cells without some documents (``documents`` has their id column). What bounds a cell bounds its part as well."""
        gone = documents.select(F.col(self.names.doc_id).alias("_id"))
        return replace(self, rows=self.rows.join(gone, "_id", "left_anti"))


def _pivots(vectors: DataFrame, centers: int) -> np.ndarray:
    """Unit vectors of a few rows, those of lowest vector hash. Copies are one candidate, and a hash bound keeps the candidates few."""
    total = vectors.count()
    low = min(int(min(1.0, 40 * centers / max(total, 1)) * 2**64) - 2**63, 2**63 - 1)
    hashed = vectors.select(F.xxhash64("_v").alias("h"), "_v").filter(F.col("h") <= F.lit(low).cast("long"))
    chosen = hashed.groupBy("h").agg(F.first("_v").alias("_v")).orderBy("h").limit(centers).select("_v").toArrow()
    unit = _matrix(chosen["_v"]) if chosen.num_rows else np.zeros((0, 1))
    return unit[(unit * unit).sum(axis=1) > 0]


def cluster_vectors(vectors: DataFrame, names: SearchColumns = SearchColumns(), centers: int = CENTERS, slice_rows: int = SLICE_ROWS) -> ClusteredVectors:
    """Deal vectors into cells, once for any number of searches. Null vectors take no part.

    The centers are a bounded sample, the cells at most ``centers`` times the rings; only these are read on the driver.
    """
    slim = vectors.select(*names.vector_columns()).filter(F.col("_v").isNotNull())
    unit = _pivots(slim, centers)
    schema = T.StructType([*slim.schema.fields, T.StructField("_cell", T.LongType()), T.StructField("_angle", T.DoubleType())])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = _matrix(batch.column("_v"))
            zero = (matrix * matrix).sum(axis=1) == 0
            if len(unit):
                likeness = np.clip(matrix @ unit.T, -1, 1)
                center, angle = likeness.argmax(axis=1), np.arccos(likeness.max(axis=1, initial=-1))
            else:
                center, angle = np.zeros(len(matrix), int), np.zeros(len(matrix))
            cell = np.where(zero, -1, center * _RINGS + (angle / RING_WIDTH).astype(int))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int64)), pa.array(angle)], [*batch.schema.names, "_cell", "_angle"])

    dealt = written(slim.mapInArrow(placed, schema), "cells")
    cells = dealt.groupBy("_cell").agg(F.count(F.lit(1)).alias("_rows"), F.min("_angle").alias("_least"), F.max("_angle").alias("_most"))
    cells = written(cells.coalesce(1).withColumn("_slices", F.ceil(F.col("_rows") / slice_rows).cast("int")), "cell-sizes")
    found = cells.orderBy("_cell").toPandas()
    cell = found["_cell"].to_numpy(np.int64)
    known = Centers(unit, cell, np.where(cell < 0, -1, cell // _RINGS), found["_least"].to_numpy(float), found["_most"].to_numpy(float), found["_rows"].to_numpy(np.int64))
    sliced = dealt.drop("_angle").join(F.broadcast(cells.select("_cell", "_slices")), "_cell")
    rows = sliced.withColumn("_slice", F.pmod(F.xxhash64("_id"), "_slices").cast("int")).drop("_slices")
    return ClusteredVectors(rows, cells, known, names, vectors.schema[names.doc_id].dataType)


def _met_cells(part: pa.RecordBatch | pa.Table, centers: Centers, later: bool) -> np.ndarray:
    """Mask (questions × cells) of the cells that questions meet: the first ones, or with ``_least`` (their k-th score so far) the others
    that may hold a better or equal score."""
    bounds = centers.bounds(_matrix(part.column("_v")))
    order = np.argsort(-bounds, axis=1, kind="stable")
    before = np.cumsum(centers.rows[order], axis=1) - centers.rows[order]
    early = before < FIRST_FACTOR * np.array(part.column("_k").to_pylist(), np.int64)[:, None]
    met = early
    if later:
        least = pc.fill_null(part.column("_least"), -np.inf).to_numpy(zero_copy_only=False) if part.num_rows else np.zeros(0)
        met = ~early & (np.take_along_axis(bounds, order, axis=1) >= least[:, None])
    mask = np.zeros(met.shape, bool)
    np.put_along_axis(mask, order, met, axis=1)
    return mask


def _chosen_cells(asked: DataFrame, centers: Centers, later: bool) -> DataFrame:
    """Questions with each cell (``_cell``) they meet."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                rows, at = np.nonzero(_met_cells(part, centers, later))
                out = part.take(pa.array(rows)).drop_columns(["_least"] if later else [])
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(centers.cell[at])], [*out.schema.names, "_cell"])

    kept = [f for f in asked.schema.fields if f.name != "_least"]
    return asked.mapInArrow(choose, T.StructType([*kept, T.StructField("_cell", T.LongType())]))


def _hits_schema(clustered: ClusteredVectors, asked: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("_query", asked.schema["_id"].dataType), T.StructField("_doc", clustered.id_type), T.StructField("_score", T.DoubleType())])


def _scored_in_place(clustered: ClusteredVectors, asked: DataFrame, later: bool) -> DataFrame:
    """Best hits ``_query, _doc, _score`` per task for questions that are sent to all tasks, so their number must be bounded.

    A task keeps the best documents of each question so far; a batch of vectors is ranked only where it holds a score that reaches them.
    """
    sent, centers = asked.sparkSession.sparkContext.broadcast(asked.toArrow()), clustered.centers
    schema = _hits_schema(clustered, asked)
    target = _arrow_schema(schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions = sent.value.combine_chunks()
        if not questions.num_rows:
            return
        met, limits, left = _met_cells(questions, centers, later), questions["_k"].to_pylist(), _matrix(questions["_v"])
        best = [(np.zeros(0), np.zeros(0, object))] * len(limits)
        floor = np.full(len(limits), -np.inf)
        for batch in batches:
            at = np.searchsorted(centers.cell, batch.column("_cell").to_numpy())
            wanted = np.flatnonzero(met.any(axis=0)[at])
            if not len(wanted):
                continue
            documents, at = pa.Table.from_batches([batch.take(pa.array(wanted))]), at[wanted]
            right, ids = _matrix(documents["_v"]), np.asarray(documents["_id"].to_pylist(), dtype=object)
            step = max(1, SCORE_BLOCK // len(at))
            for start in range(0, len(limits), step):
                scores = np.round(left[start : start + step] @ right.T, SCORE_DIGITS) + 0.0
                mask = _allowed(questions.slice(start, step), documents)
                scores[~(met[start : start + step][:, at] if mask is None else mask & met[start : start + step][:, at])] = -np.inf
                top = scores.max(axis=1)
                for row in np.flatnonzero((top > -np.inf) & (top >= floor[start : start + step])):
                    q = start + row
                    found = _block_best(scores[row : row + 1], ids, [limits[q]])[0]
                    values, docs = (np.concatenate(pair) for pair in zip(best[q], found))
                    best[q] = _block_best(values[None], docs, [limits[q]])[0]
                    if 0 < limits[q] == len(best[q][0]):
                        floor[q] = best[q][0][-1]
        asked_ids = questions["_id"].to_pylist()
        columns = [[q for q, (v, _) in zip(asked_ids, best) for _ in v], [d for _, docs in best for d in docs], [x for v, _ in best for x in v.tolist()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    return clustered.rows.drop("_slice").mapInArrow(score, schema)


def _scored(clustered: ClusteredVectors, asked: DataFrame, batch_questions: int) -> DataFrame:
    """Best hits ``_query, _doc, _score`` per slice for questions with the cells they meet."""
    met = written(asked, "asked")
    sizes = met.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / batch_questions).cast("int").alias("_batches"))
    plan = written(sizes.join(F.broadcast(clustered.cells.select("_cell", "_slices")), "_cell").coalesce(1), "asked-cells")
    # Both tables have one row per cell, and the number of cells is bounded.
    to_cell = F.broadcast(plan)
    left = clustered.rows.join(to_cell.drop("_slices"), "_cell").withColumn("_batch", F.explode(F.sequence(F.lit(0), F.col("_batches") - 1))).drop("_batches")
    right = met.join(to_cell, "_cell").withColumn("_batch", F.pmod(F.xxhash64("_id"), "_batches").cast("int"))
    right = right.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_slices", "_batches")
    schema = _hits_schema(clustered, asked)
    target, keys = _arrow_schema(schema), ["_cell", "_slice", "_batch"]

    def score_cell(documents: pa.Table, questions: pa.Table) -> pa.Table:
        return _score(questions, documents, target)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score_cell, schema)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema.fields])


def _ranked(found: DataFrame, limits: DataFrame) -> DataFrame:
    window = Window.partitionBy("_query").orderBy(F.desc("_score"), "_doc")
    own = found.join(limits.select(F.col("_id").alias("_query"), "_k"), "_query")
    return own.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= F.col("_k"))


def search(
    clustered: ClusteredVectors, questions: DataFrame, k: int, batch_questions: int = BATCH_QUESTIONS, sent_questions: int = SENT_QUESTIONS
) -> DataFrame:
    """``query_id, doc_id, score, rank``: the most similar allowed documents of every question, ``k`` or its own limit.

    Scores are cosines rounded to six digits, ties go to the smaller document id. ``query_id`` is unique; questions with a null
    vector have no hits. Up to ``sent_questions`` questions are sent to the vectors; more meet them by cell, ``batch_questions`` at a time.
    """
    names = clustered.names
    asked = written(questions.select(*names.question_columns(k)).filter(F.col("_v").isNotNull()), "questions")
    few = asked.limit(sent_questions + 1).count() <= sent_questions

    def scored(rows: DataFrame, later: bool) -> DataFrame:
        if few:
            return _scored_in_place(clustered, rows, later)
        return _scored(clustered, _chosen_cells(rows, clustered.centers, later), batch_questions)

    first = written(scored(asked, False), "first-hits")
    full = _ranked(first, asked).filter(F.col("rank") == F.col("_k")).select(F.col("_query").alias("_id"), F.col("_score").alias("_least"))
    second = scored(asked.join(full, "_id", "left"), True)
    hits = _ranked(first.unionByName(second), asked)
    return hits.select(F.col("_query").alias(names.query_id), F.col("_doc").alias(names.doc_id), F.col("_score").alias("score"), "rank")


def scored_shares(clustered: ClusteredVectors, questions: DataFrame, k: int) -> DataFrame:
    """``query_id, scored_share`` of all vectors that a search scores for each question: those of its first cells and those its k-th
    score cannot rule out."""
    names = clustered.names
    asked = written(questions.select(*names.question_columns(k)).filter(F.col("_v").isNotNull()), "questions")
    full = search(clustered, questions, k).select(F.col(names.query_id).alias("_id"), "score", "rank").join(asked.select("_id", "_k"), "_id")
    least = full.groupBy("_id").agg(F.max(F.when(F.col("rank") == F.col("_k"), F.col("score"))).alias("_least"))
    met = _chosen_cells(asked, clustered.centers, False).unionByName(_chosen_cells(asked.join(least, "_id", "left"), clustered.centers, True))
    total = int(clustered.centers.rows.sum())
    rows = met.join(F.broadcast(clustered.cells), "_cell").groupBy(F.col("_id").alias(names.query_id)).agg(F.sum("_rows").alias("n"))
    return rows.select(names.query_id, (F.col("n") / total).alias("scored_share"))


def vector_topk(
    vectors: DataFrame, questions: DataFrame, k: int, names: SearchColumns = SearchColumns(), centers: int = CENTERS,
    slice_rows: int = SLICE_ROWS, batch_questions: int = BATCH_QUESTIONS,
) -> DataFrame:
    """:func:`search` over a table that is not clustered yet."""
    return search(cluster_vectors(vectors, names, centers, slice_rows), questions, k, batch_questions)


def merge_topk(hit_sets: Sequence[DataFrame], k: int, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """The k best of several hit tables per question; ties keep the order of the tables, then their own ranks."""
    tagged = [h.withColumn("_set", F.lit(i)) for i, h in enumerate(hit_sets)]
    union = tagged[0]
    for part in tagged[1:]:
        union = union.unionByName(part)
    window = Window.partitionBy(query_id).orderBy(F.desc("score"), "_set", "rank", doc_id)
    return union.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k).drop("_set")


def attach_payload(hits: DataFrame, index: DataFrame, payload: Sequence[str], doc_id: str = "doc_id") -> DataFrame:
    """Payload columns of the hits. Stored hits are broadcast to the index scan where their files are small, by Spark's own threshold."""
    return hits.join(index.select(doc_id, *payload), doc_id)


def only_keys(table: DataFrame, hits: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rows of a large table whose document was hit."""
    return table.join(hits.select(doc_id), doc_id, "left_semi")


def fill_content(
    hits: DataFrame, staged: DataFrame | None = None, staged_text: Column | None = None, doc_id: str = "doc_id"
) -> DataFrame:
    """Replace placeholder content by staged text, and empty content by the snippet.

    ``staged`` has at most one row per document; the text is ``staged_text`` over its columns.
    """
    columns = hits.columns
    joined = hits if staged is None else hits.join(staged, doc_id, "left")
    text = F.lit(None).cast("string") if staged is None else staged_text
    fetched = F.when(fx.is_placeholder("content", "source_type"), F.nullif(text, F.lit("")))
    content = F.coalesce(fetched, F.nullif(F.col("content"), F.lit("")), F.col("snippet"))
    return joined.withColumn("content", content).select(*columns)
