"""Exact top-k by inner product with vector approximations: bounds from quantised cells, exact vectors in bound order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.llm.store import stored

SCALE = 256
#: Cells of a dimension in the approximation of a block.
CELLS = 16
#: Queries sent to all tasks at once; rows and queries compared at once in a task.
QUERY_BLOCK, ROWS, QUERIES = 20_000, 2048, 512
#: Exact vectors read at once for each query that is still open.
STEP = 16


def usable(vector: str) -> Column:
    """Not null, and neither null nor non-finite in any component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))


def integers(column: pa.Array, width: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * values).reshape(len(column), width)


class Best:
    """The k best of each query so far: scores downwards, ties by id."""

    def __init__(self, queries: int, k: int):
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        score = np.concatenate([self.score[rows], score], axis=1)
        ids = np.concatenate([self.id[rows], ids], axis=1)
        order = np.lexsort((ids, -score), axis=1)[:, :k]
        self.score[rows], self.id[rows] = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def search_block(query_id: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, best: Best, at: np.ndarray) -> None:
    """Adds a block's vectors to ``best`` (rows ``at``)."""
    low = vectors.min(axis=0)
    width = np.maximum((vectors.max(axis=0) - low) / CELLS, 1e-9)
    cells = np.minimum(((vectors - low) / width).astype(np.uint8), CELLS - 1)  # the approximation: 4 bits a component
    middle = low + (cells + 0.5) * width
    reach = np.abs(queries) @ (width / 2)
    upper = queries @ middle.T + reach[:, None]
    upper += 1e-9 * np.abs(upper) + 1e-6  # above any rounding
    upper[query_id[:, None] == ids[None, :]] = -np.inf
    order = np.argsort(-upper, axis=1, kind="stable")
    for start in range(0, len(ids), STEP):
        place = order[:, start : start + STEP]
        bound = np.take_along_axis(upper, place, 1)
        # a query is done when the best bound left is below its kth score
        live = np.flatnonzero((bound[:, 0] >= best.score[at, -1]) & (bound[:, 0] > -np.inf))
        if not len(live):
            break
        chosen = place[live]
        score = np.einsum("qd,qsd->qs", queries[live], vectors[chosen])
        found = ids[chosen]
        own = bound[live] == -np.inf
        score[own], found[own] = -np.inf, np.iinfo(np.int64).max
        best.add(at[live], score, found)


def search(batches: Iterator[pa.RecordBatch], query_id: np.ndarray, queries: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    best, width = Best(len(query_id), k), queries.shape[1]
    for batch in batches:
        ids = batch.column("id").to_numpy()
        for lo in range(0, len(batch), ROWS):
            part = integers(batch.column("vector").slice(lo, ROWS), width)
            for q in range(0, len(query_id), QUERIES):
                at = np.arange(q, min(len(query_id), q + QUERIES))
                search_block(query_id[at], queries[at], ids[lo : lo + ROWS], part, best, at)
    row, column = np.nonzero(best.score > -np.inf)
    yield pa.RecordBatch.from_arrays(
        [pa.array(row), pa.array(query_id[row]), pa.array(best.id[row, column]), pa.array(best.score[row, column].astype(np.int64))],
        names=["query", "query_id", "vec_id", "score"],
    )


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k rows with the highest inner product for each query row.

    Components are floor(256 x); scores are exact integers (below 2**53). Rows
    stay where they are; queries go to all tasks in blocks of about QUERY_BLOCK,
    chosen by a hash of the id, one pass over the rows for each block. A task
    approximates its rows by cells, bounds all scores from these, and reads exact
    vectors in the order of the bounds until the kth score is certain.

    Every row but those with the query's own id is a candidate; ties go to the
    smaller id. Null ids, null vectors and vectors with null or non-finite
    components take no part. Vectors are compared with those of their length.
    A query row that occurs twice counts once; as candidates both rows count.
    """
    rows = vectors.select(
        F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector"), is_query.alias("asks")
    ).where(F.col("id").isNotNull() & usable("vector"))
    asked = stored(rows.where("asks").select("id", "vector").distinct(), "queries")
    outputs = []
    for width, count in sorted((r.width, r.n) for r in asked.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n")).collect()):
        same = rows.where(F.size("vector") == width).select("id", "vector")
        blocks = -(-count // QUERY_BLOCK)
        for b in range(blocks):
            block = asked.where((F.size("vector") == width) & (F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)).toArrow().combine_chunks()
            if not len(block):
                continue
            ids, query = block.column("id").to_numpy(), integers(block.column("vector").combine_chunks(), width)
            sent = vectors.sparkSession.sparkContext.broadcast((ids, query))
            found = same.mapInArrow(lambda x, sent=sent: search(x, *sent.value, k), "query long, query_id long, vec_id long, score long")
            # two different vectors under one query id are two queries
            outputs.append(found.withColumn("block", F.lit(f"{width}.{b}")))
    if not outputs:
        return rows.where("false").select(
            F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score")
        )
    merged = outputs[0]
    for other in outputs[1:]:
        merged = merged.union(other)
    ranked = Window.partitionBy("block", "query").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
