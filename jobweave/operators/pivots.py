"""VEC2 with exact pruning: items grouped round pivots, groups that cannot hold a result left out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from jobweave.operators.staging import top_per_key
from jobweave.operators.vectors import BROADCAST_QUERIES, ITEMS_PER_BLOCK, _checked_vectors, _compare, _matrix
from jobweave.session import bounded_batches, materialize_once

#: Pivots by default; a pivot is an item, so that 1024 pivots of 768 numbers are 6 MB in each task.
PIVOTS = 256
#: Added to every bound in radians, above the error of an angle from rounded products.
SLACK = 1e-6


def angles(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Angles between unit rows."""
    return np.arccos(np.clip(left @ right.T, -1.0, 1.0))


def pick_pivots(items: DataFrame, n: int, dim: int) -> np.ndarray:
    """Unit vectors of the ``n`` items with the smallest hash of their id. They steer the grouping only, never the result."""
    return _matrix(items.orderBy(F.xxhash64("id"), "id").limit(n).select("vec").toArrow()["vec"], dim)


def with_nearest(rows: DataFrame, pivots: np.ndarray, dim: int) -> DataFrame:
    """Each row with its nearest pivot and the angle to it. A zero vector stands at a right angle to all."""
    schema = T.StructType([*rows.schema.fields, T.StructField("pivot", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    held = rows.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = angles(_matrix(batch.column("vec"), dim), held.value)
            nearest = found.argmin(axis=1)
            columns = [*batch.columns, pa.array(nearest, pa.int32()), pa.array(found[np.arange(len(nearest)), nearest])]
            yield pa.RecordBatch.from_arrays(columns, schema=to_arrow_schema(schema))

    return rows.mapInArrow(assign, schema)


def open_groups(queries: DataFrame, pivots: np.ndarray, spans: list[tuple[int, float, float]], dim: int, minimum: float) -> DataFrame:
    """A row for each query and group (``pivot``, ``toward``: the angle to it) that may hold a score above the query's ``bound``.

    Of a group only the pivot and the least and greatest angle of its items are
    known. An item at angle b from the pivot is at least |a - b| away from a
    query at angle a, so a group counts if some b in its span can be near enough.
    """
    schema = T.StructType([*queries.schema.fields, T.StructField("pivot", T.IntegerType()), T.StructField("toward", T.DoubleType())])
    held = queries.sparkSession.sparkContext.broadcast((pivots, spans))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, known = held.value
        groups = np.array([g for g, _, _ in known], dtype=np.int64)
        low, high = np.array([a for _, a, _ in known]), np.array([b for _, _, b in known])
        for batch in batches:
            toward = angles(_matrix(batch.column("vec"), dim), centres[groups])
            bound = np.maximum(np.asarray(batch.column("bound"), dtype=np.float64), minimum)
            away = np.maximum(np.maximum(low - toward, toward - high), 0)
            row, group = np.nonzero(away <= np.arccos(np.clip(bound, -1, 1))[:, None] + SLACK)
            kept = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(groups[group], pa.int32()), pa.array(toward[row, group])], schema=to_arrow_schema(schema)
            )

    return queries.mapInArrow(choose, schema)


def parts_of(pivot: Column, counts: dict[int, int], size: int) -> Column:
    """How many parts of about ``size`` rows each pivot's rows are cut into."""
    known = F.create_map(*[F.lit(x) for g, n in counts.items() for x in (g, -(-n // size))])
    return F.coalesce(known[pivot], F.lit(1))


def pruned_topk(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    dim: int,
    minimum: float = 0.5,
    query_id: str = "query_id",
    item_id: str = "item_id",
    vector: str = "embedding",
    item_class: str | None = None,
    allowed: str | None = None,
    pivots: int = PIVOTS,
    queries_per_block: int = BROADCAST_QUERIES,
    items_per_block: int = ITEMS_PER_BLOCK,
    compared: Accumulator[int] | None = None,
) -> DataFrame:
    """VEC2: the rows of ``vectors.cosine_topk``, for many queries over many items, without comparing all pairs.

    Items are grouped by their nearest pivot and written once. A query first
    meets its own nearest group, which gives a score that its kth best reaches.
    Angles obey the triangle inequality, so afterwards it meets only the groups
    whose span of angles leaves room for such a score, and in a group, whose
    items are ordered by angle, only the chunks that do. Exact whatever the
    pivots are; vectors without clusters leave little to prune.

    A group of many items, or one that many queries meet, is cut into parts by a
    hash of the id, so a task holds ``items_per_block`` items and
    ``queries_per_block`` queries on average, however large the group. The driver
    sees the pivots and two numbers for each. ``compared`` adds up the pairs
    whose score was computed. Rows without a whole vector take no part; an item
    without a class is open to no query whose classes are listed; no items or no
    queries give no rows.
    """
    filtered = item_class is not None and allowed is not None
    q = _checked_vectors(queries, query_id, vector, dim, [F.col(allowed)] if filtered else [], ["allowed"])
    x = _checked_vectors(items, item_id, vector, dim, [F.col(item_class)] if filtered else [], ["class"])
    schema = T.StructType(
        [
            T.StructField("query_id", q.schema["id"].dataType),
            T.StructField("item_id", x.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    arrow_schema = to_arrow_schema(schema)
    centres = pick_pivots(x, pivots, dim)
    if not len(centres):
        return items.sparkSession.createDataFrame([], schema)
    bounded_batches(items.sparkSession)
    x = materialize_once(with_nearest(x, centres, dim), "groups")
    q = materialize_once(with_nearest(q, centres, dim).withColumnRenamed("pivot", "home").drop("angle"), "queries")
    known = x.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect()
    sizes, spans = {r.pivot: r.n for r in known}, [(r.pivot, r.low, r.high) for r in known]
    items_cut = parts_of(F.col("pivot"), sizes, items_per_block)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("angle")
        toward, bound, beside = (np.asarray(t[c]) for t, c in ((left, "toward"), (left, "bound"), (right, "angle")))
        reach = np.arccos(np.clip(np.maximum(bound, minimum), -1, 1)) + SLACK

        def skip(part: slice) -> np.ndarray:
            near = beside[part]
            far = (toward - reach > near[-1]) | (toward + reach < near[0])
            if compared is not None:
                compared.add(int((~far).sum()) * len(near))
            return far

        found = _compare(
            np.asarray(left["id"].to_pylist()), _matrix(left["vec"], dim),
            [set(a) for a in left["allowed"].to_pylist()] if filtered else None,
            np.asarray(right["id"].to_pylist()), _matrix(right["vec"], dim),
            right["class"].to_pylist() if filtered else None, k, minimum, skip,
        )
        return pa.Table.from_pandas(found, schema=arrow_schema, preserve_index=False)

    def meet(asked: DataFrame) -> DataFrame:
        """Scores of queries with the items of the groups that they are to meet."""
        asked = materialize_once(asked, "asked")
        wanted = {r.pivot: r["count"] for r in asked.groupBy("pivot").count().collect()}
        if not wanted:
            return items.sparkSession.createDataFrame([], schema)
        queries_cut = parts_of(F.col("pivot"), wanted, queries_per_block)
        mine = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
        all_parts = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
        left = asked.withColumn("qb", mine(queries_cut)).withColumn("xb", all_parts(items_cut))
        right = x.where(F.col("pivot").isin(list(wanted))).withColumn("xb", mine(items_cut)).withColumn("qb", all_parts(queries_cut))
        keys = ["pivot", "qb", "xb"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, schema)

    best = [F.col("score").desc(), F.col("item_id").asc()]
    own = open_groups(q.withColumn("bound", F.lit(-1.0)), centres, spans, dim, minimum).where(F.col("pivot") == F.col("home"))
    first = materialize_once(top_per_key(meet(own), ["query_id"], best, k), "first")
    reached = first.groupBy(F.col("query_id").alias("id")).agg(
        F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(-1.0).alias("bound")
    )
    bounded = q.join(reached, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(-1.0)))
    others = open_groups(bounded, centres, spans, dim, minimum).where(F.col("pivot") != F.col("home"))
    return top_per_key(first.unionByName(meet(others)), ["query_id"], best, k)
