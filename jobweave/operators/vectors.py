"""VEC1, VEC2, UDF1: embeddings and exact nearest items by cosine."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from jobweave.functions import rules
from jobweave.operators.staging import top_per_key
from jobweave.session import bounded_batches

# Largest query set sent to every task: 4096 queries of 768 numbers are 25 MB.
BROADCAST_QUERIES = 4096
# Items per block of the blocked plan.
ITEMS_PER_BLOCK = 50_000
# Blocks travel together as far as their vectors, as doubles, fill so many bytes: a task holds two such tiles.
TILE_BYTES = 32 << 20
# Tiles a core, if there are blocks enough, so that no core is left waiting.
TILES_PER_CORE = 4
# Items whose scores are held at a time.
_CHUNK = 2048
# Queries whose scores with a chunk of items are held at a time: 4 MB of numbers.
_ASKED = 512
# Pairs scored in double precision at a time.
_PAIRS = 1 << 14


class BatchScorer:
    """UDF1: hook for a model that scores whole column batches.

    ``score`` takes a pandas Series per Arrow batch; ``load`` runs once per
    Python worker, for models that are costly to open.
    """

    def __init__(self, score: Callable[..., pd.Series], returns: str | T.DataType, load: Callable[[], object] | None = None):
        self.score, self.returns, self.load = score, returns, load

    def __call__(self, col: Column) -> Column:
        score, load = self.score, self.load

        @F.pandas_udf(self.returns)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load() if load else None
            for batch in batches:
                yield score(batch, model) if load else score(batch)

        return run(col)


def hashed_slots(text: Column, dim: int) -> Column:
    """Signed slot per token: the absolute value minus one is the slot, the sign its direction."""

    def slot(token: Column) -> Column:
        code = F.xxhash64(token)
        place = (F.pmod(code, F.lit(dim)) + 1).cast("int")
        return F.when(F.pmod(F.shiftright(code, 32), F.lit(2)) == 0, place).otherwise(-place)

    return F.transform(rules.tokens(text), slot)


def _fold(dim: int) -> Callable[[pd.Series], pd.Series]:
    def fold(batch: pd.Series) -> pd.Series:
        held = [np.asarray(slots, dtype=np.int64) if slots is not None else np.zeros(0, np.int64) for slots in batch]
        places = np.concatenate(held) if held else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(held)), [len(h) for h in held])
        sums = np.bincount(row * dim + np.abs(places) - 1, weights=np.sign(places), minlength=len(held) * dim).astype(np.float64).reshape(-1, dim)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        return pd.Series(list(np.divide(sums, norms, out=sums, where=norms > 0).astype(np.float32)), index=batch.index)

    return fold


def embed(df: DataFrame, text: Column, dim: int = 768, output: str = "embedding", scorer: BatchScorer | None = None) -> DataFrame:
    """VEC1: a unit vector per row.

    The default hashes tokens into ``dim`` signed slots. Tokens are cut and
    hashed in the JVM; Python only adds the slots up, batch by batch. A hosted
    model replaces it through ``scorer``, which then gets the text itself.
    """
    if scorer is not None:
        return df.withColumn(output, scorer(text))
    bounded_batches(df.sparkSession)
    return df.withColumn(output, BatchScorer(_fold(dim), "array<float>")(hashed_slots(text, dim)))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Unit rows from an Arrow list column without NULLs."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _best(scores: np.ndarray, item_ids: np.ndarray, k: int, lowest: np.ndarray, slack: float, open_to: np.ndarray | None, exact):
    """Index arrays (query, item) and the scores of the k best items of each query, ties by item id.

    ``scores`` are off by less than half of ``slack``: what they cannot rule out
    is scored again by ``exact(query, item)``. ``lowest`` is what a query's items
    must reach to be of use.
    """
    if open_to is not None:
        scores = np.where(open_to, scores, -np.inf)
    floor = (lowest - slack).astype(scores.dtype)
    many = np.flatnonzero(np.count_nonzero(scores > floor[:, None], axis=1) > 4 * k)
    if len(many):
        floor[many] = np.maximum(floor[many], np.partition(scores[many], -k, axis=1)[:, -k] - scores.dtype.type(slack))
    q, i = np.divmod(np.flatnonzero(scores > floor[:, None]), scores.shape[1])
    score = exact(q, i)
    kept = score >= lowest[q]
    q, i, score = q[kept], i[kept], score[kept]
    first = _first_per_query(q, i, score, item_ids, k)
    return q[first], i[first], score[first]


def _first_per_query(q: np.ndarray, i: np.ndarray, score: np.ndarray, item_ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best, by score and then item id."""
    order = np.lexsort((item_ids[i], -score, q))
    asked = q[order]
    return order[np.arange(len(asked)) - np.searchsorted(asked, asked) < k]


def _compare(qids, qmat, qclasses, ids, mat, classes, k, minimum, skip=None):
    """Rows (query_id, item_id, score) for one block of items, at most k per query. The rows of both matrices are unit vectors.

    Scores in single precision leave out what cannot be among the k best; the
    rest is scored in double precision. ``skip(part)`` may name the queries that a
    chunk of items can be left out for.
    """
    if qclasses is not None:
        # one mask for each different list of open classes
        lists = list(dict.fromkeys(map(frozenset, qclasses)))
        list_of = np.array([lists.index(frozenset(c)) for c in qclasses], dtype=np.int64)
        codes, names = pd.factorize(np.asarray(classes, dtype=object), use_na_sentinel=False)
        masks = np.array([[n in allowed for n in names] for allowed in lists], dtype=bool).reshape(len(lists), len(names))
    rough_q, rough = qmat.astype(np.float32), mat.astype(np.float32)
    whole = bool(np.isfinite(rough_q).all() and np.isfinite(rough).all())
    # rounding of both rows and of the sum, twice, and of the scores to nine digits
    slack = (mat.shape[1] + 8) * 2.0**-22 + 4e-9
    # a score is above the minimum when it is at least the next number
    best = np.full((len(qids), k), np.nextafter(minimum, np.inf))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for start in range(0, len(ids), _CHUNK):
        part = slice(start, start + _CHUNK)
        asked = np.arange(len(qids)) if skip is None else np.flatnonzero(~skip(part))
        for some in (asked[at : at + _ASKED] for at in range(0, len(asked), _ASKED)):
            scores = rough_q[some] @ rough[part].T
            if not whole:  # rows with an infinite number are near nothing
                scores[~np.isfinite(scores)] = -np.inf
            open_to = None
            if qclasses is not None:
                open_to = masks[:, codes[part]][list_of[some]]

            def exact(q: np.ndarray, i: np.ndarray) -> np.ndarray:
                pieces = [slice(at, at + _PAIRS) for at in range(0, len(q), _PAIRS)]
                return np.round(np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", qmat[some[q[p]]], mat[start + i[p]]) for p in pieces)]), 9)  # noqa: B023

            q, i, score = _best(scores, ids[part], k, best[some].min(axis=1), slack, open_to, exact)
            found.append((some[q], start + i, score))
            place = np.arange(len(q)) - np.searchsorted(q, q)
            reached = np.full((len(some), k), -np.inf)
            reached[q, place] = score
            best[some] = np.partition(np.hstack([best[some], reached]), k, axis=1)[:, k:]
    q, i, score = map(np.concatenate, zip(*found))
    first = _first_per_query(q, i, score, ids, k)
    return pd.DataFrame({"query_id": qids[q[first]], "item_id": ids[i[first]], "score": score[first]})


def _nearest_copies(mat: np.ndarray, codes: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows without those that have k rows with the same vector and code, and smaller ids, before them."""
    rows = np.ascontiguousarray(np.hstack([mat, codes[:, None].astype(np.float64)]))
    _, same = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel(), return_inverse=True)
    return np.sort(_first_per_query(same, np.arange(len(ids)), np.zeros(len(ids)), ids, k))


def _numbered(ids: pa.ChunkedArray) -> tuple[np.ndarray, pa.ChunkedArray]:
    """Numbers in the order of the ids, null first, and the ids by number."""
    order = pc.sort_indices(ids, null_placement="at_start")
    numbers = np.empty(len(ids), dtype=np.int64)
    numbers[np.asarray(order)] = np.arange(len(ids))
    return numbers, ids.take(order)


def _checked_vectors(df: DataFrame, id_col: str, vec: str, dim: int, extra: list[Column], names: list[str]) -> DataFrame:
    """Rows with a whole vector of the right length."""
    whole = (F.size(vec) == dim) & ~F.exists(vec, lambda x: x.isNull())
    return df.filter(F.col(vec).isNotNull() & whole).select(
        F.col(id_col).alias("id"), F.col(vec).alias("vec"), *[e.alias(n) for e, n in zip(extra, names)]
    )


def rejected_vectors(df: DataFrame, id_col: str, vec: str, dim: int) -> DataFrame:
    """VEC2: the rows that ``cosine_topk`` leaves out, and why."""
    size = F.size(vec)
    reason = (
        F.when(F.col(vec).isNull(), "no vector").when(size != dim, F.concat(F.lit("length "), size))
        .when(F.exists(vec, lambda x: x.isNull()), "a number is missing")
    )
    return df.select(F.col(id_col).alias("id"), reason.alias("reason")).filter("reason is not null")


def tiles(spark: SparkSession, blocks: int, rows: int, dim: int) -> int:
    """Tiles of ``blocks`` blocks of so many rows: as large as TILE_BYTES allow, but enough for all cores to work."""
    most = max(1, TILE_BYTES // (8 * dim * rows))
    busy = math.isqrt(TILES_PER_CORE * spark.sparkContext.defaultParallelism - 1) + 1
    return max(math.ceil(blocks / most), min(blocks, busy))


def cosine_topk(
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
    broadcast_queries: int = BROADCAST_QUERIES,
    items_per_block: int = ITEMS_PER_BLOCK,
) -> DataFrame:
    """VEC2: the ``k`` items closest to each query, cosine above ``minimum``.

    Exact. A query set of at most ``broadcast_queries`` rows goes to every
    task, which multiplies it with its own item batches and emits at most ``k``
    rows per query and batch; the items are never shuffled. A larger set is cut
    into blocks of that size. Every item block meets every query block; blocks
    travel in tiles of at most TILE_BYTES (one block, if that is larger), so that a
    row is copied once for each tile of the other side and not for each block,
    and no task holds more than two tiles. Of items with the same vector only
    the first ``k`` are compared.
    ``allowed`` is a query column listing the item classes open to the query.
    """
    filtered = item_class is not None and allowed is not None
    spark = items.sparkSession
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

    bounded_batches(spark)
    head = q.limit(broadcast_queries + 1).toArrow()
    if head.num_rows <= broadcast_queries:
        held = spark.sparkContext.broadcast(
            (
                np.asarray(head["id"].to_pylist()),
                _matrix(head["vec"], dim),
                [set(a) for a in head["allowed"].to_pylist()] if filtered else None,
            )
        )

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, qmat, qclasses = held.value
            for batch in batches:
                ids = np.asarray(batch.column("id").to_pylist())
                classes = batch.column("class").to_pylist() if filtered else None
                found = _compare(qids, qmat, qclasses, ids, _matrix(batch.column("vec"), dim), classes, k, minimum)
                yield pa.RecordBatch.from_pandas(found, schema=arrow_schema, preserve_index=False)

        candidates = x.mapInArrow(scan, schema)
    else:
        n_q = max(1, math.ceil(q.count() / broadcast_queries))
        n_x = max(1, math.ceil(x.count() / items_per_block))
        t_q, t_x = (tiles(spark, n, size, dim) for n, size in ((n_q, broadcast_queries), (n_x, items_per_block)))
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        # rows that share an id are dealt out by their vectors
        block = lambda n: F.pmod(F.xxhash64("id", "vec"), F.lit(n))
        home = lambda n, t: F.floor(block(n) * t / F.lit(n)).cast("int")
        # as many tasks as tiles that meet, whatever their bytes: the work is in the products
        dealt = lambda df: df.repartition(t_q * t_x, "qt", "xt").groupBy("qt", "xt")
        q_tiles = dealt(q.withColumn("qt", home(n_q, t_q)).withColumn("xt", spread(t_x)))
        x_tiles = dealt(x.withColumn("xt", home(n_x, t_x)).withColumn("qt", spread(t_q)))

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            numbers, ids = _numbered(right["id"])
            mat, classes = _matrix(right["vec"], dim), right["class"].to_pylist() if filtered else None
            codes = pd.factorize(np.asarray(classes, dtype=object), use_na_sentinel=False)[0] if filtered else np.zeros(len(numbers))
            kept = _nearest_copies(mat, codes, numbers, k)
            found = _compare(
                np.arange(left.num_rows),
                _matrix(left["vec"], dim),
                [set(a) for a in left["allowed"].to_pylist()] if filtered else None,
                numbers[kept],
                mat[kept],
                [classes[i] for i in kept] if filtered else None,
                k,
                minimum,
            )
            columns = [left["id"].take(pa.array(found["query_id"], pa.int64())), ids.take(pa.array(found["item_id"], pa.int64())), pa.array(found["score"], pa.float64())]
            return pa.Table.from_arrays(columns, names=arrow_schema.names).cast(arrow_schema)

        candidates = q_tiles.cogroup(x_tiles).applyInArrow(meet, schema)
    return top_per_key(candidates, ["query_id"], [F.col("score").desc(), F.col("item_id").asc()], k)
