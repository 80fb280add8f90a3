"""PRJ1, PRJ9, PRJ10, WIN, SET: staging, deduplication and feed alignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave import schemas
from jobweave.functions import text as tx


def stage_jobs(df: DataFrame, as_of: str, max_age: int = 90) -> DataFrame:
    """PRJ1: trimmed, complete and recent postings.

    Empty companies are dropped as well as missing ones, as an empty name would
    be a prefix of every employer.
    """
    cutoff = F.date_sub(F.lit(as_of).cast("date"), max_age)
    return (
        df.filter(
            F.col("job_id").isNotNull()
            & F.col("title").isNotNull()
            & (F.trim("company") != "")
            & (F.col("scraped_at") >= cutoff)
        )
        .withColumns({c: F.trim(c) for c in ("title", "company", "location")})
        .withColumn("processed_at", F.lit(as_of).cast("timestamp_ntz"))
    )


def top_per_key(df: DataFrame, keys: list[str | Column], order: list[Column], n: int = 1) -> DataFrame:
    """First ``n`` rows per key in ``order``, which must end in a unique column.

    The rank filter is pushed below the shuffle, so each task sends at most
    ``n`` rows per key and a hot key stays small.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def latest_per_key(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    tie_break: list[str],
    drop_ids: list[str] | None = None,
) -> DataFrame:
    """WIN1: newest row per key; ``drop_ids`` removes rows with a missing or listed id."""
    if drop_ids is not None:
        df = df.filter(F.col(keys[0]).isNotNull() & ~F.col(keys[0]).isin(drop_ids))
    ordering = [F.col(c).desc_nulls_last() for c in order] + [F.col(c).asc_nulls_last() for c in tie_break]
    return top_per_key(df, keys, ordering)


def first_per_key(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """SET3, SET4: keep the first row per (possibly computed) key."""
    return top_per_key(df, keys, order)


def keep_first(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """SET3"""
    return first_per_key(df, [F.col(c) for c in columns], [F.col(c).asc_nulls_last() for c in order])


def near_dedup(
    df: DataFrame, order: list[Column], columns: tuple[str, ...] = ("title", "company", "location"), id_col: str | None = None
) -> DataFrame:
    """SET4: one row per case- and space-insensitive key, then one per id."""
    unique = first_per_key(df, tx.near_key(*[F.col(c) for c in columns]), order)
    return first_per_key(unique, [F.col(id_col)], order) if id_col else unique


def newest_with_total(df: DataFrame, key: str, order: list[Column], n: int = 5) -> DataFrame:
    """WIN3: the newest ``n`` rows, each with the row count of its key.

    The counts come from an aggregate, which combines before its shuffle, not
    from a window that would hold all rows of a key in one task.
    """
    totals = df.groupBy(key).agg(F.count(F.lit(1)).alias("total_filings"))
    newest = df.orderBy(*order).limit(n)
    # at most n rows
    return totals.join(F.broadcast(newest), key)


def union_feeds(feeds: list[DataFrame]) -> DataFrame:
    """SET1"""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


def to_unified_schema(df: DataFrame, source: str, constants: dict[str, str] | None = None, **columns: str) -> DataFrame:
    """PRJ10: conform a feed to the posting schema.

    ``columns`` maps a target column to a feed column, ``constants`` sets fixed
    text such as a job type. Empty text becomes NULL.
    """
    constants = {"source": source, **(constants or {})}

    def build(name: str, data_type) -> Column:
        if name in constants:
            return F.lit(constants[name])
        origin = columns.get(name, name)
        if origin not in df.columns:
            return F.lit(None).cast(data_type)
        col = F.col(origin)
        return F.nullif(col, F.lit("")) if dict(df.dtypes)[origin] == "string" else col.cast(data_type)

    return df.select(
        *[build(f.name, f.dataType).cast(f.dataType).alias(f.name) for f in schemas.JOBS_RAW.fields],
        F.to_json(F.struct(*df.columns)).alias("raw_json"),
    )


def build_mart(df: DataFrame, as_of: str) -> DataFrame:
    """PRJ9: final fact projection."""
    columns = [
        "job_id", "source", "url", "title", "company", "location", "description", "snippet", "job_type",
        "posted_date", "scraped_at", "salary_min", "salary_max", "salary_text", "h1b_sponsor",
        "h1b_employer_name", "h1b_city", "h1b_state", "total_petitions", "avg_approval_rate",
        "description_embedding",
    ]
    present = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
    return df.select(*present, F.lit(as_of).cast("timestamp_ntz").alias("mart_created_at"))


def strategy_cascade(strategies: list[DataFrame], page: str, enough: int = 5, combined: int = 3) -> DataFrame:
    """SET5: per page, the first strategy with ``enough`` rows, else their union.

    The union is deduplicated by title and location in strategy order and kept
    when it has at least ``combined`` rows. Rows carry ``pos``, their place in
    the page. Only per-page counts cross the network twice.
    """
    rows = union_feeds([s.withColumn("strategy", F.lit(i)) for i, s in enumerate(strategies)])
    counts = rows.groupBy(page).agg(
        *[F.count_if(F.col("strategy") == i).alias(f"_n{i}") for i in range(len(strategies))]
    )
    chosen = F.lit(None).cast("int")
    for i in reversed(range(len(strategies))):
        chosen = F.when(F.col(f"_n{i}") >= enough, F.lit(i)).otherwise(chosen)
    tagged = rows.join(counts.select(page, chosen.alias("_chosen")), page)
    single = tagged.filter(F.col("strategy") == F.col("_chosen"))
    mixed = first_per_key(
        tagged.filter(F.col("_chosen").isNull()),
        [F.col(page), F.lower("title"), F.lower("location")],
        [F.col("strategy"), F.col("pos")],
    )
    sizes = mixed.groupBy(page).agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") >= combined)
    return single.unionByName(mixed.join(sizes, page, "left_semi")).drop("_chosen")
