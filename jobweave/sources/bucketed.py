"""INC2, SNK4: stored tables that are updated bucket by bucket.

A row's bucket is a hash of its key, and a partition folder of the table. An
upsert rewrites only the buckets in which some row really changes; the files of
all others stay as they are. Choose the number of buckets so that one is about
a task's worth of data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.operators.staging import latest_per_key

BUCKET = "_bucket"


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int")


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows, without the bucket column."""
    return spark.read.parquet(path).drop(BUCKET)


def _write(df: DataFrame, path: str) -> None:
    """Replaces the buckets that ``df`` has rows for. They are staged first, so ``df`` may read from ``path``."""
    (
        df.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(BUCKET).parquet(path)
    )


def create_bucketed(df: DataFrame, path: str, keys: list[str], ts: str, buckets: int, tie_break: list[str] | None = None) -> None:
    """Stores the newest row per key. ``path`` must be new; the table always has a folder, also without rows."""
    rows = latest_per_key(df, keys, [ts], tie_break or []).withColumn(BUCKET, bucket_of(keys, buckets))
    rows.repartition(BUCKET).write.mode("errorifexists").partitionBy(BUCKET).parquet(path)


def changes(stored: DataFrame, fresh: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """The offered rows that are missing or newer than the stored one. Reads keys and stamps of the stored table only."""
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    same.append(F.col(f"o.{BUCKET}") == F.col(f"n.{BUCKET}"))
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    # a stored row that is as new rules an offered one out; a null stamp is older than any other
    as_new = F.col(f"o.{ts}") >= F.col(f"n.{ts}")
    rules_out = condition & (as_new | F.col(f"n.{ts}").isNull())
    return fresh.alias("n").join(stored.select(*keys, ts, BUCKET).alias("o"), rules_out, "left_anti")


def upsert_bucketed(
    spark: SparkSession,
    path: str,
    source: DataFrame,
    keys: list[str],
    ts: str,
    buckets: int,
    update_cols: list[str] | None = None,
    tie_break: list[str] | None = None,
) -> list[int]:
    """INC2: stored rows that ``source`` has newer versions of are updated, missing ones inserted.

    Returns the buckets that were rewritten (numbers below ``buckets``, all that
    comes to the driver). First the changed rows are found by keys and stamps in
    the buckets that the source falls into; then only the buckets with a change
    are read whole, merged in one join and written. A replay changes no row, so it
    writes no file. ``update_cols``: what an update sets besides the stamp; all
    columns by default. ``keys``, ``ts`` and ``buckets`` are those of the table's
    creation. Null keys are keys like others. One writer at a time.
    """
    table = spark.read.parquet(path)
    columns = [c for c in table.columns if c != BUCKET]
    fresh = latest_per_key(source, keys, [ts], tie_break or []).select(
        *[(F.col(c) if c in source.columns else F.lit(None)).cast(table.schema[c].dataType).alias(c) for c in columns]
    ).withColumn(BUCKET, bucket_of(keys, buckets))
    offered = [r[0] for r in fresh.select(BUCKET).distinct().collect()]
    changed = changes(table.filter(F.col(BUCKET).isin(offered)), fresh, keys, ts)
    touched = sorted(r[0] for r in changed.select(BUCKET).distinct().collect())
    if not touched:
        return []
    old = table.filter(F.col(BUCKET).isin(touched)).alias("o").withColumn("_old", F.lit(True))
    # joined on the bucket too, so that both sides are shuffled by what the write needs
    new = changed.withColumn("_new", F.lit(True))
    condition = old[BUCKET] == new[BUCKET]
    for k in keys:
        condition = condition & old[k].eqNullSafe(new[k])
    merged = old.join(new, condition, "full_outer")
    set_cols = set(update_cols or columns) | {ts, *keys}
    _write(
        merged.select(
            *[
                F.when(new["_new"] & (old["_old"].isNull() if c not in set_cols else F.lit(True)), new[c]).otherwise(old[c]).alias(c)
                for c in columns
            ],
            F.coalesce(old[BUCKET], new[BUCKET]).alias(BUCKET),
        ),
        path,
    )
    spark.catalog.refreshByPath(path)
    return touched
