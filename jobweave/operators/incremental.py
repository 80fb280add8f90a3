"""INC1-INC7, JN6-JN8: incremental upkeep of stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.functions import rules
from jobweave.operators.staging import latest_per_key, top_per_key


def new_keys(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """JN6, INC1, INC3: rows whose key is not stored yet."""
    return source.join(target.select(*keys), keys, "left_anti")


def known_keys(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """JN7"""
    return source.join(target.select(*keys), keys, "left_semi")


def append_new(target: DataFrame, source: DataFrame, keys: list[str], order: list[str], tie_break: list[str]) -> DataFrame:
    """INC1: rows to append, one per new key."""
    return latest_per_key(new_keys(source, target, keys), keys, order, tie_break)


def missing_or_newer(source: DataFrame, target: DataFrame, key: str, ts: str) -> DataFrame:
    """JN8: distinct keys that are not stored or stored with an older stamp."""
    stored = target.groupBy(key).agg(F.max(ts).alias("_stored"))
    offered = source.groupBy(key).agg(F.max(ts).alias("_offered"))
    return (
        offered.join(stored, key, "left")
        .filter(F.col("_stored").isNull() | (F.col("_offered") > F.col("_stored")))
        .select(key)
    )


def upsert_newer(
    target: DataFrame,
    source: DataFrame,
    keys: list[str],
    ts: str,
    update_cols: list[str] | None = None,
    tie_break: list[str] | None = None,
) -> DataFrame:
    """INC2: the target after updating older rows and inserting missing ones.

    The source is cut to its newest row per key first. It is usually small next
    to the target, and then both joins leave the target where it is. Replaying
    the same source changes nothing.
    """
    update_cols = update_cols or [c for c in target.columns if c not in keys]
    fresh = latest_per_key(source, keys, [ts], tie_break or [])
    offered = fresh.select(*keys, F.struct(*[c for c in fresh.columns if c in target.columns]).alias("_new"))
    newer = F.col(f"_new.{ts}") > F.col(ts)
    changed = set(update_cols) | {ts}
    kept = target.join(offered, keys, "left").select(
        *[
            F.when(newer, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c)
            for c in target.columns
        ]
    )
    added = new_keys(fresh, target, keys)
    return kept.unionByName(added.select(*[c for c in target.columns if c in added.columns]), allowMissingColumns=True)


def cache_lookup(items: DataFrame, cache: DataFrame, key: str, as_of: str, ttl_days: int = 7) -> DataFrame:
    """INC4: items with their cached answer, NULL when there is none or it is too old."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(ttl_days))
    alive = cache.filter(F.col("cached_at") >= cutoff)
    return items.join(alive, key, "left").withColumn("from_cache", F.col("cached_at").isNotNull())


def cache_upsert(cache: DataFrame, answers: DataFrame, key: str, as_of: str) -> DataFrame:
    """INC4: the cache after storing new answers, one per key (of several the one that sorts last)."""
    others = [F.col(c).desc_nulls_last() for c in answers.columns if c != key]
    stamped = top_per_key(answers, [key], others or [F.col(key)]).withColumn("cached_at", F.lit(as_of).cast("timestamp_ntz"))
    old = cache.join(stamped.select(key), key, "left_anti")
    return old.unionByName(stamped.select(*cache.columns))


def classify_with_cache(
    jobs: DataFrame, cache: DataFrame, as_of: str, ttl_days: int = 7, key: str = "url", **flags: Column
) -> DataFrame:
    """INC4, CLF6: cached answer where alive, else explicit flags, else keywords."""
    looked = cache_lookup(jobs, cache, key, as_of, ttl_days)
    fresh = rules.classify_visa(F.concat_ws(" ", "title", "description"), **flags)
    hit = F.col("from_cache")
    # the rules run once a row: each of their columns would otherwise run them again
    return looked.withColumn("_answer", F.when(~hit, fresh)).select(
        *jobs.columns,
        F.when(hit, F.col("cached_category")).otherwise(F.col("_answer.visa_category")).alias("visa_category"),
        F.when(hit, F.col("cached_confidence")).otherwise(F.col("_answer.confidence")).alias("confidence"),
        F.when(hit, "cache").otherwise(F.col("_answer.method")).alias("method"),
    )


def update_unclassified(jobs: DataFrame, as_of: str, **flags: Column) -> DataFrame:
    """INC5: rows without a visa class get one; the others stay as they are.

    Classified rows are not touched by the keyword rules: the expressions sit
    behind the test for a missing class. A row for which the rules find nothing
    ("Unknown") stays open, so that a later run tries it again.
    """
    missing = F.col("visa_category").isNull() | (F.col("visa_category") == "")
    answer = F.when(missing, rules.classify_visa(F.concat_ws(" ", "title", "description"), **flags))
    todo = F.coalesce(F.col("_answer.visa_category") != "Unknown", F.lit(False))

    def stored(column: str, kind: str) -> Column:
        return F.col(column) if column in jobs.columns else F.lit(None).cast(kind)

    merged = {
        "visa_category": F.when(todo, F.col("_answer.visa_category")).otherwise(F.col("visa_category")),
        "classification_confidence": F.when(todo, F.col("_answer.confidence")).otherwise(
            F.col("classification_confidence")
        ),
        "classification_signals": F.when(todo, F.col("_answer.signals")).otherwise(
            stored("classification_signals", "array<string>")
        ),
        "classified_at": F.when(todo, F.lit(as_of).cast("timestamp_ntz")).otherwise(stored("classified_at", "timestamp_ntz")),
    }
    # all at once: each of them tests the stored class
    return jobs.withColumn("_answer", answer).withColumns(merged).drop("_answer")


def pending_work(
    items: DataFrame, done: DataFrame, key: str, as_of: str, batch: int = 150, reset_days: int = 7
) -> DataFrame:
    """INC6: the next items to work on; progress older than ``reset_days`` is forgotten."""
    last = done.agg(F.max("completed_at").alias("last")).scalar()
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(reset_days))
    valid = done.withColumn("_last", last).filter(F.col("_last") >= cutoff).select(key)
    return items.join(valid, key, "left_anti").orderBy(key).limit(batch)
