"""DQ: checks that return their findings as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobweave import schemas


def _per_key(df: DataFrame, key: str) -> DataFrame:
    """Row count per key; a hot key is combined before the shuffle."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def unique_violations(df: DataFrame, key: str) -> DataFrame:
    """DQ1: keys that occur more than once."""
    return _per_key(df.filter(F.col(key).isNotNull()), key).filter(F.col("n") > 1)


def not_null_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """DQ1: number of missing values per column, one row."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def duplicate_report(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """DQ2: rows, distinct keys and surplus rows per table."""

    def line(name: str, df: DataFrame, key: str) -> DataFrame:
        # NULL keys count as rows but not as a distinct key
        return _per_key(df, key).agg(
            F.lit(name).alias("table_name"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
            F.count(key).alias("unique_keys"),
        )

    report = reduce(DataFrame.unionByName, [line(n, df, key) for n, (df, key) in tables.items()])
    return report.withColumn("duplicates", F.col("total_rows") - F.col("unique_keys"))


def layer_row_counts(layers: dict[str, DataFrame], mart: str | None = None) -> DataFrame:
    """DQ3: rows per layer and a warning for an empty mart."""
    counts = [
        df.agg(F.lit(name).alias("layer"), F.count(F.lit(1)).alias("row_count")) for name, df in layers.items()
    ]
    report = reduce(DataFrame.unionByName, counts)
    return report.withColumn("empty_mart", (F.col("layer") == F.lit(mart or "")) & (F.col("row_count") == 0))


def observed_write(df: DataFrame, path: str, name: str) -> tuple[DataFrame, int]:
    """DQ3: writes a layer and counts its rows in the same pass; the stored layer and the count."""
    seen = Observation(name)
    df.observe(seen, F.count(F.lit(1)).alias("row_count")).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get.get("row_count", 0)


def record_run(spark: SparkSession, path: str, run: str, counts: dict[str, int]) -> None:
    """Appends a run's row counts by layer to the metrics table. Runs sort by name."""
    rows = [(run, layer, n) for layer, n in counts.items()]
    spark.createDataFrame(rows, "run string, layer string, row_count long").coalesce(1).write.mode("append").parquet(path)


def run_report(spark: SparkSession, path: str, run: str, mart: str, threshold: float = 0.2) -> DataFrame:
    """DQ3, DQ4: a run's layers against those of the last run before it; ``empty_mart`` warns of a mart without rows."""
    metrics = spark.read.parquet(path)
    last = metrics.where(F.col("run") < run).agg(F.max("run")).scalar()
    report = row_drop_alert(metrics.where(F.col("run") == run), metrics.where(F.col("run") == last), threshold=threshold)
    return report.withColumn("empty_mart", (F.col("layer") == mart) & (F.col("row_count") == 0))


def row_drop_alert(current: DataFrame, previous: DataFrame, key: str = "layer", threshold: float = 0.2) -> DataFrame:
    """DQ4: layers that lost more than a fifth of their rows."""
    old = previous.select(key, F.col("row_count").alias("previous_count"))
    lost = (F.col("previous_count") - F.col("row_count")) / F.col("previous_count")
    return (
        old.join(current.select(key, "row_count"), key, "left")
        .withColumn("row_count", F.coalesce("row_count", F.lit(0)))
        .withColumn("dropped", F.round(lost, 4))
        .withColumn("alert", F.coalesce(lost > threshold, F.lit(False)))
    )


def missing_columns(df: DataFrame, required: list[str] = schemas.REQUIRED_JOB_COLUMNS) -> list[str]:
    """DQ5"""
    return [c for c in required if c not in df.columns]


def valid_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """DQ5: rows with all of the columns present, of how many."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(whole).alias("valid_rows"))
