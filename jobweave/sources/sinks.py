"""SNK: writers and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.sources import bucketed

# Columns of the exported posting list.
EXPORT_COLUMNS = [
    "category", "title", "company", "location", "work_model", "salary", "date_posted", "company_size",
    "company_industry", "h1b_sponsored", "is_new_grad", "qualifications", "url",
]


def append_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """SNK1"""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """SNK2. ``path`` must not be an input of ``df``."""
    df.write.mode("overwrite").parquet(path)


def write_outputs(df: DataFrame, path: str, columns: list[str] = EXPORT_COLUMNS, compression: str | None = None) -> None:
    """SNK3: all columns as JSON, a fixed subset as CSV; missing columns are empty. ``compression`` is that of Spark's writers."""
    df.write.mode("overwrite").json(f"{path}/json", compression=compression)
    subset = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
    df.select(*subset).write.mode("overwrite").csv(
        f"{path}/csv", compression=compression, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def materialize(
    df: DataFrame, name: str, kind: str = "view", path: str | None = None,
    keys: list[str] | None = None, ts: str | None = None, buckets: int = 64, tie_break: list[str] | None = None,
) -> DataFrame:
    """SNK4: publish ``df`` as a temporary view, as a stored table, or as an incremental one.

    An incremental table is created by the first run; later runs update and
    insert by ``keys`` where ``ts`` is newer, in the buckets concerned only.
    """
    spark = df.sparkSession
    if kind not in ("view", "table", "incremental"):
        raise ValueError(f"kind is view, table or incremental, not {kind!r}")
    if kind != "view" and path is None:
        raise ValueError("a stored table needs a path")
    if kind == "table":
        replace_table(df, path)
        df = spark.read.schema(df.schema).parquet(path)
    elif kind == "incremental":
        if not keys or not ts:
            raise ValueError("an incremental table needs keys and a time stamp")
        if path_exists(spark, path):
            bucketed.upsert_bucketed(spark, path, df, keys, ts, buckets, tie_break=tie_break)
        else:
            bucketed.create_bucketed(df, path, keys, ts, buckets, tie_break)
        df = bucketed.read_bucketed(spark, path)
    df.createOrReplaceTempView(name)
    return df


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def retention_prune(df: DataFrame, ts: str, days: int, as_of: str) -> DataFrame:
    """SNK5: rows of the last ``days`` days.

    On a table partitioned by ``ts`` the predicate prunes whole partitions.
    """
    return df.filter(F.col(ts) >= F.date_sub(F.lit(as_of).cast("date"), days))


def save_partitioned(df: DataFrame, table: str, date_column: str) -> None:
    """A catalog table with a partition for each date, which ``drop_old_partitions`` can prune."""
    df.write.mode("errorifexists").partitionBy(date_column).format("parquet").saveAsTable(table)


def drop_old_partitions(spark: SparkSession, table: str, date_column: str, days: int, as_of: str) -> list[str]:
    """SNK5 for catalog tables: drops the partitions older than ``days`` days, by the catalog alone.

    No row is read and no kept file touched. Returns the dropped dates; the driver
    handles the list of the table's partitions, never their rows.
    """
    names = [r[0] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()]
    dates = spark.createDataFrame([(n.split("=", 1)[1],) for n in names], "day string")
    old = dates.filter(F.col("day").try_cast("date") < F.date_sub(F.lit(as_of).cast("date"), days))
    dropped = sorted(r[0] for r in old.collect())
    for first in range(0, len(dropped), 100):
        specs = ", ".join(f"PARTITION ({date_column} = '{day}')" for day in dropped[first : first + 100])
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {specs}")
    return dropped
