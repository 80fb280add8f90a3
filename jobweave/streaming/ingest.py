"""INC8: stream ingest of scraped files with deduplication and upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from jobweave import schemas
from jobweave.operators.staging import latest_per_key


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType = schemas.JOBS_RAW, fmt: str = "json", max_files: int = 1000
) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files).load(path)


def dedup_stream(stream: DataFrame, keys: list[str], ts: str, delay: str = "1 day") -> DataFrame:
    """First arrival per key within the watermark; state is dropped after ``delay``."""
    timed = stream.withColumn("_event_time", F.col(ts).cast("timestamp")).withWatermark("_event_time", delay)
    return timed.dropDuplicatesWithinWatermark(keys).drop("_event_time")


def start_ingest(
    stream: DataFrame, change_log: str, checkpoint: str, keys: list[str], ts: str, tie_break: list[str]
) -> StreamingQuery:
    """Write each micro-batch, one row per key, to its own folder of a change log.

    A batch costs what it brings: the stored table is not rewritten. A batch
    that runs twice replaces its own folder, so a restart stores nothing twice.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        latest = latest_per_key(batch, keys, [ts], tie_break)
        latest.write.mode("overwrite").parquet(f"{change_log}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_rows(spark: SparkSession, change_log: str, keys: list[str], ts: str, tie_break: list[str]) -> DataFrame:
    """The table as of now: the newest row per key of the change log."""
    log = spark.read.parquet(change_log)
    return latest_per_key(log, keys, [ts, "batch_id"], tie_break).drop("batch_id")


def compact(spark: SparkSession, change_log: str, target: str, keys: list[str], ts: str, tie_break: list[str]) -> None:
    """Fold the log into one batch of a new log; the old one can then be dropped."""
    current_rows(spark, change_log, keys, ts, tie_break).write.mode("errorifexists").parquet(f"{target}/batch_id=0")
