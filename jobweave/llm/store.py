"""Tables in the shared folder, and small column helpers of the operators."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.session import new_path

#: Frees the shuffle files of a finished write, so that a job with several steps does not pile them up.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a batch of rows that goes to or from a Python worker; a session's own lower limit stands.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Stands for a null document id in keys.
NO_ID = -(2**63)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the folder of ``spark.checkpoint.dir`` and read back.

    Cuts the lineage in a form that outlives executors.
    """
    spark = df.sparkSession
    path, before = new_path(spark, label), spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def mark_of(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def bound_batches(spark: SparkSession) -> None:
    """Limits the session's Arrow batches to BATCH_BYTES, so that a worker's memory doesn't grow with the length of texts."""
    set_already = spark.conf.get(BATCH_SETTING, None)
    if set_already is None or not set_already.isdigit() or int(set_already) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def keyed(documents: DataFrame) -> DataFrame:
    """Key, mark of the text and text of each document; all other columns are left out.

    The key is the id, with NO_ID for null. The mark is the text's whole
    64-bit hash: it keeps apart different texts that share an id or have none.
    """
    bound_batches(documents.sparkSession)
    return documents.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"),
        mark_of("text").alias("mark"),
        F.col("text").cast("string").alias("text"),
    )


def id_of(key: Column) -> Column:
    return F.when(key != NO_ID, key)


def returning_memory(work: Callable) -> Callable:
    """A generator that gives freed memory back to the system once it ends.

    Python workers are kept for later tasks, and would keep what they no longer use.
    """

    @functools.wraps(work)
    def run(*args, **kwargs):
        try:
            yield from work(*args, **kwargs)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run
