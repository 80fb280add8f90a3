"""Session construction and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution picks the number of reducers and splits skewed join
# partitions at run time, so no operator hard-codes a partition count.
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # call-site capture costs several round trips per column expression
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
}


def build_session(app_name: str = "jobweave", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Rows go to Python in batches of at most ``size`` bytes, unless the session asks for smaller ones."""
    known = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    try:
        smaller = known is not None and 0 < int(known) <= size
    except ValueError:  # with a unit, such as the default
        smaller = False
    if not smaller:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local-mode session without the setting gets a fresh folder of its own.
    On a cluster the setting is required: a folder on one machine would be
    lost with that machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="jobweave-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run writes to."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize_once(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage in a form that survives the loss of an executor, and stops a
    costly branch from being computed once per consumer.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Rows of a file scan over all cores when the files have fewer splits than that.

    A file with one row group is read by one task, which would also do all the
    work on its rows. A scan with as many splits as cores is left as it is; one
    with fewer is shuffled once, whatever its size. Hashing on ``keys`` needs no
    sort and gives a repeated task the same rows.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, *keys) if scan.rdd.getNumPartitions() < cores else scan
