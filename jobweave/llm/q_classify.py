"""Queries of the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.llm.linecrf import quality
from jobweave.llm.store import id_of
from jobweave.llm.toxicity import toxicity
from jobweave.plans.registry import query


def scored(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.select(
        id_of(F.col("key")).alias("doc_id"), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


@query("op7_line_crf_quality")
def op7_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return scored(quality(documents, labels), 0.3)


@query("op8_compression_toxicity")
def op8_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return scored(toxicity(documents, labels), 0.5)
