"""Queries of the dedup operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.llm.debruijn import remove_repeated_spans
from jobweave.llm.oddsketch import near_duplicates
from jobweave.llm.suffixes import remove_later_copies
from jobweave.plans.registry import query


@query("op2_debruijn_spans")
def op2_debruijn_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), span=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_deep_shallow_dedup")
def op10_deep_shallow_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_later_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"), span=100)
    return out.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op5_odd_sketch_dedup")
def op5_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4, similarity=0.8).drop("mark")
