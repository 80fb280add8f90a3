"""From raw documents to packed training sequences: five stages, each one operator of ``jobweave.llm``."""

from __future__ import annotations

import warnings

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.llm.debruijn import remove_repeated_spans
from jobweave.llm.labelled import training_sample
from jobweave.llm.oddsketch import near_duplicates
from jobweave.llm.packing import pack
from jobweave.llm.store import mark_of, stored
from jobweave.llm.toxicity import SAMPLE_LONGEST, SAMPLE_ROWS, toxic_score, train
from jobweave.llm.winnowing import decontaminate

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "word_bpe_49k.json"


def same_document(documents: DataFrame, found: DataFrame) -> Column:
    return documents["doc_id"].eqNullSafe(found["doc_id"]) & (documents["mark"] == found["mark"])


def marked(documents: DataFrame) -> DataFrame:
    return documents.select(*DOCUMENT, mark_of("text").alias("mark"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5; all, with a warning, where the training labels lack either class."""
    sample = training_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", SAMPLE_ROWS, SAMPLE_LONGEST)
    if {label for _, label in sample} != {0, 1}:
        warnings.warn("no toxic or no ordinary text to learn from: no document is dropped as toxic", stacklevel=2)
        return docs.select(*DOCUMENT)
    score = toxic_score(train(sample))
    return docs.select(*DOCUMENT).where(score(F.col("text")) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document with the smallest id; of equal rows one."""
    kept = near_duplicates(docs, shingle=5, similarity=0.8).where("kept").select("doc_id", "mark").distinct()
    documents = marked(docs)
    return documents.join(kept, same_document(documents, kept), "left_semi").dropDuplicates(["doc_id", "mark"]).select(*DOCUMENT)


def cut_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-word windows that occur elsewhere too; texts without such windows stay as they are."""
    cut = remove_repeated_spans(docs, span=50).where("n_removed > 0").select("doc_id", "mark", "kept").distinct()
    documents = marked(docs)
    joined = documents.join(cut, same_document(documents, cut), "left")
    text = F.coalesce(cut["kept"], documents["text"])
    changed = cut["kept"].isNotNull()
    return joined.select(
        documents["doc_id"], text.alias("text"), documents["lang"], documents["source"],
        F.when(changed, F.char_length(text).cast("long")).otherwise(documents["n_chars"]).alias("n_chars"),
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without enough words of benchmark items to count as contaminated."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").select("doc_id", "mark").distinct()
    documents = marked(docs)
    return documents.join(found, same_document(documents, found), "left_anti").select(*DOCUMENT)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each token piece of each document stands in sequences of 4096 tokens."""
    return pack(docs, public_tokenizers.path(TOKENIZER), capacity=4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_spans),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Dictionaries, sketches and packing have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
