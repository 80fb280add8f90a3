"""SRC: readers for scraped JSON, filing CSV and company lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobweave import schemas
from jobweave.functions import text as tx


def read_scraped_json(spark: SparkSession, path: str, schema: T.StructType = schemas.JOBS_RAW) -> DataFrame:
    """SRC1: scraped postings in the unified schema, the full record kept as JSON.

    Takes array-of-objects files and one-object-per-line files. An array file
    is read by one task, so feeds should be landed as many files.
    """
    return typed_records(read_records(spark, path, multi_line=True), schema)


def read_scraped_lines(spark: SparkSession, path: str, schema: T.StructType = schemas.JOBS_RAW) -> DataFrame:
    """SRC1 for line-delimited feeds, which split across tasks inside a file."""
    return typed_records(read_records(spark, path), schema)


def read_records(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """SRC1: every record whole, as a variant, with its file; what does not parse comes with its text in ``corrupt``."""
    rows = (
        spark.read.option("singleVariantColumn", "record").option("columnNameOfCorruptRecord", "corrupt")
        .schema("record variant, corrupt string").json(path, multiLine=multi_line, mode="PERMISSIVE")
    )
    each = F.coalesce(F.try_variant_get("record", "$", "array<variant>"), F.array("record"))  # of an array its elements
    return rows.select(F.explode(each).alias("record"), "corrupt", F.col("_metadata.file_path").alias("file"))


def typed_records(records: DataFrame, schema: T.StructType = schemas.JOBS_RAW) -> DataFrame:
    """Records in a schema, NULL where a value does not fit; ``raw_json`` keeps all fields, also those outside the schema."""
    fields = [
        F.try_variant_get("record", f"$.{f.name}", "string" if isinstance(f.dataType, T.TimestampNTZType) else f.dataType.simpleString())
        .try_cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]
    return records.where("record is not null").select(*fields, F.to_json("record").alias("raw_json"))


def schema_drift(records: DataFrame, schema: T.StructType = schemas.JOBS_RAW, by: str = "source") -> DataFrame:
    """SRC1: per feed the top-level fields that the schema lacks, and in how many records each stands."""
    known = [F.lit(n) for n in schema.names]
    names = F.map_keys(F.from_json(F.to_json("record"), "map<string,string>"))
    rows = records.where("record is not null").select(
        F.try_variant_get("record", f"$.{by}", "string").alias(by), F.explode(F.array_except(names, F.array(*known))).alias("field")
    )
    return rows.groupBy(by, "field").agg(F.count(F.lit(1)).alias("records"))


def good_and_rejected(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without a ``reason``, and the others with it: together all rows."""
    marked = rows.withColumn("reject_reason", reason)
    return marked.where("reject_reason is null").drop("reject_reason"), marked.where("reject_reason is not null")


def load_clean(df: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """Load step of SNK1: blanks and ``nan`` to NULL, texts whole.

    ``limits`` (such as ``schemas.MAX_LENGTHS``) shortens columns for a store of
    fixed widths.
    """
    limits, out = limits or {}, df
    for field in df.schema.fields:
        if not isinstance(field.dataType, T.StringType) or field.name == "raw_json":
            continue
        col = tx.null_clean(F.col(field.name))
        if field.name in limits:
            col = tx.truncate_ellipsis(col, limits[field.name])
        out = out.withColumn(field.name, col)
    return out


def read_lca_csv(
    spark: SparkSession, path: str, schema: T.StructType, state: str = "WORKSITE_STATE", multi_line: bool = False
) -> DataFrame:
    """SRC2: the good rows of ``read_lca_rows``: short and long rows are tolerated, those without a worksite state are not."""
    return read_lca_rows(spark, path, schema, state, multi_line, strict=False)[0].drop("corrupt", "file")


def read_lca_rows(
    spark: SparkSession, path: str, schema: T.StructType, state: str = "WORKSITE_STATE", multi_line: bool = True, strict: bool = True,
    header: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """SRC2: filings from quoted CSV with a header: good rows, and rejected ones with their reason, text and file.

    With ``multi_line`` a quoted line break stays in its row, and a file is read
    by one task. ``strict`` rejects rows with too few or too many fields too.
    """
    kept = T.StructType([*schema.fields, T.StructField("corrupt", T.StringType())])
    rows = spark.read.csv(
        path, schema=kept, header=header, quote='"', escape='"', mode="PERMISSIVE", multiLine=multi_line, columnNameOfCorruptRecord="corrupt"
    ).select(*kept.names, F.col("_metadata.file_path").alias("file"))
    reason = F.when(F.col(state).isNull(), "no worksite state")
    if strict:
        reason = F.when(F.col("corrupt").isNotNull(), "fields do not fit").otherwise(reason)
    return good_and_rejected(rows, reason)


def normalize_headers(df: DataFrame) -> DataFrame:
    """SRC3"""
    return df.toDF(*[c.lower().replace(" ", "_").replace("-", "_") for c in df.columns])


def coerce_types(df: DataFrame, dates: list[str], numerics: list[str], as_of: str) -> DataFrame:
    """SRC4: typed columns, NULL where a value does not parse, and a load stamp."""
    changes = {c: F.col(c).try_cast("date") for c in dates if c in df.columns}
    changes |= {c: F.col(c).try_cast("double") for c in numerics if c in df.columns}
    return df.withColumns(changes).withColumn("loaded_at", F.lit(as_of).cast("timestamp_ntz"))


def copy_json_rows(spark: SparkSession, path: str, as_of: str) -> tuple[DataFrame, DataFrame]:
    """SRC5: one JSON document per line with its ``source``, and the lines that are none with their file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    parsed = lines.where("trim(value) <> ''").withColumn("job_data", F.try_parse_json("value"))
    good, bad = good_and_rejected(parsed, F.when(F.col("job_data").isNull(), "not JSON"))
    documents = good.select(
        "job_data",
        F.lit(as_of).cast("timestamp_ntz").alias("scraped_at"),
        F.try_variant_get("job_data", "$.source", "string").alias("source"),
    )
    return documents, bad.drop("job_data")


def copy_json_with_source(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    """SRC5: the good documents of ``copy_json_rows``."""
    return copy_json_rows(spark, path, as_of)[0]


def load_company_list(df: DataFrame, name: str = "company_name", url: str = "final_career_url") -> DataFrame:
    """SRC6: companies with a usable careers URL."""
    link = F.trim(F.coalesce(F.col(url), F.lit("")))
    unverified = F.coalesce(F.col("verified").cast("string"), F.lit("False")) == "False"
    return df.filter(
        (link != "") & ~link.contains("No central") & ~(unverified & ~link.startswith("http"))
    ).select(F.col(name).alias("name"), link.alias("url"))
