"""Queries over readers, writers, streams and data-quality checks.

Each writes rows of the given tables to the shared folder in the format under
test and reads them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobweave import schemas
from jobweave.operators import quality as dq
from jobweave.operators import sponsors as sp
from jobweave.operators import staging as st
from jobweave.plans.q_staging import STAGED_SQL
from jobweave.plans.q_text import STATE_SQL, talks
from jobweave.plans.registry import query
from jobweave.session import new_path
from jobweave.sources import adapters as ad
from jobweave.sources import files, sinks
from jobweave.sources.adapters import AS_OF, FILINGS_SQL, JOBS_RAW_SQL, JOBS_SQL, jobs_processed, jobs_raw, read
from jobweave.streaming import conversation_state as cs
from jobweave.streaming import ingest

C = F.col

#: Feeds and exports are landed compressed, as the readers take them.
PACKED = "gzip"


def feed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Postings as a scraper would land them."""
    return jobs_raw(spark, d).select(
        "job_id", "url", "title", "company", "location", "description",
        C("salary_min").cast("double").alias("salary_min"), "job_type",
        F.date_format("posted_date", "yyyy-MM-dd").alias("posted_date"),
        F.date_format("scraped_at", "yyyy-MM-dd'T'HH:mm:ss").alias("scraped_at"), "source",
    )


FEED_SQL = f"""WITH {JOBS_RAW_SQL} SELECT job_id, url, title, trim(company) AS company,
  nullif(location, '') AS location, nullif(description, '') AS description, salary_min::DOUBLE AS salary_min,
  strftime(posted_date, '%Y-%m-%d') AS posted_date, strftime(scraped_at, '%Y-%m-%d') AS scraped_at, source FROM jobs_raw"""


def _loaded(df: DataFrame) -> DataFrame:
    return files.load_clean(df).select(
        "job_id", "url", "title", "company", "location", "description", C("salary_min").cast("double").alias("salary_min"),
        "posted_date", F.date_format("scraped_at", "yyyy-MM-dd").alias("scraped_at"), "source",
    )


@query("read_scraped_lines", FEED_SQL)
def read_scraped_lines(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "feed-lines")
    # a packed file is read by one task, so files are bounded
    feed_rows(spark, d).write.option("maxRecordsPerFile", 500_000).json(path, compression=PACKED)
    return _loaded(files.read_scraped_lines(spark, path))


@query("read_scraped_json", FEED_SQL)
def read_scraped_json(spark: SparkSession, d: str) -> DataFrame:
    """Array-of-objects files of bounded size, as scrapers land them."""
    path = new_path(spark, "feed-arrays")
    rows = feed_rows(spark, d)
    arrays = rows.groupBy(F.floor(C("job_id").cast("long") / 5000).alias("batch")).agg(
        F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")
    )
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path, compression=PACKED)
    return _loaded(files.read_scraped_json(spark, path))


LCA_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("CASE_NUMBER", "CASE STATUS", "EMPLOYER-NAME", "WORKSITE_STATE",
                                                 "WAGE_RATE_OF_PAY_FROM", "RECEIVED_DATE")]
)


@query(
    "read_lca_csv",
    f"""WITH {FILINGS_SQL} SELECT case_number, case_status, employer_name, worksite_state,
      CASE WHEN case_number::BIGINT % 11 = 0 THEN NULL ELSE wage_rate_of_pay_from::DOUBLE END AS wage_rate_of_pay_from,
      CASE WHEN case_number::BIGINT % 13 = 0 THEN NULL ELSE strftime(received_date, '%Y-%m-%d') END AS received_date,
      '{AS_OF}' AS loaded_at FROM filings WHERE case_number::BIGINT % 17 <> 0""",
)
def read_lca_csv(spark: SparkSession, d: str) -> DataFrame:
    """Filings with bad amounts, bad dates and missing states, through CSV."""
    path = new_path(spark, "lca-csv")
    n = C("case_number").cast("long")
    rows = ad.filings(spark, d).select(
        C("case_number").alias("CASE_NUMBER"), C("case_status").alias("CASE STATUS"),
        C("employer_name").alias("EMPLOYER-NAME"),
        F.when(n % 17 != 0, C("worksite_state")).alias("WORKSITE_STATE"),
        F.when(n % 11 == 0, "n/a").otherwise(C("wage_rate_of_pay_from").cast("string")).alias("WAGE_RATE_OF_PAY_FROM"),
        F.when(n % 13 == 0, "soon, maybe").otherwise(F.date_format("received_date", "yyyy-MM-dd")).alias("RECEIVED_DATE"),
    )
    rows.write.csv(path, header=True, quote='"', escape='"')
    loaded = files.coerce_types(
        files.normalize_headers(files.read_lca_csv(spark, path, LCA_SCHEMA)),
        ["received_date"], ["wage_rate_of_pay_from"], AS_OF,
    )
    return loaded.withColumns(
        {c: F.date_format(c, "yyyy-MM-dd") for c in ("received_date", "loaded_at")}
    )


@query(
    "copy_json_with_source",
    "SELECT event_id, event_type AS source FROM events WHERE event_id % 9 <> 0",
)
def copy_json_with_source(spark: SparkSession, d: str) -> DataFrame:
    """One document per line, some of them broken."""
    path = new_path(spark, "json-docs")
    doc = F.to_json(F.struct("event_id", C("event_type").alias("source"), "props"))
    broken = F.when(C("event_id") % 9 == 0, F.concat(F.lit("{oops "), doc)).otherwise(doc)
    read(spark, d, "events").select(broken.alias("value")).write.text(path)
    return files.copy_json_with_source(spark, path, AS_OF).select(
        F.try_variant_get("job_data", "$.event_id", "long").alias("event_id"), "source"
    )


@query(
    "load_company_list",
    """WITH c AS (SELECT c_name AS name, CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN ' https://c' || c_custkey || '.example.com '
        WHEN 2 THEN 'No central page' WHEN 3 THEN 'c' || c_custkey || '.example.com' WHEN 4 THEN 'd' || c_custkey END AS url,
        c_custkey % 12 < 6 AS verified FROM customer)
    SELECT name, trim(url) AS url FROM c WHERE trim(url) <> '' AND NOT contains(url, 'No central')
      AND (verified OR starts_with(trim(url), 'http'))""",
)
def load_company_list(spark: SparkSession, d: str) -> DataFrame:
    key = C("c_custkey")
    url = (
        F.when(key % 6 == 0, "")
        .when(key % 6 == 1, F.concat(F.lit(" https://c"), key, F.lit(".example.com ")))
        .when(key % 6 == 2, "No central page")
        .when(key % 6 == 3, F.concat(F.lit("c"), key, F.lit(".example.com")))
        .when(key % 6 == 4, F.concat(F.lit("d"), key))
    )
    rows = read(spark, d, "customer").select(
        C("c_name").alias("company_name"), url.alias("final_career_url"),
        F.when(key % 12 < 6, "True").otherwise("False").alias("verified"),
    )
    return files.load_company_list(rows)


@query(
    "append_and_replace",
    "SELECT 'appended' AS kind, r_name, 2::BIGINT AS copies FROM region UNION ALL SELECT 'replaced', n_name, 1 FROM nation",
)
def append_and_replace(spark: SparkSession, d: str) -> DataFrame:
    region, nation = read(spark, d, "region"), read(spark, d, "nation")
    appended, replaced = new_path(spark, "appended"), new_path(spark, "replaced")
    sinks.append_table(region, appended)
    sinks.append_table(region, appended)
    sinks.replace_table(region.select(C("r_name").alias("n_name")), replaced)
    sinks.replace_table(nation.select("n_name"), replaced)

    def counted(path: str, kind: str, name: str) -> DataFrame:
        return spark.read.parquet(path).groupBy(C(name).alias("r_name")).agg(F.count(F.lit(1)).alias("copies")).select(
            F.lit(kind).alias("kind"), "r_name", "copies"
        )

    return counted(appended, "appended", "r_name").unionByName(counted(replaced, "replaced", "n_name"))


@query(
    "write_outputs",
    f"WITH {JOBS_RAW_SQL} SELECT title, company, url, NULL AS salary FROM jobs_raw",
)
def write_outputs(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "outputs")
    sinks.write_outputs(jobs_raw(spark, d), path, compression=PACKED)
    out = spark.read.csv(
        f"{path}/csv", header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        schema=", ".join(f"{c} string" for c in sinks.EXPORT_COLUMNS),
    )
    return out.select("title", "company", "url", "salary")


@query(
    "materialize_table",
    f"""WITH {JOBS_SQL} SELECT visa_category, count(*) AS n FROM jobs GROUP BY visa_category""",
)
def materialize_table(spark: SparkSession, d: str) -> DataFrame:
    counts = jobs_processed(spark, d).groupBy("visa_category").agg(F.count(F.lit(1)).alias("n"))
    sinks.materialize(counts, "visa_counts", "table", new_path(spark, "visa-counts"))
    return spark.sql("SELECT visa_category, n FROM visa_counts")


# ---------------------------------------------------------------- streaming
@query(
    "stream_ingest",
    """SELECT user_id, event_type, event_id, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) = 1""",
)
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Events landed as JSON files, ingested file by file, read as newest row per key."""
    root = new_path(spark, "stream")
    events = read(spark, d, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), "user_id", "event_type", "value"
    )
    # every row is landed twice: the second copy is a repeated delivery
    events.unionByName(events).repartition(4, "event_id").write.json(f"{root}/in")
    schema = T.StructType.fromDDL("event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    stream = ingest.read_stream(spark, f"{root}/in", schema, max_files=2)
    unique = ingest.dedup_stream(stream, ["event_id"], "ts", "60 days")
    keys, order = ["user_id", "event_type"], "ts"
    ingest.start_ingest(unique, f"{root}/log", f"{root}/checkpoint", keys, order, ["event_id"]).awaitTermination()
    return ingest.current_rows(spark, f"{root}/log", keys, order, ["event_id"]).select(
        "user_id", "event_type", "event_id", "value"
    )


@query(
    "stream_conversation_state",
    f"""WITH {STATE_SQL} SELECT conv_id, max(turn) AS turn, array_to_string(arg_max(companies, turn), ',') AS companies,
      array_to_string(arg_max(locations, turn), ',') AS locations, max(turns_kept) AS turns_kept FROM state GROUP BY conv_id""",
)
def stream_conversation_state(spark: SparkSession, d: str) -> DataFrame:
    """Turns arrive in order of their number, some per micro-batch."""
    root = new_path(spark, "talks")
    turns = talks(spark, d)
    for part in range(2):
        turns.filter((C("turn") >= 4) == (part == 1)).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = ingest.read_stream(spark, f"{root}/in", turns.schema, "parquet", max_files=1)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/log/batch_id={batch_id}")

    (
        cs.conversation_state_stream(stream)
        .writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    newest = st.top_per_key(spark.read.parquet(f"{root}/log"), ["conv_id"], [C("turn").desc()])
    return newest.select(
        "conv_id", "turn", F.array_join("companies", ",").alias("companies"),
        F.array_join("locations", ",").alias("locations"), "turns_kept",
    )


# ------------------------------------------------------------- data quality
@query(
    "unique_violations",
    f"WITH {JOBS_RAW_SQL} SELECT job_id, count(*) AS n FROM jobs_raw GROUP BY job_id HAVING count(*) > 1",
)
def unique_violations(spark: SparkSession, d: str) -> DataFrame:
    return dq.unique_violations(jobs_raw(spark, d), "job_id")


@query(
    "not_null_violations",
    f"""WITH {JOBS_RAW_SQL} SELECT count(*) FILTER (job_id IS NULL) AS job_id, count(*) FILTER (location IS NULL) AS location,
      count(*) FILTER (salary_min IS NULL) AS salary_min FROM jobs_raw""",
)
def not_null_violations(spark: SparkSession, d: str) -> DataFrame:
    return dq.not_null_violations(jobs_raw(spark, d), ["job_id", "location", "salary_min"])


@query(
    "duplicate_report",
    f"""WITH {STAGED_SQL}
    SELECT 'jobs_raw' AS table_name, count(*) AS total_rows, count(DISTINCT job_id) AS unique_keys,
      count(*) - count(DISTINCT job_id) AS duplicates FROM jobs_raw
    UNION ALL SELECT 'stg_jobs', count(*), count(DISTINCT job_id), count(*) - count(DISTINCT job_id) FROM staged
    UNION ALL SELECT 'events', count(*), count(DISTINCT user_id), count(*) - count(DISTINCT user_id) FROM events""",
)
def duplicate_report(spark: SparkSession, d: str) -> DataFrame:
    jobs = jobs_raw(spark, d)
    return dq.duplicate_report(
        {
            "jobs_raw": (jobs, "job_id"),
            "stg_jobs": (st.stage_jobs(jobs, AS_OF), "job_id"),
            "events": (read(spark, d, "events"), "user_id"),
        }
    )


LATER = "2001-07-20"
_LAYERS_SQL = f"""WITH {JOBS_RAW_SQL}, runs(run, as_of) AS (VALUES ('1', DATE '{AS_OF}'), ('2', DATE '{LATER}')),
  staged AS (SELECT run, jobs_raw.* FROM runs JOIN jobs_raw ON job_id IS NOT NULL AND title IS NOT NULL AND trim(company) <> ''
    AND scraped_at >= as_of - INTERVAL 90 DAY),
  layers AS (SELECT run, 'raw' AS layer, (SELECT count(*) FROM jobs_raw) AS row_count FROM runs
    UNION ALL SELECT run, 'staging', (SELECT count(*) FROM staged s WHERE s.run = r.run) FROM runs r
    UNION ALL SELECT run, 'dedup', (SELECT count(DISTINCT (job_id, source)) FROM staged s WHERE s.run = r.run) FROM runs r
    UNION ALL SELECT run, 'mart', (SELECT count(DISTINCT (job_id, source)) FROM staged s WHERE s.run = r.run) FROM runs r)"""


def run_layers(spark: SparkSession, d: str, metrics: str, run: str, as_of: str) -> None:
    """One run of the models: each layer is written once, counted as it is written, and read by the next."""
    root, counts = new_path(spark, f"run-{run}"), {}

    def layer(name: str, df: DataFrame) -> DataFrame:
        stored, counts[name] = dq.observed_write(df, f"{root}/{name}", f"{name}-{run}")
        return stored

    staged = layer("staging", st.stage_jobs(layer("raw", jobs_raw(spark, d)), as_of))
    latest = layer("dedup", st.latest_per_key(staged, ["job_id", "source"], ["scraped_at"], ["url"]))
    layer("mart", st.build_mart(sp.match_sponsors(latest, sp.employer_summary(ad.filings(spark, d))), as_of))
    dq.record_run(spark, metrics, run, counts)


def two_runs(spark: SparkSession, d: str) -> str:
    metrics = new_path(spark, "metrics")
    run_layers(spark, d, metrics, "1", AS_OF)
    run_layers(spark, d, metrics, "2", LATER)
    return metrics


@query("layer_row_counts", f"{_LAYERS_SQL} SELECT run, layer, row_count FROM layers")
def layer_row_counts(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(two_runs(spark, d))


@query(
    "row_drop_alert",
    f"""{_LAYERS_SQL}, old AS (SELECT layer, row_count AS previous_count FROM layers WHERE run = '1')
    SELECT layer, row_count, previous_count, round((previous_count - row_count)::DOUBLE / previous_count, 4) AS dropped,
      coalesce((previous_count - row_count)::DOUBLE / nullif(previous_count, 0) > 0.2, false) AS alert,
      layer = 'mart' AND row_count = 0 AS empty_mart
    FROM (SELECT * FROM layers WHERE run = '2') JOIN old USING (layer)""",
)
def row_drop_alert(spark: SparkSession, d: str) -> DataFrame:
    return dq.run_report(spark, two_runs(spark, d), "2", "mart")


@query(
    "rejected_rows",
    """SELECT 'json' AS feed, CASE WHEN event_id % 9 = 0 THEN 'not JSON' END AS reason, count(*) AS n FROM events GROUP BY ALL
    UNION ALL SELECT 'csv', CASE WHEN event_id % 13 = 0 THEN 'fields do not fit' WHEN event_id % 7 = 0 THEN 'no worksite state' END,
      count(*) FROM events GROUP BY ALL""",
)
def rejected_rows(spark: SparkSession, d: str) -> DataFrame:
    """SRC2, SRC5: broken rows come back as rows with a reason; good and bad make up all that was written."""
    events, n = read(spark, d, "events"), C("event_id")
    lines, table = new_path(spark, "json-lines"), new_path(spark, "csv-rows")
    doc = F.to_json(F.struct("event_id", C("event_type").alias("source"), "props"))
    events.select(F.when(n % 9 == 0, F.concat(F.lit("{oops "), doc)).otherwise(doc).alias("value")).write.text(lines)
    # a quoted line break belongs to its row; some rows have a field too many
    state = F.when(n % 7 == 0, "").otherwise('"M\nA"')
    row = F.concat_ws(",", n.cast("string"), state, F.when(n % 13 == 0, "x,y").otherwise("x"))
    events.select(row.alias("value")).write.text(table)
    good, bad = files.copy_json_rows(spark, lines, AS_OF)
    schema = T.StructType.fromDDL("event_id string, worksite_state string, note string")
    rows, rejects = lca_without_header(spark, table, schema)
    parts = [("json", good, None), ("json", bad, "reject_reason"), ("csv", rows, None), ("csv", rejects, "reject_reason")]
    out = None
    for feed, df, reason in parts:
        named = df.select(F.lit(feed).alias("feed"), (C(reason) if reason else F.lit(None).cast("string")).alias("reason"))
        out = named if out is None else out.unionByName(named)
    return out.groupBy("feed", "reason").agg(F.count(F.lit(1)).alias("n"))


def lca_without_header(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    return files.read_lca_rows(spark, path, schema, "worksite_state", header=False)


@query(
    "schema_drift",
    """SELECT event_type AS source, field, count(*) AS records FROM (
      SELECT event_type, unnest(['props', 'extra'] || CASE WHEN event_id % 2 = 0 THEN ['nested'] ELSE [] END) AS field FROM events) GROUP BY ALL""",
)
def schema_drift(spark: SparkSession, d: str) -> DataFrame:
    """SRC1: fields outside the schema stay in the record and are reported per feed."""
    path = new_path(spark, "drift")
    nested = F.when(C("event_id") % 2 == 0, F.struct(C("value").alias("v")))
    read(spark, d, "events").select(
        C("event_id").cast("string").alias("job_id"), C("event_type").alias("source"), "props", F.lit(1).alias("extra"), nested.alias("nested")
    ).write.json(path)
    return files.schema_drift(files.read_records(spark, path))


@query(
    "valid_rows",
    f"""WITH {JOBS_SQL} SELECT count(*) AS total_rows, count(*) FILTER (title IS NOT NULL AND company IS NOT NULL
      AND location IS NOT NULL AND salary_min IS NOT NULL AND salary_max IS NOT NULL AND h1b_sponsor IS NOT NULL
      AND job_id IS NOT NULL) AS valid_rows, 0 AS missing_columns FROM jobs""",
)
def valid_rows(spark: SparkSession, d: str) -> DataFrame:
    jobs = jobs_processed(spark, d)
    missing = dq.missing_columns(jobs)
    return dq.valid_rows(jobs, schemas.REQUIRED_JOB_COLUMNS).withColumn("missing_columns", F.lit(len(missing)))
