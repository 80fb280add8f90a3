"""Queries over staging, deduplication, joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.functions import rules
from jobweave.functions import text as tx
from jobweave.operators import incremental as inc
from jobweave.operators import sponsors as sp
from jobweave.operators import staging as st
from jobweave.plans.registry import query
from jobweave.sources import adapters as ad
from jobweave.sources import sinks
from jobweave.sources.adapters import AS_OF, FILINGS_SQL, JOBS_RAW_SQL, JOBS_SQL, read

TIE = ["url"]
STAGED_SQL = f"""{JOBS_RAW_SQL},
staged AS (
  SELECT * REPLACE (trim(title) AS title, trim(company) AS company, trim(location) AS location)
  FROM jobs_raw
  WHERE job_id IS NOT NULL AND title IS NOT NULL AND trim(company) <> ''
    AND scraped_at >= DATE '{AS_OF}' - INTERVAL 90 DAY)"""


def ts_text(col: str):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss").alias(col)


@query(
    "stage_jobs",
    f"""WITH {STAGED_SQL}
    SELECT job_id, source, url, title, company, location, strftime(scraped_at, '%Y-%m-%d %H:%M:%S') AS scraped_at,
      '{AS_OF} 00:00:00' AS processed_at FROM staged""",
)
def stage_jobs(spark: SparkSession, d: str) -> DataFrame:
    return st.stage_jobs(ad.jobs_raw(spark, d), AS_OF).select(
        "job_id", "source", "url", "title", "company", "location", ts_text("scraped_at"), ts_text("processed_at")
    )


@query(
    "dedup_jobs",
    f"""WITH {STAGED_SQL}
    SELECT job_id, source, url, title, company FROM staged
    QUALIFY row_number() OVER (PARTITION BY job_id, source ORDER BY scraped_at DESC NULLS LAST, url) = 1""",
)
def dedup_jobs(spark: SparkSession, d: str) -> DataFrame:
    staged = st.stage_jobs(ad.jobs_raw(spark, d), AS_OF)
    return st.latest_per_key(staged, ["job_id", "source"], ["scraped_at"], TIE).select(
        "job_id", "source", "url", "title", "company"
    )


@query(
    "latest_per_job_id",
    f"""WITH {JOBS_RAW_SQL}
    SELECT job_id, source, url FROM jobs_raw WHERE job_id IS NOT NULL AND job_id NOT IN ('N/A')
    QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY scraped_at DESC NULLS LAST, url) = 1""",
)
def latest_per_job_id(spark: SparkSession, d: str) -> DataFrame:
    return st.latest_per_key(ad.jobs_raw(spark, d), ["job_id"], ["scraped_at"], TIE, drop_ids=["N/A"]).select(
        "job_id", "source", "url"
    )


@query(
    "latest_event_per_user_type",
    """SELECT user_id, event_type, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id) = 1""",
)
def latest_event_per_user_type(spark: SparkSession, d: str) -> DataFrame:
    return st.latest_per_key(read(spark, d, "events"), ["user_id", "event_type"], ["ts"], ["event_id"]).select(
        "user_id", "event_type", "event_id", ts_text("ts")
    )


@query(
    "best_match_per_key",
    f"""WITH {FILINGS_SQL}, e AS (SELECT employer_name, worksite_state, count(*) AS n FROM filings GROUP BY ALL)
    SELECT employer_name, worksite_state, n FROM e
    QUALIFY row_number() OVER (PARTITION BY employer_name ORDER BY n DESC, worksite_state) = 1""",
)
def best_match_per_key(spark: SparkSession, d: str) -> DataFrame:
    per_state = ad.filings(spark, d).groupBy("employer_name", "worksite_state").agg(F.count(F.lit(1)).alias("n"))
    return sp.best_match_per_key(per_state, "employer_name", [F.col("n").desc(), F.col("worksite_state")])


@query(
    "keep_first_title_company",
    f"""WITH {JOBS_RAW_SQL} SELECT title, company, url FROM jobs_raw
    QUALIFY row_number() OVER (PARTITION BY title, company ORDER BY url) = 1""",
)
def keep_first_title_company(spark: SparkSession, d: str) -> DataFrame:
    return st.keep_first(ad.jobs_raw(spark, d), ["title", "company"], ["url"]).select("title", "company", "url")


@query(
    "near_key_dedup",
    f"""WITH {JOBS_RAW_SQL}, a AS (
      SELECT * FROM jobs_raw QUALIFY row_number() OVER (
        PARTITION BY lower(trim(coalesce(title, ''))), lower(trim(coalesce(company, ''))),
          lower(trim(coalesce(location, ''))) ORDER BY url) = 1)
    SELECT job_id, title, location, url FROM a
    QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY url) = 1""",
)
def near_key_dedup(spark: SparkSession, d: str) -> DataFrame:
    return st.near_dedup(ad.jobs_raw(spark, d), [F.col("url")], id_col="job_id").select(
        "job_id", "title", "location", "url"
    )


@query(
    "employer_contacts",
    f"""WITH {FILINGS_SQL}, r AS (
      SELECT * FROM filings WHERE lower(employer_name) LIKE '%customer#00000%' AND case_status = 'Certified'
        AND (employer_poc_email IS NOT NULL OR agent_attorney_email_address IS NOT NULL))
    SELECT employer_name, case_number, employer_poc_email, agent_attorney_email_address,
      count(*) OVER (PARTITION BY employer_name) AS total_filings
    FROM r ORDER BY received_date DESC NULLS LAST, case_number LIMIT 5""",
)
def employer_contacts(spark: SparkSession, d: str) -> DataFrame:
    return sp.employer_contacts(ad.filings(spark, d), "customer#00000").select(
        "employer_name", "case_number", "employer_poc_email", "agent_attorney_email_address", "total_filings"
    )


MATCHED_SQL = f"""{JOBS_RAW_SQL}, {FILINGS_SQL},
emp AS (
  SELECT upper(trim(employer_name)) AS clean, employer_name, count(*) AS total_petitions,
    count(*) FILTER (case_status = 'Certified') AS certified, max(worksite_city) AS h1b_city,
    max(worksite_state) AS h1b_state
  FROM filings WHERE employer_name IS NOT NULL GROUP BY ALL),
names AS (SELECT DISTINCT upper(trim(company)) AS company_key FROM jobs_raw),
matched AS (
  SELECT company_key, employer_name AS h1b_employer_name, total_petitions, h1b_city, h1b_state,
    certified::DOUBLE / total_petitions AS avg_approval_rate,
    CASE WHEN clean IS NULL THEN 4 WHEN company_key = clean THEN 1 WHEN starts_with(company_key, clean) THEN 2
      ELSE 3 END AS match_priority
  FROM names LEFT JOIN emp ON company_key <> '' AND clean <> ''
    AND (company_key = clean OR starts_with(company_key, clean) OR starts_with(clean, company_key))
  QUALIFY row_number() OVER (
    PARTITION BY company_key ORDER BY match_priority, total_petitions DESC NULLS LAST, clean, employer_name) = 1)"""


@query(
    "match_sponsors",
    f"""WITH {MATCHED_SQL}
    SELECT url, source, h1b_employer_name, h1b_city, h1b_state, total_petitions,
      round(avg_approval_rate, 6) AS avg_approval_rate, h1b_employer_name IS NOT NULL AS h1b_sponsor, match_priority
    FROM jobs_raw LEFT JOIN matched ON upper(trim(company)) = company_key""",
)
def match_sponsors(spark: SparkSession, d: str) -> DataFrame:
    jobs = ad.jobs_raw(spark, d).select("url", "source", "company")
    return (
        sp.match_sponsors(jobs, sp.employer_summary(ad.filings(spark, d)))
        .withColumn("avg_approval_rate", F.round("avg_approval_rate", 6))
        .drop("company")
    )


@query(
    "match_sponsors_names",
    """WITH c AS (SELECT DISTINCT upper(trim(p_name || ' ' || p_type)) AS company_key FROM part
        UNION SELECT n_name FROM nation UNION SELECT left(p_name, 3) FROM part),
      e AS (SELECT upper(n_name) AS clean, n_name AS employer_name, n_nationkey % 7 + 1 AS total_petitions FROM nation
        UNION ALL SELECT upper(p_name), p_name, count(*) FROM part GROUP BY p_name
        UNION ALL SELECT upper(left(p_name, 2)), left(p_name, 2), count(*) FROM part GROUP BY left(p_name, 2))
    SELECT upper(company_key) AS company_key, employer_name AS h1b_employer_name,
      total_petitions::BIGINT AS total_petitions,
      CASE WHEN upper(company_key) = clean THEN 1 WHEN starts_with(upper(company_key), clean) THEN 2 ELSE 3 END
        AS match_priority
    FROM c JOIN e ON upper(company_key) = clean OR starts_with(upper(company_key), clean)
      OR starts_with(clean, upper(company_key))
    QUALIFY row_number() OVER (
      PARTITION BY upper(company_key) ORDER BY match_priority, total_petitions DESC, clean, employer_name) = 1""",
)
def match_sponsors_names(spark: SparkSession, d: str) -> DataFrame:
    part, nation = read(spark, d, "part"), read(spark, d, "nation")
    companies = (
        part.select(F.concat_ws(" ", "p_name", "p_type").alias("n"))
        .unionByName(nation.select(F.col("n_name").alias("n")))
        .unionByName(part.select(F.substring("p_name", 1, 3).alias("n")))
        .select(tx.norm_key(F.col("n")).alias("company_key"))
    )

    def named(df: DataFrame, name) -> DataFrame:
        return df.groupBy(name.alias("employer_name")).agg(F.count(F.lit(1)).alias("total_petitions"))

    employers = (
        nation.select(F.col("n_name").alias("employer_name"), (F.col("n_nationkey") % 7 + 1).cast("long").alias("total_petitions"))
        .unionByName(named(part, F.col("p_name")))
        .unionByName(named(part, F.substring("p_name", 1, 2)))
        .select(
            tx.norm_key(F.col("employer_name")).alias("employer_clean"),
            "employer_name",
            "total_petitions",
            F.lit("").alias("h1b_city"),
            F.lit("").alias("h1b_state"),
            F.lit(0.0).alias("avg_approval_rate"),
        )
    )
    return sp.best_employer_per_company(companies, employers).select(
        "company_key", "h1b_employer_name", "total_petitions", "match_priority"
    )


@query(
    "classify_jobs",
    f"""WITH {JOBS_RAW_SQL}
    SELECT url, CASE WHEN lower(title) LIKE '%senior%' OR lower(title) LIKE '%sr %' OR lower(title) LIKE '%lead%' THEN 'Senior'
        WHEN lower(title) LIKE '%junior%' OR lower(title) LIKE '%jr %' OR lower(title) LIKE '%entry%' THEN 'Junior'
        WHEN lower(title) LIKE '%principal%' OR lower(title) LIKE '%staff%' THEN 'Principal'
        WHEN lower(title) LIKE '%manager%' OR lower(title) LIKE '%director%' THEN 'Management'
        ELSE 'Mid-Level' END AS seniority_level,
      CASE WHEN lower(location) LIKE '%remote%' OR lower(description) LIKE '%remote%'
        OR lower(description) LIKE '%work from home%' THEN 'Remote' ELSE 'On-site' END AS work_model,
      CASE WHEN upper(title) LIKE '%DATA%' OR upper(title) LIKE '%MACHINE LEARN%' OR upper(title) LIKE '%ANALYTICS%' THEN 'Data'
        WHEN upper(title) LIKE '%PRODUCT%' THEN 'Product'
        WHEN upper(title) LIKE '%DESIGN%' OR upper(title) LIKE '%UX%' THEN 'Design'
        WHEN upper(title) LIKE '%SALES%' OR upper(title) LIKE '%ACCOUNT EXEC%' THEN 'Sales'
        WHEN upper(title) LIKE '%MARKETING%' OR upper(title) LIKE '%BRAND%' THEN 'Marketing'
        WHEN upper(title) LIKE '%OPERATIONS%' OR upper(title) LIKE '%LOGISTICS%' THEN 'Operations'
        WHEN upper(title) LIKE '%ENGINEER%' OR upper(title) LIKE '%DEVELOPER%' OR upper(title) LIKE '%PROGRAMMER%'
          OR upper(title) LIKE '%ARCHITECT%' OR upper(title) LIKE '%DEVOPS%' THEN 'Engineering'
        ELSE 'Other' END AS job_category
    FROM jobs_raw""",
)
def classify_jobs(spark: SparkSession, d: str) -> DataFrame:
    remote = rules.is_remote(F.col("location"), F.col("description"))
    return ad.jobs_raw(spark, d).select(
        "url",
        rules.seniority(F.col("title")).alias("seniority_level"),
        rules.remote_label(remote).alias("work_model"),
        rules.job_category(F.col("title")).alias("job_category"),
    )


@query(
    "job_mart",
    f"""WITH {MATCHED_SQL}, latest AS (
      SELECT * FROM jobs_raw WHERE trim(company) <> '' AND scraped_at >= DATE '{AS_OF}' - INTERVAL 90 DAY
      QUALIFY row_number() OVER (PARTITION BY job_id, source ORDER BY scraped_at DESC NULLS LAST, url) = 1)
    SELECT job_id, source, url, trim(title) AS title, trim(company) AS company, trim(location) AS location,
      description, snippet, job_type, strftime(posted_date, '%Y-%m-%d') AS posted_date,
      salary_min::DOUBLE AS salary_min, salary_max::DOUBLE AS salary_max,
      h1b_employer_name IS NOT NULL AS h1b_sponsor, h1b_employer_name, h1b_city, h1b_state, total_petitions,
      round(avg_approval_rate, 6) AS avg_approval_rate, '{AS_OF}' AS mart_created_at
    FROM latest LEFT JOIN matched ON upper(trim(company)) = company_key""",
)
def job_mart(spark: SparkSession, d: str) -> DataFrame:
    staged = st.stage_jobs(ad.jobs_raw(spark, d), AS_OF)
    latest = st.latest_per_key(staged, ["job_id", "source"], ["scraped_at"], TIE)
    mart = st.build_mart(sp.match_sponsors(latest, sp.employer_summary(ad.filings(spark, d))), AS_OF)
    return mart.select(
        "job_id", "source", "url", "title", "company", "location", "description", "snippet", "job_type",
        F.date_format("posted_date", "yyyy-MM-dd").alias("posted_date"),
        F.col("salary_min").cast("double").alias("salary_min"), F.col("salary_max").cast("double").alias("salary_max"),
        "h1b_sponsor", "h1b_employer_name", "h1b_city", "h1b_state", "total_petitions",
        F.round("avg_approval_rate", 6).alias("avg_approval_rate"),
        F.date_format("mart_created_at", "yyyy-MM-dd").alias("mart_created_at"),
    )


@query(
    "unified_feeds",
    """SELECT 'grid' AS source, p_partkey::VARCHAR AS job_id, p_name AS title, p_brand AS company, NULL AS job_type,
        p_retailprice AS salary_min FROM part
    UNION ALL SELECT 'intern board', s_suppkey::VARCHAR, s_name, s_name, 'Internship', NULL FROM supplier
    UNION ALL SELECT 'company pages', c_custkey::VARCHAR, c_name, c_mktsegment, NULL, NULL FROM customer""",
)
def unified_feeds(spark: SparkSession, d: str) -> DataFrame:
    grid = st.to_unified_schema(
        read(spark, d, "part"), "grid", job_id="p_partkey", title="p_name", company="p_brand", salary_min="p_retailprice"
    )
    interns = st.to_unified_schema(
        read(spark, d, "supplier"), "intern board", {"job_type": "Internship"},
        job_id="s_suppkey", title="s_name", company="s_name",
    )
    pages = st.to_unified_schema(
        read(spark, d, "customer"), "company pages", job_id="c_custkey", title="c_name", company="c_mktsegment"
    )
    return st.union_feeds([grid, interns, pages]).select(
        "source", "job_id", "title", "company", "job_type", F.col("salary_min").cast("double").alias("salary_min")
    )


@query(
    "distinct_companies",
    f"WITH {JOBS_RAW_SQL} SELECT DISTINCT company, location FROM jobs_raw",
)
def distinct_companies(spark: SparkSession, d: str) -> DataFrame:
    return ad.jobs_raw(spark, d).select("company", "location").distinct()


# The stored side of the incremental queries is what was scraped before AS_OF.
OLD_SQL = f"""old AS (SELECT * FROM jobs_raw WHERE scraped_at < DATE '{AS_OF}'
  QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY scraped_at DESC, url) = 1)"""


def stored(spark: SparkSession, d: str) -> DataFrame:
    jobs = ad.jobs_raw(spark, d).filter(F.col("scraped_at") < F.lit(AS_OF).cast("date"))
    return st.latest_per_key(jobs, ["job_id"], ["scraped_at"], TIE)


def arrived(spark: SparkSession, d: str) -> DataFrame:
    return ad.jobs_raw(spark, d).filter(F.col("scraped_at") >= F.lit(AS_OF).cast("date"))


@query(
    "append_new",
    f"""WITH {JOBS_RAW_SQL}, {OLD_SQL}
    SELECT job_id, url FROM jobs_raw WHERE scraped_at >= DATE '{AS_OF}' AND job_id NOT IN (SELECT job_id FROM old)
    QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY scraped_at DESC, url) = 1""",
)
def append_new(spark: SparkSession, d: str) -> DataFrame:
    return inc.append_new(stored(spark, d), arrived(spark, d), ["job_id"], ["scraped_at"], TIE).select("job_id", "url")


@query(
    "known_keys",
    f"""WITH {JOBS_RAW_SQL}, {OLD_SQL}
    SELECT job_id, url FROM jobs_raw WHERE scraped_at >= DATE '{AS_OF}' AND job_id IN (SELECT job_id FROM old)""",
)
def known_keys(spark: SparkSession, d: str) -> DataFrame:
    return inc.known_keys(arrived(spark, d), stored(spark, d), ["job_id"]).select("job_id", "url")


@query(
    "missing_or_newer",
    f"""WITH {JOBS_RAW_SQL}, {OLD_SQL}
    SELECT DISTINCT j.job_id FROM jobs_raw j LEFT JOIN old o ON j.job_id = o.job_id
    WHERE o.job_id IS NULL OR j.scraped_at > o.scraped_at""",
)
def missing_or_newer(spark: SparkSession, d: str) -> DataFrame:
    return inc.missing_or_newer(ad.jobs_raw(spark, d), stored(spark, d), "job_id", "scraped_at")


@query(
    "upsert_newer",
    f"""WITH {JOBS_RAW_SQL}
    SELECT job_id, arg_max(title, (scraped_at, -1)) IS NOT NULL AS has_title,
      strftime(max(scraped_at), '%Y-%m-%d') AS scraped_at FROM jobs_raw GROUP BY job_id""",
)
def upsert_newer(spark: SparkSession, d: str) -> DataFrame:
    merged = inc.upsert_newer(stored(spark, d), arrived(spark, d), ["job_id"], "scraped_at", tie_break=TIE)
    return merged.select(
        "job_id", F.col("title").isNotNull().alias("has_title"),
        F.date_format("scraped_at", "yyyy-MM-dd").alias("scraped_at"),
    )


@query(
    "upsert_update_columns",
    f"""WITH {JOBS_RAW_SQL}, {OLD_SQL}, fresh AS (
      SELECT * FROM jobs_raw WHERE scraped_at >= DATE '{AS_OF}'
      QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY scraped_at DESC, url) = 1)
    SELECT coalesce(o.job_id, f.job_id) AS job_id,
      CASE WHEN o.job_id IS NULL OR f.scraped_at > o.scraped_at THEN f.title ELSE o.title END AS title,
      CASE WHEN o.job_id IS NULL THEN f.location ELSE o.location END AS location
    FROM old o FULL JOIN fresh f ON o.job_id = f.job_id""",
)
def upsert_update_columns(spark: SparkSession, d: str) -> DataFrame:
    merged = inc.upsert_newer(
        stored(spark, d), arrived(spark, d), ["job_id"], "scraped_at", update_cols=["title"], tie_break=TIE
    )
    return merged.select("job_id", "title", "location")


@query(
    "latest_with_raw_columns",
    f"""WITH {JOBS_RAW_SQL}, l AS (SELECT job_id, source, max(scraped_at) AS newest FROM jobs_raw GROUP BY ALL)
    SELECT r.url, r.salary_min::DOUBLE AS salary_min FROM l JOIN jobs_raw r ON l.job_id = r.job_id AND l.source = r.source
    WHERE r.scraped_at = l.newest""",
)
def latest_with_raw_columns(spark: SparkSession, d: str) -> DataFrame:
    """JN4: rows of a key table with columns of the raw table, on both parts of the key."""
    raw = ad.jobs_raw(spark, d)
    newest = raw.groupBy("job_id", "source").agg(F.max("scraped_at").alias("newest"))
    return raw.join(newest, ["job_id", "source"]).filter(F.col("scraped_at") == F.col("newest")).select(
        "url", F.col("salary_min").cast("double").alias("salary_min")
    )


CACHE_SQL = f"""cache AS (
  SELECT url, visa_category AS cached_category, classification_confidence AS cached_confidence,
    TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY * (_part % 14) AS cached_at FROM jobs WHERE _line < 4)"""


def classification_cache(spark: SparkSession, d: str) -> DataFrame:
    """Cached answers of mixed age for a part of the postings."""
    return ad.jobs_processed(spark, d).filter(F.col("_line") < 4).select(
        "url",
        F.col("visa_category").alias("cached_category"),
        F.col("classification_confidence").alias("cached_confidence"),
        (F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(days=(F.col("_part") % 14).cast("int"))).alias("cached_at"),
    )


@query(
    "cache_lookup",
    f"""WITH {JOBS_SQL}, {CACHE_SQL}
    SELECT j.url, c.cached_category, c.cached_at IS NOT NULL AS from_cache FROM jobs j
    LEFT JOIN cache c ON j.url = c.url AND c.cached_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY""",
)
def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    items = ad.jobs_raw(spark, d).select("url")
    return inc.cache_lookup(items, classification_cache(spark, d), "url", AS_OF).select(
        "url", "cached_category", "from_cache"
    )


@query(
    "cache_upsert",
    f"""WITH {JOBS_SQL}, {CACHE_SQL}, answers AS (
      SELECT url, 'H-1B' AS cached_category, 0.95::DOUBLE AS cached_confidence FROM jobs WHERE _line IN (3, 4))
    SELECT url, cached_category, cached_confidence, strftime(cached_at, '%Y-%m-%d') AS cached_at FROM cache
      WHERE url NOT IN (SELECT url FROM answers)
    UNION ALL SELECT url, cached_category, cached_confidence, '{AS_OF}' FROM answers""",
)
def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    answers = ad.jobs_raw(spark, d).filter(F.col("_line").isin(3, 4)).select(
        "url", F.lit("H-1B").alias("cached_category"), F.lit(0.95).alias("cached_confidence")
    )
    return inc.cache_upsert(classification_cache(spark, d), answers, "url", AS_OF).withColumn(
        "cached_at", F.date_format("cached_at", "yyyy-MM-dd")
    )


@query(
    "pending_work",
    f"""WITH done AS (SELECT c_name, DATE '{AS_OF}' - INTERVAL 1 DAY * (c_custkey % 30) AS completed_at FROM customer
        WHERE c_acctbal > 5000)
    SELECT c_name FROM customer WHERE c_name NOT IN (
      SELECT c_name FROM done WHERE (SELECT max(completed_at) FROM done) >= DATE '{AS_OF}' - INTERVAL 7 DAY)
    ORDER BY c_name LIMIT 150""",
)
def pending_work(spark: SparkSession, d: str) -> DataFrame:
    customer = read(spark, d, "customer")
    done = customer.filter(F.col("c_acctbal") > 5000).select(
        "c_name",
        (F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(days=(F.col("c_custkey") % 30).cast("int"))).alias(
            "completed_at"
        ),
    )
    return inc.pending_work(customer.select("c_name"), done, "c_name", AS_OF)


@query(
    "retention_prune",
    f"SELECT event_id FROM events WHERE ts >= DATE '{ad.EVENTS_AS_OF}' - INTERVAL 7 DAY",
)
def retention_prune(spark: SparkSession, d: str) -> DataFrame:
    return sinks.retention_prune(read(spark, d, "events"), "ts", 7, ad.EVENTS_AS_OF).select("event_id")
