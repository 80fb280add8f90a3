"""Queries over filters, ranked search, vectors and candidate matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.operators import filters as flt
from jobweave.operators import matching as mt
from jobweave.operators import pivots as pv
from jobweave.operators import search as se
from jobweave.operators import vectors as ve
from jobweave.plans.registry import query
from jobweave.sources import adapters as ad
from jobweave.sources.adapters import AS_OF, JOBS_SQL, jobs_processed, read, read_spread, sql_list, sql_pick

F_ = F.col


def like_any(col: str, values: list[str]) -> str:
    """SQL for a case-insensitive literal match of any value inside a column."""
    return "(" + " OR ".join(f"coalesce(contains(lower({col}), {ad.sql_text(v.lower())}), false)" for v in values) + ")"


# ------------------------------------------------------------------ filters
@query(
    "keyword_search_documents",
    f"SELECT doc_id FROM documents WHERE {like_any('text', ['the erst'])} OR {like_any('source', ['the erst'])}",
)
def keyword_search_documents(spark: SparkSession, d: str) -> DataFrame:
    return read_spread(spark, d, "documents").filter(flt.keyword_search("The Erst", ["text", "source"])).select("doc_id")


@query(
    "keyword_search_expanded",
    f"""WITH {JOBS_SQL} SELECT url FROM jobs WHERE {like_any('title', ['engineer', 'developer', 'programmer'])}
      AND {like_any('location', ['boston', 'seattle'])}""",
)
def keyword_search_expanded(spark: SparkSession, d: str) -> DataFrame:
    hit = flt.keyword_search(
        "engineer", expansions=["Engineer", "Developer", "Programmer"], locations=["Boston", "Seattle"]
    )
    return jobs_processed(spark, d).filter(hit).select("url")


@query(
    "multi_contains",
    f"""WITH {JOBS_SQL} SELECT url FROM jobs WHERE {like_any('company', ['#00000001', '#00000000'])}
      AND {like_any('location', ['ma', '_', 'n'])}""",
)
def multi_contains(spark: SparkSession, d: str) -> DataFrame:
    keep = flt.multi_contains("company", ["#00000001", "#00000000"]) & flt.multi_contains("location", ["MA", "_", "n"])
    return jobs_processed(spark, d).filter(keep).select("url")


@query(
    "list_filters",
    f"""WITH {JOBS_SQL} SELECT url FROM jobs WHERE work_model IN ('Remote', 'Hybrid') AND job_type IN ('Full-Time')
      AND company_size = '11-50' AND job_category = 'Engineering'""",
)
def list_filters(spark: SparkSession, d: str) -> DataFrame:
    keep = (
        flt.in_list("work_model", ["Remote", "Hybrid"]) & flt.in_list("job_type", ["Full-Time"])
        & (F_("company_size") == "11-50") & (F_("job_category") == "Engineering")
    )
    return jobs_processed(spark, d).filter(keep).select("url")


@query(
    "sponsorship_no",
    f"WITH {JOBS_SQL} SELECT url FROM jobs WHERE h1b_sponsor = FALSE OR h1b_sponsor IS NULL",
)
def sponsorship_no(spark: SparkSession, d: str) -> DataFrame:
    return jobs_processed(spark, d).filter(flt.sponsorship("No")).select("url")


@query(
    "salary_range",
    f"""WITH {JOBS_SQL} SELECT url, salary_min::DOUBLE AS salary_min, salary_max::DOUBLE AS salary_max FROM jobs
    WHERE (salary_min >= 40000 OR salary_max >= 40000)
      AND (salary_max <= 60000 OR (salary_max IS NULL AND salary_min <= 60000))""",
)
def salary_range(spark: SparkSession, d: str) -> DataFrame:
    return jobs_processed(spark, d).filter(flt.salary_range(40000, 60000)).select(
        "url", F_("salary_min").cast("double").alias("salary_min"), F_("salary_max").cast("double").alias("salary_max")
    )


@query(
    "posted_within",
    f"WITH {JOBS_SQL} SELECT url, days_since_posted FROM jobs WHERE days_since_posted IS NOT NULL AND days_since_posted <= 7",
)
def posted_within(spark: SparkSession, d: str) -> DataFrame:
    return jobs_processed(spark, d).filter(flt.posted_within(7)).select("url", "days_since_posted")


@query(
    "strict_filters",
    f"""WITH {JOBS_SQL} SELECT url FROM jobs WHERE salary_min >= 20000 AND salary_max <= 90000
      AND h1b_approval_rate >= 0.5 AND h1b_total_petitions >= 50 AND is_new_grad_role""",
)
def strict_filters(spark: SparkSession, d: str) -> DataFrame:
    criteria = se.SearchCriteria(
        salary_min=20000, salary_max=90000, min_approval_rate=0.5, min_petitions=50, new_grad_only=True
    )
    return jobs_processed(spark, d).filter(se.strict_filters(criteria)).select("url")


FOREIGN_SQL = " AND ".join(f"NOT contains(location, {ad.sql_text(m)})" for m in flt.FOREIGN_MARKERS)


@query("exclude_foreign", f"WITH {JOBS_SQL} SELECT url, location FROM jobs WHERE {FOREIGN_SQL}")
def exclude_foreign(spark: SparkSession, d: str) -> DataFrame:
    return jobs_processed(spark, d).filter(flt.exclude_foreign()).select("url", "location")


@query(
    "usa_location",
    f"""WITH {JOBS_SQL}, f AS (SELECT url, location,
      location IS NULL OR NOT {like_any('location', flt.FOREIGN_PLACES)} AS lenient,
      location IS NULL OR location = '' OR (NOT {like_any('location', flt.NON_US_MARKERS)}
        AND {like_any('location', flt.US_MARKERS)}) AS strict FROM jobs)
    SELECT url, lenient, strict FROM f WHERE lenient OR strict""",
)
def usa_location(spark: SparkSession, d: str) -> DataFrame:
    rows = jobs_processed(spark, d).select(
        "url", flt.usa_location().alias("lenient"), flt.usa_location(strict=True).alias("strict")
    )
    return rows.filter(F_("lenient") | F_("strict"))


@query(
    "company_noise",
    f"""WITH {JOBS_SQL} SELECT url, company FROM jobs
    WHERE company NOT IN {sql_list(flt.COMPANY_NOISE + flt.STATE_NOISE)}
      AND lower(company) NOT LIKE 'international%' AND length(company) > 2""",
)
def company_noise(spark: SparkSession, d: str) -> DataFrame:
    return jobs_processed(spark, d).filter(flt.company_noise()).select("url", "company")


@query(
    "location_noise",
    f"""WITH {JOBS_SQL} SELECT url, location FROM jobs WHERE location IS NOT NULL AND location <> ''
      AND location NOT IN {sql_list(flt.LOCATION_NOISE)} AND lower(location) NOT LIKE '%remote%'
      AND upper(location) NOT LIKE 'PACIFIC RIM%' AND upper(location) NOT LIKE 'INTELLIGENT TECHNICAL%'
      AND length(location) > 2""",
)
def location_noise(spark: SparkSession, d: str) -> DataFrame:
    return jobs_processed(spark, d).filter(flt.location_noise()).select("url", "location")


@query(
    "within_lookback",
    f"""SELECT event_id, ts >= TIMESTAMP '{ad.EVENTS_AS_OF}' - INTERVAL 72 HOUR AS rejects_undated,
      CASE WHEN event_id % 5 = 0 THEN TRUE ELSE ts >= TIMESTAMP '{ad.EVENTS_AS_OF}' - INTERVAL 72 HOUR END
        AS accepts_undated FROM events""",
)
def within_lookback(spark: SparkSession, d: str) -> DataFrame:
    events = read(spark, d, "events").withColumn("dated", F.when(F_("event_id") % 5 != 0, F_("ts")))
    return events.select(
        "event_id",
        flt.within_lookback("ts", ad.EVENTS_AS_OF, 72, False).alias("rejects_undated"),
        flt.within_lookback("dated", ad.EVENTS_AS_OF, 72, True).alias("accepts_undated"),
    )


@query(
    "experience_terms",
    f"WITH {JOBS_SQL} SELECT url, title FROM jobs WHERE {like_any('title', flt.EXPERIENCE_TERMS['senior'])}",
)
def experience_terms(spark: SparkSession, d: str) -> DataFrame:
    return jobs_processed(spark, d).filter(flt.experience_terms("senior")).select("url", "title")


@query(
    "intent_filter",
    f"""WITH {JOBS_SQL} SELECT url, title FROM jobs WHERE {like_any('title', ['engineer', 'analyst'])}
      AND {like_any('description', ['python', 'c++'])} AND {like_any('title', flt.EXPERIENCE_TERMS['senior'])}
      AND ({like_any('location', ['boston'])} OR coalesce(work_model = 'Remote', false)) AND h1b_sponsor
    ORDER BY posted_date DESC NULLS LAST, url LIMIT 40""",
)
def intent_filter(spark: SparkSession, d: str) -> DataFrame:
    criteria = flt.IntentCriteria(
        titles=["Engineer", "Analyst"], skills=["Python", "C++"], experience_level="senior",
        locations=["Remote", "Boston"], visa_required=True,
    )
    return flt.intent_filter(jobs_processed(spark, d), criteria, 20).select("url", "title")


AUTHS = ["F-1 OPT", "F-1 CPT", "H-1B transfer", "US Citizen", "Green Card", "", None]


@query(
    "visa_compatible",
    f"""WITH c AS (SELECT c_custkey, coalesce({sql_pick(AUTHS, 'c_custkey')}, '') AS a FROM customer),
    o AS (SELECT c_custkey, list_distinct(list_concat(
      CASE WHEN contains(a, 'F-1') OR contains(a, 'CPT') THEN ['CPT'] ELSE [] END,
      CASE WHEN contains(a, 'OPT') THEN ['OPT', 'H-1B'] ELSE [] END,
      CASE WHEN contains(a, 'H-1B') THEN ['H-1B'] ELSE [] END,
      CASE WHEN contains(a, 'Citizen') OR contains(a, 'US') THEN ['CPT', 'OPT', 'H-1B', 'US-Only'] ELSE [] END)) AS v FROM c)
    SELECT c_custkey, CASE WHEN len(v) = 0 THEN 'CPT,H-1B,OPT' ELSE array_to_string(list_sort(v), ',') END AS visas FROM o""",
)
def visa_compatible(spark: SparkSession, d: str) -> DataFrame:
    visas = flt.visa_compatible(ad.pick(AUTHS, F_("c_custkey")))
    return read(spark, d, "customer").select("c_custkey", F.array_join(F.array_sort(visas), ",").alias("visas"))


VALID_REJECT = ["thwhesou", "eronthwh", "anleauque"]
VALID_REQUIRE = ["the", "and", "which", "der", "que", "los", "with", "tion"]


@query(
    "document_validity",
    f"""SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN length(text) < 100 THEN 'too short'
        WHEN length(text) > 50000 THEN 'too long'
        WHEN {like_any('text', VALID_REJECT)} THEN 'billing or procedure document'
        WHEN {' + '.join(f"contains(lower(text), '{w}')::INT" for w in VALID_REQUIRE)} < 3 THEN 'not a resume'
        ELSE '' END AS reason FROM documents""",
)
def document_validity(spark: SparkSession, d: str) -> DataFrame:
    check = flt.document_validity(F_("text"), reject=VALID_REJECT, require=VALID_REQUIRE)
    return read_spread(spark, d, "documents").select("doc_id", check["reason"].alias("reason"))


@query(
    "document_validity_resume",
    f"""SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN length(text) < 100 THEN 'too short'
        WHEN length(text) > 50000 THEN 'too long'
        WHEN {like_any('text', flt.NON_RESUME_TERMS)} THEN 'billing or procedure document'
        WHEN {' + '.join(f"contains(lower(text), '{w}')::INT" for w in flt.RESUME_TERMS)} < 3 THEN 'not a resume'
        ELSE '' END AS reason FROM documents""",
)
def document_validity_resume(spark: SparkSession, d: str) -> DataFrame:
    return read_spread(spark, d, "documents").select("doc_id", flt.document_validity(F_("text"))["reason"].alias("reason"))


@query(
    "gibberish_filter",
    r"""WITH w AS (SELECT conv_id, turn, text, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(text,
        '^ +', ''), ' +$', ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM conversations)
    SELECT conv_id, turn, length(trim(text)) > 5 AND len(list_filter(words,
      lambda x: length(x) > 3 AND NOT regexp_matches(lower(x), '[aeiou]'))) > len(words) * 0.6 AS gibberish FROM w""",
)
def gibberish_filter(spark: SparkSession, d: str) -> DataFrame:
    return read_spread(spark, d, "conversations").select("conv_id", "turn", flt.is_gibberish(F_("text")).alias("gibberish"))


LOG_TEXTS = [
    "SELECT * FROM jobs", "drop table jobs; --", "please update the row", "find jobs /* now */", "xp_run; create x",
    "show sp_list", "select 1;DELETE", None,
]
_LOG_SQL = f"SELECT event_id, {sql_pick(LOG_TEXTS, 'event_id')} || ' ' || event_type AS q FROM events"


@query(
    "safe_query_flag",
    f"""WITH l AS ({_LOG_SQL}), u AS (SELECT *, trim(upper(q)) AS u FROM l)
    SELECT event_id, coalesce({' OR '.join(f"(starts_with(u, '{v}') OR contains(u, ' {v} ') OR contains(u, ';{v}'))" for v in flt.DESTRUCTIVE_VERBS)}, false) AS unsafe,
      trim(replace(replace(replace(replace(replace(replace(q, ';', ''), '--', ''), '/*', ''), '*/', ''), 'xp_', ''), 'sp_', '')) AS stripped
    FROM u""",
)
def safe_query_flag(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(ad.pick(LOG_TEXTS, F_("event_id")), F.lit(" "), F_("event_type"))
    return read(spark, d, "events").select(
        "event_id",
        F.coalesce(flt.unsafe_query(text), F.lit(False)).alias("unsafe"),
        flt.strip_dangerous(text).alias("stripped"),
    )


MAILS = ["a.b@x.org", "no-at.example.com", "x@y", "u+v%w@sub.dom-ain.co", "two@@x.com", " lead@x.com"]


@query(
    "email_valid",
    f"SELECT c_custkey, regexp_matches({sql_pick(MAILS, 'c_custkey')}, '{flt.EMAIL_PATTERN}') AS ok FROM customer",
)
def email_valid(spark: SparkSession, d: str) -> DataFrame:
    mail = ad.pick(MAILS, F_("c_custkey"))
    return read(spark, d, "customer").select("c_custkey", flt.email_valid(mail).alias("ok"))


# ------------------------------------------------------------ ranked search
SCORE_SQL = """(CASE WHEN h1b_sponsor THEN 10 ELSE 0 END
  + CASE WHEN h1b_approval_rate > 0.8 THEN 5 WHEN h1b_approval_rate > 0.6 THEN 3 ELSE 0 END
  + CASE WHEN h1b_total_petitions > 100 THEN 5 WHEN h1b_total_petitions > 10 THEN 3 ELSE 0 END
  + CASE WHEN work_model = 'Remote' THEN 3 ELSE 0 END + CASE WHEN salary_min IS NOT NULL THEN 2 ELSE 0 END
  + CASE WHEN days_since_posted <= 7 THEN 5 WHEN days_since_posted <= 30 THEN 2 ELSE 0 END)"""


def named_sql(term: str) -> str:
    return "(" + " OR ".join(like_any(c, [term]) for c in se.SKILL_COLUMNS) + ")"


@query(
    "relevance_score",
    f"""WITH {JOBS_SQL} SELECT url, {SCORE_SQL} + CASE WHEN {named_sql('python')} THEN 20 ELSE 0 END
      + CASE WHEN {named_sql('docker')} THEN 20 ELSE 0 END AS score FROM jobs""",
)
def relevance_score(spark: SparkSession, d: str) -> DataFrame:
    return jobs_processed(spark, d).select("url", se.relevance_score(["Python", "Docker"]).alias("score"))


@query(
    "search_jobs",
    f"""WITH {JOBS_SQL}, l AS (SELECT * FROM jobs
        QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY scraped_at DESC NULLS LAST, url) = 1),
      s AS (SELECT *, {SCORE_SQL} + CASE WHEN {named_sql('sql')} THEN 20 ELSE 0 END AS relevance_score FROM l
        WHERE {FOREIGN_SQL} AND {like_any('title', ['engineer', 'data'])} AND h1b_sponsor
          AND {like_any('job_type', ['full'])}),
      u AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lower(trim(coalesce(title, ''))),
          lower(trim(coalesce(company, ''))), lower(trim(coalesce(location, '')))
        ORDER BY relevance_score DESC, days_since_posted ASC NULLS LAST, url) = 1)
    SELECT url, title, relevance_score, least(100.0::DOUBLE, relevance_score / 50.0::DOUBLE * 100) AS match_pct FROM u
    ORDER BY relevance_score DESC, days_since_posted ASC NULLS LAST, url LIMIT 50""",
)
def search_jobs(spark: SparkSession, d: str) -> DataFrame:
    criteria = se.SearchCriteria(
        titles=["Engineer", "Data"], sponsor_only=True, job_type="full", resume_skills=["SQL"], limit=50
    )
    return se.search_jobs(jobs_processed(spark, d), criteria).select(
        "url", "title", "relevance_score", se.match_percent(F_("relevance_score")).alias("match_pct")
    )


@query(
    "board_search_page",
    f"""WITH {JOBS_SQL}, r AS (SELECT * FROM jobs WHERE {like_any('title', ['engineer'])}
        AND {like_any('location', ['ma', 'ny'])} AND h1b_sponsor AND (salary_min >= 30000 OR salary_max >= 30000)
        AND days_since_posted <= 900 AND work_model IN ('Remote', 'Hybrid', 'On-site'))
    SELECT url, (SELECT count(*) FROM r) AS total FROM r
    ORDER BY salary_max DESC NULLS LAST, salary_min DESC NULLS LAST, url LIMIT 50""",
)
def board_search_page(spark: SparkSession, d: str) -> DataFrame:
    wanted = se.BoardFilters(
        search="engineer", expansions=["engineer"], locations=["MA", "NY"], visa_sponsorship="Yes", salary_min=30000,
        posted_within_days=900, work_models=["Remote", "Hybrid", "On-site"],
    )
    rows = jobs_processed(spark, d).filter(se.board_predicate(wanted))
    return se.page(rows, se.job_order("highest_salary"), 50).select("url", "total")


_ORDERS = {
    "most_recent": "scraped_at DESC NULLS LAST",
    "company_az": "company ASC NULLS LAST",
    "h1b_rate": "h1b_approval_rate DESC NULLS LAST",
}


@query(
    "order_jobs",
    f"WITH {JOBS_SQL} "
    + " UNION ALL ".join(
        f"(SELECT '{mode}' AS mode, url FROM jobs ORDER BY {order}, url LIMIT 20)" for mode, order in _ORDERS.items()
    ),
)
def order_jobs(spark: SparkSession, d: str) -> DataFrame:
    jobs = jobs_processed(spark, d)
    parts = [se.order_jobs(jobs, mode, 20).select(F.lit(mode).alias("mode"), "url") for mode in _ORDERS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


PCT_SQL = " + ".join(f"{named_sql(s)}::INT" for s in ("python", "sql", "docker"))


@query(
    "resume_match_filter",
    f"""WITH {JOBS_SQL}, s AS (SELECT url, CAST(({PCT_SQL}) * 100 // 3 AS INT) AS match_score FROM jobs)
    SELECT url, match_score FROM s WHERE match_score >= 30""",
)
def resume_match_filter(spark: SparkSession, d: str) -> DataFrame:
    return se.filter_by_resume(jobs_processed(spark, d), ["Python", "SQL", "Docker"], [F_("url")]).select(
        "url", "match_score"
    )


@query(
    "resume_match_fallback",
    f"WITH {JOBS_SQL} SELECT url, 0 AS match_score FROM jobs ORDER BY url LIMIT 10",
)
def resume_match_fallback(spark: SparkSession, d: str) -> DataFrame:
    return se.filter_by_resume(jobs_processed(spark, d), ["Fortran"], [F_("url")]).select("url", "match_score")


@query(
    "expand_search",
    f"""WITH {JOBS_SQL}, l AS (SELECT url, CASE
        WHEN {like_any('title', ['data scientist'])} AND {like_any('location', ['alaska'])} THEN 0
        WHEN {like_any('title', ['data', 'machine learning'])} AND {like_any('location', ['alaska'])} THEN 1
        WHEN {like_any('title', ['data', 'machine learning'])} THEN 2 END AS level FROM jobs)
    SELECT url, level FROM l WHERE level = (SELECT min(level) FROM l)""",
)
def expand_search(spark: SparkSession, d: str) -> DataFrame:
    exact = flt.contains_any(F_("title"), ["data scientist"])
    broad = flt.contains_any(F_("title"), ["data", "machine learning"])
    there = flt.contains_any(F_("location"), ["Alaska"])
    return se.expand_search(jobs_processed(spark, d), [exact & there, broad & there, broad]).select("url", "level")


@query(
    "similar_items",
    f"""WITH {JOBS_SQL} SELECT url FROM jobs WHERE ({like_any('title', ['data scientist'])}
      OR {like_any('description', ['python', 'kafka'])}) AND job_id <> '0'
    ORDER BY posted_date DESC NULLS LAST, url LIMIT 25""",
)
def similar_items(spark: SparkSession, d: str) -> DataFrame:
    return se.similar_items(jobs_processed(spark, d), "0", "Data Scientist", ["Python", "Kafka"], 25).select("url")


@query(
    "search_by_terms",
    f"""WITH {JOBS_SQL}, s AS (SELECT url, days_since_posted,
        {' + '.join(f"{named_sql(t)}::INT" for t in ('python', 'spark', 'kafka', 'sql'))} AS relevance_score
      FROM jobs WHERE visa_category IN ('CPT', 'OPT') AND days_since_posted <= 400)
    SELECT url, relevance_score FROM s WHERE relevance_score > 0
    ORDER BY relevance_score DESC, days_since_posted ASC NULLS LAST, url LIMIT 50""",
)
def search_by_terms(spark: SparkSession, d: str) -> DataFrame:
    return se.search_by_terms(
        jobs_processed(spark, d), ["Python", "Spark", "Kafka", "SQL"], ["CPT", "OPT"], 400, 50
    ).select("url", "relevance_score")


@query(
    "search_by_terms_fallback",
    f"""WITH {JOBS_SQL} SELECT url, 0 AS relevance_score FROM jobs
    WHERE visa_category IN ('H-1B') AND days_since_posted <= 400
    ORDER BY days_since_posted ASC NULLS LAST, url LIMIT 50""",
)
def search_by_terms_fallback(spark: SparkSession, d: str) -> DataFrame:
    return se.search_by_terms(jobs_processed(spark, d), [], ["H-1B"], 400, 50).select("url", "relevance_score")


# ---------------------------------------------------------------- vectors
COSINE_SQL = """pairs AS (
  SELECT q.vec_id AS query_id, i.vec_id AS item_id, i.label AS item_label, q.label AS query_label,
    round(list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 9) AS score
  FROM embeddings q JOIN embeddings i ON q.vec_id <> i.vec_id)"""


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").withColumnRenamed("vec_id", "query_id")


@query(
    "cosine_topk",
    f"""WITH {COSINE_SQL.replace('q.vec_id <> i.vec_id', 'true')}
    SELECT query_id, item_id, round(score, 6) AS score FROM pairs WHERE score > 0.1
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) <= 10""",
)
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    found = ve.cosine_topk(vector_queries(spark, d), read(spark, d, "embeddings"), 10, 64, 0.1, item_id="vec_id")
    return found.withColumn("score", F.round("score", 6))


@query(
    "cosine_topk_by_class",
    f"""WITH {COSINE_SQL.replace('q.vec_id <> i.vec_id', 'true')}
    SELECT query_id, item_id, round(score, 6) AS score FROM pairs
    WHERE score > 0.05 AND item_label IN (query_label, query_label + 1)
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) <= 5""",
)
def cosine_topk_by_class(spark: SparkSession, d: str) -> DataFrame:
    queries = vector_queries(spark, d).withColumn("allowed", F.array("label", F_("label") + 1))
    found = ve.cosine_topk(
        queries, read(spark, d, "embeddings"), 5, 64, 0.05, item_id="vec_id", item_class="label", allowed="allowed"
    )
    return found.withColumn("score", F.round("score", 6))


@query(
    "cosine_topk_blocked",
    """WITH pairs AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id,
        round(list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 9) AS score
      FROM embeddings q JOIN embeddings i ON true)
    SELECT query_id, item_id, round(score, 6) AS score FROM pairs WHERE score > 0.1
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) <= 3""",
)
def cosine_topk_blocked(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "embeddings")
    found = ve.cosine_topk(
        items.withColumnRenamed("vec_id", "query_id"), items, 3, 64, 0.1, item_id="vec_id",
        broadcast_queries=200, items_per_block=200,
    )
    return found.withColumn("score", F.round("score", 6))


@query(
    "cosine_topk_pruned",
    """WITH pairs AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id,
        round(list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 9) AS score
      FROM embeddings q JOIN embeddings i ON true)
    SELECT query_id, item_id, round(score, 6) AS score FROM pairs WHERE score > 0.1
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) <= 10""",
)
def cosine_topk_pruned(spark: SparkSession, d: str) -> DataFrame:
    """All vectors against all, by pivots."""
    found = pv.pruned_topk(vector_queries(spark, d), read(spark, d, "embeddings"), 10, 64, 0.1, item_id="vec_id", pivots=32)
    return found.withColumn("score", F.round("score", 6))


@query(
    "jobs_with_embeddings",
    f"""WITH {JOBS_SQL} SELECT url, vec_id, label, len(embedding) AS dims FROM jobs
    JOIN embeddings ON CAST(job_id AS BIGINT) = vec_id WHERE embedding IS NOT NULL""",
)
def jobs_with_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """JN3"""
    vectors = read(spark, d, "embeddings").filter(F_("embedding").isNotNull()).withColumn("job_id", F_("vec_id").cast("string"))
    return jobs_processed(spark, d).join(vectors, "job_id").select("url", "vec_id", "label", F.size("embedding").alias("dims"))


@query("embed_documents")
def embed_documents(spark: SparkSession, d: str) -> DataFrame:
    return ve.embed(read_spread(spark, d, "documents").select("doc_id", "text"), F_("text"), 64).select("doc_id", "embedding")


@query(
    "batch_scorer",
    "SELECT doc_id, round(length(text) / 1000.0::DOUBLE, 6) AS score FROM documents",
)
def batch_scorer(spark: SparkSession, d: str) -> DataFrame:
    scorer = ve.BatchScorer(lambda texts: texts.str.len() / 1000.0, "double")
    return read_spread(spark, d, "documents").select("doc_id", F.round(scorer(F_("text")), 6).alias("score"))


# ----------------------------------------------------------------- matching
PROFILE_SKILLS = ["Python", "SQL", "Java", "Spark", "Docker", "Excel"]


def profiles(spark: SparkSession, d: str) -> DataFrame:
    """Candidate profiles: one per customer."""
    return as_profiles(read(spark, d, "customer"))


def as_profiles(customers: DataFrame, *kept: str) -> DataFrame:
    key = F_("c_custkey")
    return customers.select(
        *kept,
        key.alias("resume_id"),
        F.array(ad.pick(PROFILE_SKILLS, key), ad.pick(PROFILE_SKILLS, key + 1), ad.pick(PROFILE_SKILLS, key + 2)).alias(
            "technical_skills"
        ),
        (key % 9).cast("double").alias("total_experience_years"),
        ad.pick(AUTHS, key).alias("work_authorization"),
        F.array(F.when(key % 4 == 0, "Boston").when(key % 4 == 1, "Remote").otherwise("Seattle")).alias(
            "preferred_locations"
        ),
    )


PROFILES_SQL = f"""profiles AS (
  SELECT c_custkey AS resume_id, [{sql_pick(PROFILE_SKILLS, 'c_custkey')}, {sql_pick(PROFILE_SKILLS, 'c_custkey + 1')},
      {sql_pick(PROFILE_SKILLS, 'c_custkey + 2')}] AS technical_skills,
    (c_custkey % 9)::DOUBLE AS years, coalesce({sql_pick(AUTHS, 'c_custkey')}, '') AS auth,
    CASE c_custkey % 4 WHEN 0 THEN 'boston' WHEN 1 THEN 'remote' ELSE 'seattle' END AS wanted FROM customer)"""


def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Profiles with their candidate postings: those of orders the customer placed."""
    # joined by numbers first; the texts of a posting and a profile, many times as long, are made from the joined rows
    lines = (
        read_spread(spark, d, "lineitem")
        .join(read(spark, d, "orders").select("o_orderkey", "o_custkey"), F_("l_orderkey") == F_("o_orderkey"))
        .join(read(spark, d, "customer").select("c_custkey"), F_("o_custkey") == F_("c_custkey"))
    )
    jobs = ad.as_processed(ad.as_jobs(lines, "c_custkey"))
    return as_profiles(jobs.withColumn("semantic_score", (F_("_part") % 50 + 50) / F.lit(100.0)), *jobs.columns, "semantic_score").drop("c_custkey")


SCORES_SQL = f"""pairs AS (
  SELECT p.resume_id, j.*, (j._part % 50 + 50) AS semantic_pct, p.technical_skills, p.years, p.auth, p.wanted,
    lower(coalesce(nullif(qualifications, ''), description, '')) AS qtext
  FROM jobs j JOIN orders ON j.job_id = o_orderkey::VARCHAR JOIN profiles p ON p.resume_id = o_custkey),
scored AS (
  SELECT *, len(list_filter(technical_skills, lambda s: contains(qtext, lower(s)))) AS hits,
    CASE WHEN contains(lower(title), 'intern') AND years <= 2 THEN 90
      WHEN contains(lower(title), 'entry') OR contains(lower(title), 'junior') THEN CASE WHEN years <= 3 THEN 85 ELSE 70 END
      WHEN contains(lower(title), 'senior') THEN CASE WHEN years >= 5 THEN 90 ELSE 50 END ELSE 75 END AS experience,
    CASE WHEN (contains(auth, 'CPT') AND coalesce(visa_category, '') = 'CPT')
        OR (contains(auth, 'OPT') AND coalesce(visa_category, '') IN ('OPT', 'H-1B'))
        OR (contains(auth, 'H-1B') AND coalesce(visa_category, '') = 'H-1B') OR contains(auth, 'Citizen') THEN 100
      WHEN coalesce(visa_category, '') = 'US-Only' THEN 0 ELSE 70 END AS visa,
    CASE WHEN contains(lower(coalesce(location, '')), wanted) THEN 95
      WHEN contains(lower(coalesce(location, '')), 'remote') OR wanted = 'remote' THEN 100 ELSE 50 END AS place,
    CASE WHEN coalesce(h1b_sponsor, FALSE) THEN 75 ELSE 60 END AS growth
  FROM pairs)"""


def overall_sql(semantic: int, skills: int, experience: int, visa: int, place: int, growth: int) -> str:
    """Weighted score in integer arithmetic; weights in percent, skills are thirds."""
    points = (
        f"{semantic} * 3 * semantic_pct + {skills} * hits * 100 + {experience} * 3 * experience + {visa} * 3 * visa"
        f" + {place} * 3 * place + {growth} * 3 * growth"
    )
    tenths, rest = f"(({points}) // 30)", f"(({points}) % 30)"
    up = f"CASE WHEN {rest} > 15 OR ({rest} = 15 AND {tenths} % 2 = 1) THEN 1 ELSE 0 END"
    return f"CAST({tenths} + {up} AS DOUBLE) / 10.0::DOUBLE"


REASON_SQL = """CASE WHEN concat_ws(', ', CASE WHEN hits >= 3 THEN 'strong skills match' WHEN hits = 2 THEN 'good skills overlap' END,
    CASE WHEN experience >= 80 THEN 'experience level fits' END,
    CASE WHEN visa = 100 THEN 'visa compatible' WHEN visa = 0 THEN 'visa incompatible' END,
    CASE WHEN place >= 90 THEN 'preferred location' END) = '' THEN 'potential match' ELSE concat_ws(', ',
    CASE WHEN hits >= 3 THEN 'strong skills match' WHEN hits = 2 THEN 'good skills overlap' END,
    CASE WHEN experience >= 80 THEN 'experience level fits' END,
    CASE WHEN visa = 100 THEN 'visa compatible' WHEN visa = 0 THEN 'visa incompatible' END,
    CASE WHEN place >= 90 THEN 'preferred location' END) END"""


@query(
    "match_scores",
    f"""WITH {JOBS_SQL}, {PROFILES_SQL}, {SCORES_SQL}
    SELECT resume_id, url, CASE hits WHEN 0 THEN 0.0 WHEN 1 THEN 33.333 WHEN 2 THEN 66.667 ELSE 100.0 END::DOUBLE AS skills_score,
      experience::DOUBLE AS experience_score, visa::DOUBLE AS visa_score, place::DOUBLE AS location_score,
      growth::DOUBLE AS growth_score FROM scored""",
)
def match_scores(spark: SparkSession, d: str) -> DataFrame:
    return mt.match_scores(candidate_pairs(spark, d)).select(
        "resume_id", "url", F.round("skills_score", 3).alias("skills_score"), "experience_score", "visa_score",
        "location_score", "growth_score",
    )


@query(
    "rank_matches",
    f"""WITH {JOBS_SQL}, {PROFILES_SQL}, {SCORES_SQL}, o AS (
      SELECT *, {overall_sql(35, 25, 20, 10, 5, 5)} AS overall_score, {REASON_SQL} AS reason FROM scored)
    SELECT resume_id, url, overall_score, upper(left(reason, 1)) || substr(reason, 2) AS match_reasoning FROM o
    QUALIFY row_number() OVER (PARTITION BY resume_id ORDER BY overall_score DESC, url) <= 10""",
)
def rank_matches(spark: SparkSession, d: str) -> DataFrame:
    return mt.rank_matches(candidate_pairs(spark, d), "resume_id", "url").select(
        "resume_id", "url", "overall_score", "match_reasoning"
    )


@query(
    "rank_matches_keyword",
    f"""WITH {JOBS_SQL}, {PROFILES_SQL}, {SCORES_SQL}, o AS (
      SELECT *, {overall_sql(0, 30, 25, 20, 15, 10)} AS overall_score FROM scored)
    SELECT resume_id, url, overall_score FROM o
    QUALIFY row_number() OVER (PARTITION BY resume_id ORDER BY overall_score DESC, url) <= 10""",
)
def rank_matches_keyword(spark: SparkSession, d: str) -> DataFrame:
    return mt.rank_matches(candidate_pairs(spark, d), "resume_id", "url", weights=mt.KEYWORD_WEIGHTS).select(
        "resume_id", "url", "overall_score"
    )


@query(
    "save_matches",
    f"""WITH {COSINE_SQL}, k AS (SELECT * FROM pairs WHERE score > 0.1
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) <= 10)
    SELECT query_id || '_' || item_id AS match_id, query_id::VARCHAR AS resume_id, item_id::VARCHAR AS job_id,
      CAST(round(score * 100, 2) AS DOUBLE) AS overall_score,
      CASE WHEN item_label % 2 = 0 THEN 100.0 ELSE 50.0 END::DOUBLE AS visa_score,
      CASE WHEN score >= 0.7 THEN 'Excellent semantic match' WHEN score >= 0.6 THEN 'Good match'
        ELSE 'Moderate match' END AS band FROM k""",
)
def save_matches(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "embeddings")
    found = ve.cosine_topk(vector_queries(spark, d), items, 11, 64, 0.1, item_id="vec_id")
    found = found.filter(F_("query_id") != F_("item_id")).withColumnRenamed("item_id", "job_id")
    labelled = found.join(
        items.select(F_("vec_id").alias("job_id"), (F_("label") % 2 == 0).alias("h1b_sponsor")), "job_id"
    )
    rows = mt.match_rows(mt.direct_matches(labelled, "query_id", "job_id"), "query_id", AS_OF)
    return rows.select(
        "match_id", "resume_id", "job_id", F_("overall_score").cast("double").alias("overall_score"),
        F_("visa_score").cast("double").alias("visa_score"),
        F.regexp_extract("match_reasoning", r"^([^(]*) \(", 1).alias("band"),
    )
