"""Queries over text columns, web pages, grid cells and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.functions import numbers as nm
from jobweave.functions import rules
from jobweave.functions import text as tx
from jobweave.operators import analytics as an
from jobweave.operators import conversations as cv
from jobweave.operators import incremental as inc
from jobweave.operators import pages as pg
from jobweave.operators import staging as st
from jobweave.plans.q_analytics import VISA_COUNTS_SQL, _CONF_SQL, _VISA_SQL
from jobweave.plans.registry import query
from jobweave.sources import adapters as ad
from jobweave.sources.adapters import AS_OF, JOBS_RAW_SQL, JOBS_SQL, jobs_processed, jobs_raw, pick, read, read_spread, sql_list, sql_pick

C = F.col


# -------------------------------------------------------------- projections
BLANKS = ["  padded  ", "nan", "NaN", "", "   ", "kept", None]


@query(
    "null_clean",
    f"""WITH t AS (SELECT event_id, trim({sql_pick(BLANKS, 'event_id')}) AS x FROM events)
    SELECT event_id, CASE WHEN x <> '' AND lower(x) <> 'nan' THEN x END AS cleaned FROM t""",
)
def null_clean(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", tx.null_clean(pick(BLANKS, C("event_id"))).alias("cleaned"))


@query(
    "truncate_ellipsis",
    "SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 497) || '...' ELSE text END AS short FROM documents",
)
def truncate_ellipsis(spark: SparkSession, d: str) -> DataFrame:
    return read_spread(spark, d, "documents").select("doc_id", tx.truncate_ellipsis(C("text"), 500).alias("short"))


@query(
    "truncate_at_sentence",
    """WITH h AS (SELECT doc_id, text, left(text, 1500) AS head FROM documents),
      p AS (SELECT *, CASE WHEN contains(head, '.') THEN 1500 - instr(reverse(head), '.') ELSE -1 END AS last FROM h)
    SELECT doc_id, CASE WHEN length(text) <= 1500 THEN text WHEN last > 1200 THEN left(head, last + 1)
      ELSE head || '...' END AS short FROM p""",
)
def truncate_at_sentence(spark: SparkSession, d: str) -> DataFrame:
    return read_spread(spark, d, "documents").select("doc_id", tx.truncate_at_sentence(C("text")).alias("short"))


@query("norm_key", f"WITH {JOBS_RAW_SQL} SELECT url, upper(trim(company)) AS company_key FROM jobs_raw")
def norm_key(spark: SparkSession, d: str) -> DataFrame:
    return jobs_raw(spark, d).select("url", tx.norm_key(C("company")).alias("company_key"))


@query(
    "annualize_wage",
    f"""WITH {ad.FILINGS_SQL} SELECT case_number, CAST(wage_rate_of_pay_from * CASE wage_unit_of_pay WHEN 'Hour' THEN 2080
      WHEN 'Week' THEN 52 WHEN 'Bi-Weekly' THEN 26 WHEN 'Month' THEN 12 ELSE 1 END AS DOUBLE) AS yearly,
      CAST(wage_rate_of_pay_from * CASE wage_unit_of_pay WHEN 'Hour' THEN 2080 ELSE 1 END AS DOUBLE) AS hour_only
    FROM filings""",
)
def annualize_wage(spark: SparkSession, d: str) -> DataFrame:
    pay, unit = C("wage_rate_of_pay_from"), C("wage_unit_of_pay")
    return ad.filings(spark, d).select(
        "case_number",
        nm.annualize_wage(pay, unit).cast("double").alias("yearly"),
        nm.annualize_wage(pay, unit, compat=True).cast("double").alias("hour_only"),
    )


@query(
    "relative_posting",
    f"""WITH {JOBS_SQL} SELECT url, days_since_posted, CASE WHEN days_since_posted = 0 THEN 'Today'
      WHEN days_since_posted = 1 THEN 'Yesterday'
      WHEN days_since_posted BETWEEN 0 AND 7 THEN days_since_posted || ' days ago' END AS posted_label FROM jobs""",
)
def relative_posting(spark: SparkSession, d: str) -> DataFrame:
    return an.relative_posting(jobs_processed(spark, d)).select("url", "days_since_posted", "posted_label")


@query(
    "salary_text",
    f"""WITH {JOBS_RAW_SQL} SELECT url, '$' || salary_min || '-$' || salary_max AS salary_range,
      CAST(salary_min + salary_max AS DOUBLE) / 2 AS salary_mid FROM jobs_raw""",
)
def salary_text(spark: SparkSession, d: str) -> DataFrame:
    low, high = C("salary_min"), C("salary_max")
    return jobs_raw(spark, d).select(
        "url", tx.salary_text_from_range(low, high).alias("salary_range"),
        nm.salary_mid(low, high).cast("double").alias("salary_mid"),
    )


# ----------------------------------------------------------- classification
@query(
    "role_ladder_words",
    f"""WITH {JOBS_RAW_SQL} SELECT title, count(*) AS n, CASE
        WHEN regexp_matches(upper(title), '\\bINTERN\\b|\\bENTRY\\b') THEN 'Entry Level'
        WHEN regexp_matches(upper(title), '\\bJUNIOR\\b|\\bASSOCIATE\\b') THEN 'Junior'
        WHEN regexp_matches(upper(title), '\\bSENIOR\\b|\\bSR\\b') THEN 'Senior'
        WHEN regexp_matches(upper(title), '\\bLEAD\\b|\\bPRINCIPAL\\b|\\bSTAFF\\b') THEN 'Lead/Principal'
        ELSE 'Mid-Level' END AS level FROM jobs_raw GROUP BY title""",
)
def role_ladder_words(spark: SparkSession, d: str) -> DataFrame:
    return jobs_raw(spark, d).groupBy("title").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "level", rules.experience(C("title"), word_boundary=True)
    )


DOC_RULES = [("spanish", ["ción", "que"]), ("french", ["eau", "ment"]), ("german", ["ung", "sch"]), ("english", ["th%ing"])]


@query(
    "classify_documents",
    """SELECT doc_id, CASE WHEN upper(text) LIKE '%CIÓN%' OR upper(text) LIKE '%QUE%' THEN 'spanish'
        WHEN upper(text) LIKE '%EAU%' OR upper(text) LIKE '%MENT%' THEN 'french'
        WHEN upper(text) LIKE '%UNG%' OR upper(text) LIKE '%SCH%' THEN 'german'
        WHEN upper(text) LIKE '%TH%ING%' THEN 'english' ELSE 'unknown' END AS label FROM documents""",
)
def classify_documents(spark: SparkSession, d: str) -> DataFrame:
    return read_spread(spark, d, "documents").select("doc_id", rules.classify_rules(C("text"), DOC_RULES, "unknown").alias("label"))


@query(
    "classify_visa",
    f"""WITH {JOBS_RAW_SQL}, k AS (SELECT *, lower(concat_ws(' ', title, description)) AS txt FROM jobs_raw),
      c AS (SELECT *, {VISA_COUNTS_SQL} FROM k)
    SELECT url, CASE WHEN h1b_sponsored = 'Yes' THEN 'H-1B' WHEN is_new_grad = 'Yes' THEN 'OPT' ELSE {_VISA_SQL} END AS visa_category,
      CASE WHEN h1b_sponsored = 'Yes' THEN 0.95::DOUBLE WHEN is_new_grad = 'Yes' THEN 0.85::DOUBLE ELSE {_CONF_SQL} END AS confidence,
      CASE WHEN h1b_sponsored = 'Yes' OR is_new_grad = 'Yes' THEN 'explicit' ELSE 'keywords' END AS method,
      CASE WHEN h1b_sponsored = 'Yes' OR is_new_grad = 'Yes' THEN 1 WHEN us >= 1 THEN us
        WHEN cpt >= 1 THEN cpt WHEN h1b >= 1 THEN h1b ELSE opt END AS signals FROM c""",
)
def classify_visa(spark: SparkSession, d: str) -> DataFrame:
    answer = rules.classify_visa(F.concat_ws(" ", "title", "description"), C("h1b_sponsored"), C("is_new_grad"))
    return jobs_raw(spark, d).withColumn("a", answer).select(
        "url", "a.visa_category", "a.confidence", "a.method", F.size("a.signals").alias("signals")
    )


@query(
    "classify_visa_substring",
    f"""WITH {JOBS_RAW_SQL}, k AS (SELECT *, lower(concat_ws(' ', title, description)) AS txt FROM jobs_raw),
      c AS (SELECT *, {VISA_COUNTS_SQL.replace(chr(92) + 'b', '')} FROM k)
    SELECT url, {_VISA_SQL} AS visa_category, {_CONF_SQL} AS confidence, {_CONF_SQL} < 0.5 AS needs_review FROM c""",
)
def classify_visa_substring(spark: SparkSession, d: str) -> DataFrame:
    answer = rules.classify_visa(F.concat_ws(" ", "title", "description"), word_boundary=False)
    return jobs_raw(spark, d).withColumn("a", answer).select(
        "url", "a.visa_category", "a.confidence", rules.needs_review(C("a.confidence")).alias("needs_review")
    )


@query(
    "update_unclassified",
    f"""WITH {JOBS_SQL}, k AS (SELECT *, lower(concat_ws(' ', title, description)) AS txt FROM jobs),
      c AS (SELECT *, {VISA_COUNTS_SQL} FROM k),
      v AS (SELECT *, CASE WHEN visa_category IS NULL THEN nullif({_VISA_SQL}, 'Unknown') END AS found, {_CONF_SQL} AS conf FROM c)
    SELECT url, coalesce(visa_category, found) AS visa_category,
      CASE WHEN found IS NOT NULL THEN conf ELSE classification_confidence END AS confidence,
      found IS NOT NULL AS stamped FROM v""",
)
def update_unclassified(spark: SparkSession, d: str) -> DataFrame:
    return inc.update_unclassified(jobs_processed(spark, d), AS_OF).select(
        "url", "visa_category", C("classification_confidence").alias("confidence"),
        C("classified_at").isNotNull().alias("stamped"),
    )


_TOKENS_SQL = "list_filter(regexp_split_to_array(regexp_replace(upper(replace(coalesce({0}, ''), 'ß', 'ss')), '[^A-Z0-9+ ]', ' ', 'g'), ' +'), lambda x: length(x) >= {1})"
_SINGLE = [s for s in rules.SKILLS if " " not in s]
_SKILL_SQL = f"""WITH {JOBS_RAW_SQL}, t AS (
      SELECT url, {_TOKENS_SQL.format("concat_ws(' ', description, title, qualifications)", 1)} AS w FROM jobs_raw),
    s AS (SELECT url, unnest(list_distinct(w)) AS skill FROM t),
    m AS (SELECT url, skill FROM s WHERE skill IN {sql_list(_SINGLE)}
      UNION ALL SELECT url, 'COMPUTER VISION' FROM t WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' COMPUTER VISION ')
      UNION ALL SELECT url, 'DEEP LEARNING' FROM t WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' DEEP LEARNING '))"""


def _skill_text():
    return F.concat_ws(" ", "description", "title", "qualifications")


@query(
    "top_skills",
    f"{_SKILL_SQL} SELECT skill, count(*) AS count FROM m GROUP BY skill ORDER BY count DESC, skill LIMIT 20",
)
def top_skills(spark: SparkSession, d: str) -> DataFrame:
    return an.top_skills(jobs_raw(spark, d), _skill_text())


WORDS = ["THE", "AND", "THAT", "WHICH", "IN", "OF", "QUE", "LES", "DER", "DIE", "LA", "OF THE", "IN THE"]
_WORD_PHRASES = " UNION ALL ".join(
    f"SELECT doc_id, '{p}' FROM t WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' {p} ')" for p in WORDS if " " in p
)


@query(
    "top_terms_documents",
    f"""WITH t AS (SELECT doc_id, {_TOKENS_SQL.format('text', 1)} AS w FROM documents),
      m AS (SELECT doc_id, skill FROM (SELECT doc_id, unnest(list_distinct(w)) AS skill FROM t)
          WHERE skill IN {sql_list([w for w in WORDS if ' ' not in w])} UNION ALL {_WORD_PHRASES})
    SELECT skill, count(*) AS count FROM m GROUP BY skill ORDER BY count DESC, skill LIMIT 20""",
)
def top_terms_documents(spark: SparkSession, d: str) -> DataFrame:
    return an.top_skills(read_spread(spark, d, "documents"), C("text"), skills=WORDS)


@query(
    "top_skills_compat",
    f"""{_SKILL_SQL} SELECT DISTINCT skill, 1 AS count FROM m WHERE length(skill) > 2 AND skill NOT LIKE '% %'
    ORDER BY skill LIMIT 20""",
)
def top_skills_compat(spark: SparkSession, d: str) -> DataFrame:
    return an.top_skills(jobs_raw(spark, d), _skill_text(), compat=True)


@query(
    "extract_skills",
    f"""{_SKILL_SQL}, o AS (SELECT url, skill, list_position({[*_SINGLE, 'COMPUTER VISION', 'DEEP LEARNING']}, skill) AS p FROM m)
    SELECT j.url, coalesce(string_agg(skill, ',' ORDER BY p), '') AS skills
    FROM jobs_raw j LEFT JOIN o ON j.url = o.url
    GROUP BY j.url""",
)
def extract_skills(spark: SparkSession, d: str) -> DataFrame:
    return jobs_raw(spark, d).select("url", F.array_join(rules.extract_skills(_skill_text()), ",").alias("skills"))


@query(
    "tokenize_documents",
    f"""WITH t AS (SELECT unnest({_TOKENS_SQL.format('text', 3)}) AS token FROM documents)
    SELECT token, count(*) AS n FROM t GROUP BY token""",
)
def tokenize_documents(spark: SparkSession, d: str) -> DataFrame:
    words = read_spread(spark, d, "documents").select(F.explode(rules.tokens(C("text"), 3)).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ parsing
PHONES = ["(617) 555-0100", "1-212-555-0123", "+1 415 555 0199", "555-0100", "", None, "22125550123"]


@query(
    "format_us_phone",
    f"""WITH p AS (SELECT c_custkey, {sql_pick(PHONES, 'c_custkey')} AS phone FROM customer),
      g AS (SELECT *, regexp_replace(phone, '[^0-9]', '', 'g') AS digits FROM p),
      t AS (SELECT *, CASE WHEN length(digits) = 10 THEN digits
        WHEN length(digits) = 11 AND starts_with(digits, '1') THEN substr(digits, 2) END AS ten FROM g)
    SELECT c_custkey, CASE WHEN phone = '' THEN NULL WHEN ten IS NOT NULL
      THEN '+1 (' || left(ten, 3) || ') ' || substr(ten, 4, 3) || '-' || substr(ten, 7, 4) ELSE phone END AS phone FROM t""",
)
def format_us_phone(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", tx.format_us_phone(pick(PHONES, C("c_custkey"))).alias("phone"))


PLACES = ["Boston", " bay area ", "New York City", "Oregon", "TX", "philadelphia", None]
_STATE_SQL = "CASE " + " ".join(f"WHEN x = '{k}' THEN '{v}'" for k, v in tx.STATE_CODES.items())


@query(
    "state_code",
    f"""WITH p AS (SELECT c_custkey, {sql_pick(PLACES, 'c_custkey')} AS place FROM customer),
      l AS (SELECT *, lower(trim(place)) AS x FROM p)
    SELECT c_custkey, {_STATE_SQL} ELSE left(upper(place), 2) END AS code FROM l""",
)
def state_code(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", tx.state_code(pick(PLACES, C("c_custkey"))).alias("code"))


_DATE_SHAPES = 16


def posted_texts() -> F.Column:
    """Dates of the events written in every accepted form."""
    ts, n = C("ts"), C("event_id")
    shape = lambda i, col, rest: F.when(n % _DATE_SHAPES == i, col).otherwise(rest)
    forms = [
        F.date_format(ts, "yyyy-MM-dd"), F.date_format(ts, "MM/dd/yyyy"), F.date_format(ts, "MMM d, yyyy"),
        F.date_format(ts, "MMMM d, yyyy"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(ts, "MM-dd-yyyy"), F.date_format(ts, "yyyy/MM/dd"),
        F.date_format(ts, "d MMM yyyy"), F.date_format(ts, "d MMMM yyyy"), F.concat((n % 40).cast("string"), F.lit(" days ago")),
        F.concat((n % 50).cast("string"), F.lit(" hours ago")), F.lit("Yesterday"), F.lit("today"), F.lit("N/A"),
        F.lit("not a date"),
    ]
    out = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        out = shape(i, form, out)
    return out


@query(
    "parse_posted_date",
    f"""SELECT event_id, CASE WHEN event_id % 16 IN (4, 5) THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
        WHEN event_id % 16 < 10 THEN strftime(ts, '%Y-%m-%d 00:00:00')
        WHEN event_id % 16 = 10 THEN strftime(TIMESTAMP '{ad.EVENTS_AS_OF}' - INTERVAL 1 DAY * (event_id % 40), '%Y-%m-%d %H:%M:%S')
        WHEN event_id % 16 = 11 THEN strftime(TIMESTAMP '{ad.EVENTS_AS_OF}' - INTERVAL 1 HOUR * (event_id % 50), '%Y-%m-%d %H:%M:%S')
        WHEN event_id % 16 = 12 THEN strftime(TIMESTAMP '{ad.EVENTS_AS_OF}' - INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S')
        WHEN event_id % 16 = 13 THEN '{ad.EVENTS_AS_OF} 00:00:00' END AS posted FROM events""",
)
def parse_posted_date(spark: SparkSession, d: str) -> DataFrame:
    posted = tx.parse_posted_date(posted_texts(), ad.EVENTS_AS_OF)
    return read(spark, d, "events").select("event_id", F.date_format(posted, "yyyy-MM-dd HH:mm:ss").alias("posted"))


SIZES = ["11-50 people", "team of 5", "1000+", "about 201-500", None]
GRADS = ["New Grad welcome", "senior", "Entry Level", "new-grad track", "grad"]


@query(
    "company_size_and_grad",
    f"""SELECT p_partkey, {' OR '.join(f"contains({sql_pick(SIZES, 'p_partkey')}, '{s}')" for s in tx.COMPANY_SIZES)} AS is_size,
      {' OR '.join(f"contains(lower({sql_pick(GRADS, 'p_partkey')}), '{s}')" for s in tx.NEW_GRAD_TERMS)} AS is_grad FROM part""",
)
def company_size_and_grad(spark: SparkSession, d: str) -> DataFrame:
    key = C("p_partkey")
    return read(spark, d, "part").select(
        "p_partkey", tx.company_size_in(pick(SIZES, key)).alias("is_size"), tx.is_new_grad_text(pick(GRADS, key)).alias("is_grad")
    )


ID_TEXTS = ["Job ID: AB-1", "Requisition # 77X", "ID: 1234567", "req 9", "none"]


@query(
    "extract_job_id",
    f"""WITH t AS (SELECT p_partkey, {sql_pick(ID_TEXTS, 'p_partkey')} || ' ' || p_brand AS x FROM part)
    SELECT p_partkey, coalesce({', '.join(f"nullif(regexp_extract(x, '{p}', 1), '')" for p in tx.JOB_ID_PATTERNS)}, '') AS job_id FROM t""",
)
def extract_job_id(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(pick(ID_TEXTS, C("p_partkey")), F.lit(" "), C("p_brand"))
    return read(spark, d, "part").select("p_partkey", tx.extract_job_id(text).alias("job_id"))


@query(
    "clean_model_json",
    """SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) AND value <= 1.0 THEN 'CPT' END AS label,
      CASE WHEN event_id % 5 IN (0, 1) AND value <= 1.0 THEN value END AS confidence FROM events""",
)
def clean_model_json(spark: SparkSession, d: str) -> DataFrame:
    n = C("event_id") % 5
    body = F.concat(F.lit('{"visa_category": "'), F.when(n == 2, "Other").otherwise("CPT"), F.lit('", "confidence": '), C("value"), F.lit(', "signals": ["cpt"]}'))
    reply = (
        F.when(n == 0, body)
        .when(n == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\n")))
        .when(n == 2, body)
        .when(n == 3, F.lit("no json at all"))
        .otherwise(F.lit('{"visa_category": "CPT"'))
    )
    parsed = tx.clean_model_json(reply, rules.VISA_LABELS)
    return read(spark, d, "events").select(
        "event_id", parsed["visa_category"].alias("label"), parsed["confidence"].alias("confidence")
    )


@query(
    "cache_keys",
    """SELECT conv_id, turn, conv_id || '_' || turn AS pair_key,
      md5(lower(trim(text)) || '|resume:' || text || '|history:' || role) AS cache_key FROM conversations""",
)
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return read_spread(spark, d, "conversations").select(
        "conv_id", "turn",
        tx.composite_key(C("conv_id").cast("string"), C("turn").cast("string")).alias("pair_key"),
        tx.cache_key(C("text"), C("text"), C("role")).alias("cache_key"),
    )


@query(
    "embedding_text",
    f"""WITH {JOBS_RAW_SQL} SELECT url, title || '. ' || company || '. ' || description AS body,
      coalesce(qualifications, title) AS skills FROM jobs_raw""",
)
def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    return jobs_raw(spark, d).select(
        "url",
        tx.embedding_text(C("title"), C("company"), C("description")).alias("body"),
        tx.skills_text(C("qualifications"), C("title")).alias("skills"),
    )


@query(
    "json_columns",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS kind FROM events""",
)
def json_columns(spark: SparkSession, d: str) -> DataFrame:
    record = F.to_json(F.struct("event_type", F.try_parse_json("props").alias("props")))
    doc = F.try_parse_json(record)
    return read(spark, d, "events").select(
        "event_id",
        F.try_variant_get(doc, "$.props.k", "long").alias("k"),
        F.try_variant_get(doc, "$.event_type", "string").alias("kind"),
    )


@query(
    "flatten_skill_map",
    """SELECT c_custkey, 'lang' || (c_custkey % 3) || ',sql,tool' || (c_custkey % 5) AS skills FROM customer""",
)
def flatten_skill_map(spark: SparkSession, d: str) -> DataFrame:
    key = C("c_custkey")
    skills = F.create_map(
        F.lit("languages"), F.array(F.concat(F.lit("lang"), key % 3), F.lit("sql")),
        F.lit("tools"), F.array(F.concat(F.lit("tool"), key % 5)),
    )
    return read(spark, d, "customer").select("c_custkey", F.array_join(tx.flatten_skill_map(skills), ",").alias("skills"))


# -------------------------------------------------------------------- pages
def _posting_json(o, n, p):
    """One JSON-LD document per line item, in every accepted shape and some broken ones."""
    title = pick(ad.TITLES, p)
    city = pick(["Boston", "Austin", "Toronto", ""], o)
    state = pick(["MA", "TX", "Canada", ""], o)
    posting = F.concat(
        F.lit('{"@context":"https://schema.org","@type":"JobPosting","title":"'), title,
        F.lit('","identifier":{"value":"R'), o, F.lit("-"), n,
        F.lit('"},"jobLocation":{"address":{"addressLocality":"'), city, F.lit('","addressRegion":"'), state,
        F.lit('"}},"employmentType":'), F.when(n % 2 == 0, F.lit('["FULL_TIME","INTERN"]')).otherwise(F.lit('"CONTRACT"')),
        F.lit(',"baseSalary":{"value":{"minValue":'), (p + 100).cast("string"), F.lit(',"maxValue":'), (p + 200).cast("string"),
        F.lit('}},"description":"'), F.repeat(F.lit("words "), 100), F.lit('","datePosted":"2001-05-0'), n, F.lit('"}'),
    )

    def shaped(x):
        return (
            F.when(n == 1, x)
            .when(n == 2, F.concat(F.lit("["), x, F.lit(","), x, F.lit("]")))
            .when(n == 3, F.concat(F.lit('{"@graph":['), x, F.lit(',{"@type":"Organization"}]}')))
            .when(n == 4, F.concat(x, F.lit("}{broken")))
            .when(n == 5, F.lit('{"@type":"Organization","title":"none"}'))
            .otherwise(F.lit('{"broken": '))
        )

    return F.concat(
        F.lit('<html><head><script>var x = "JobPosting";</script><script type="application/ld+json">'),
        rules.bind(posting, shaped), F.lit("</script></head><body><p>Jobs</p></body></html>"),
    )


@query(
    "jsonld_postings",
    f"""WITH r AS (SELECT unnest(CASE l_linenumber WHEN 1 THEN [0] WHEN 2 THEN [0, 1] WHEN 3 THEN [0] END) AS pos, *
      FROM lineitem WHERE l_linenumber <= 3 AND l_orderkey % 4 <> 2)
    SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS page_id, pos,
      'R' || l_orderkey || '-' || l_linenumber AS job_id, {sql_pick(ad.TITLES, 'l_partkey')} AS title,
      CASE l_orderkey % 4 WHEN 0 THEN 'Boston, MA' WHEN 1 THEN 'Austin, TX' ELSE 'USA' END AS location,
      CASE WHEN l_linenumber % 2 = 0 THEN 'FULL_TIME, INTERN' ELSE 'CONTRACT' END AS job_type,
      '$' || (l_partkey + 100) || '-$' || (l_partkey + 200) AS salary_range, 500 AS description_chars,
      'R' || l_orderkey || '-' || l_linenumber AS apply_url, '2001-05-0' || l_linenumber AS posted_date FROM r""",
)
def jsonld_postings(spark: SparkSession, d: str) -> DataFrame:
    pages = read_spread(spark, d, "lineitem").select(
        F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("page_id"),
        F.lit("https://jobs.example.com/all").alias("url"),
        _posting_json(C("l_orderkey"), C("l_linenumber"), C("l_partkey")).alias("html"),
    )
    return pg.jsonld_postings(pages, description_chars=500).withColumn("description_chars", F.length("description")).drop("description")


def card_pages(spark: SparkSession, d: str) -> DataFrame:
    """One page per order with two cards, a foreign card and a navigation card."""
    key = C("o_orderkey")
    title = F.replace(pick(ad.TITLES, key), F.lit("Back End"), F.lit("Server"))
    return read_spread(spark, d, "orders").select(
        key.alias("page_id"),
        F.lit("https://careers.example.com/list?page=1").alias("url"),
        F.concat(
            F.lit('<div class="header">Jobs</div><ul><li class="Job-Card big"><h3><b>'), title, F.lit(" Position"),
            F.lit('</b></h3><span class="job-location">Boston, MA</span><span class="employment">Full</span>'
                  '<a href="/job/'), key, F.lit('">Read more about it</a><p>Job ID: A'), key,
            F.lit('</p></li><li class="posting"><a href="detail?x=1">'), title, F.lit(" Opening "), key,
            F.lit('</a></li><li class="opening"><h2>Remote work abroad</h2><i class="office">London, United Kingdom</i></li>'
                  '<li class="position-list"><a>View all positions</a></li></ul>'),
        ).alias("html"),
    )


@query(
    "card_postings",
    f"""WITH t AS (SELECT o_orderkey, replace({sql_pick(ad.TITLES, 'o_orderkey')}, 'Back End', 'Server') AS title FROM orders)
    SELECT o_orderkey AS page_id, 0 AS pos, 'A' || o_orderkey AS job_id, title || ' Position' AS title, 'Boston, MA' AS location,
      'Full' AS job_type, 'https://careers.example.com/job/' || o_orderkey AS apply_url FROM t
    UNION ALL SELECT o_orderkey, 3, '', title || ' Opening ' || o_orderkey, 'USA', '',
      'https://careers.example.com/detail?x=1' FROM t""",
)
def card_postings(spark: SparkSession, d: str) -> DataFrame:
    return pg.card_postings(card_pages(spark, d))


@query(
    "page_postings",
    f"""WITH t AS (SELECT o_orderkey, replace({sql_pick(ad.TITLES, 'o_orderkey')}, 'Back End', 'Server') AS title FROM orders),
      r AS (SELECT o_orderkey AS page_id, 0 AS strategy, {sql_pick(ad.TITLES, 'l_partkey')} AS title,
          CASE l_orderkey % 4 WHEN 0 THEN 'Boston, MA' WHEN 1 THEN 'Austin, TX' ELSE 'USA' END AS location,
          unnest(CASE l_linenumber WHEN 1 THEN [0] WHEN 2 THEN [0, 1] WHEN 3 THEN [0] END) AS k
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber <= 3 AND l_orderkey % 4 <> 2
        UNION ALL SELECT o_orderkey, 1, title || ' Position', 'Boston, MA', 0 FROM t
        UNION ALL SELECT o_orderkey, 1, title || ' Opening ' || o_orderkey, 'USA', 0 FROM t),
      c AS (SELECT *, count(*) FILTER (strategy = 0) OVER (PARTITION BY page_id) >= 5 AS enough FROM r),
      m AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS size FROM (
        SELECT DISTINCT ON (page_id, lower(title), lower(location)) * FROM c WHERE NOT enough
        ORDER BY page_id, lower(title), lower(location), strategy))
    SELECT page_id, strategy, title, location FROM c WHERE enough AND strategy = 0
    UNION ALL SELECT page_id, strategy, title, location FROM m WHERE size >= 3""",
)
def page_postings(spark: SparkSession, d: str) -> DataFrame:
    """Both strategies and their cascade over one set of pages: the blocks of an order's items and its cards."""
    # an order's items cross the network as numbers; their text, some hundred times as long, is made where the page is
    items = read(spark, d, "lineitem").groupBy(C("l_orderkey").alias("page_id")).agg(
        F.collect_list(F.struct("l_linenumber", "l_partkey")).alias("items")
    )
    blocks = F.transform("items", lambda x: _posting_json(C("page_id"), x["l_linenumber"], x["l_partkey"]))
    pages = card_pages(spark, d).join(items, "page_id", "left").withColumn(
        "html", F.concat(F.coalesce(F.array_join(F.sort_array(F.filter(blocks, lambda b: b.isNotNull())), ""), F.lit("")), "html")
    ).drop("items")
    return pg.page_postings(pages).select("page_id", "strategy", "title", "location")


_CASCADE_A = "SELECT o_custkey AS page_id, o_orderkey AS pos, o_orderpriority AS title, o_orderstatus AS location, 0 AS strategy FROM orders"
_CASCADE_B = "SELECT l_suppkey AS page_id, l_orderkey * 10 + l_linenumber AS pos, upper(l_returnflag) AS title, l_linestatus AS location, 1 AS strategy FROM lineitem"


@query(
    "strategy_cascade",
    f"""WITH r AS ({_CASCADE_A} UNION ALL {_CASCADE_B}),
      c AS (SELECT page_id, CASE WHEN count(*) FILTER (strategy = 0) >= 12 THEN 0
        WHEN count(*) FILTER (strategy = 1) >= 12 THEN 1 END AS chosen FROM r GROUP BY 1),
      t AS (SELECT r.*, chosen FROM r JOIN c USING (page_id)),
      m AS (SELECT page_id, strategy, title, location, count(*) OVER (PARTITION BY page_id) AS size FROM (
        SELECT DISTINCT ON (page_id, lower(title), lower(location)) * FROM t WHERE chosen IS NULL
        ORDER BY page_id, lower(title), lower(location), strategy, pos))
    SELECT page_id, strategy, title, location FROM t WHERE strategy = chosen
    UNION ALL SELECT page_id, strategy, title, location FROM m WHERE size >= 3""",
)
def strategy_cascade(spark: SparkSession, d: str) -> DataFrame:
    first = read(spark, d, "orders").select(
        C("o_custkey").alias("page_id"), C("o_orderkey").alias("pos"), C("o_orderpriority").alias("title"),
        C("o_orderstatus").alias("location"),
    )
    second = read(spark, d, "lineitem").select(
        C("l_suppkey").alias("page_id"), (C("l_orderkey") * 10 + C("l_linenumber")).alias("pos"),
        F.upper("l_returnflag").alias("title"), C("l_linestatus").alias("location"),
    )
    return st.strategy_cascade([first, second], "page_id", enough=12).select("page_id", "strategy", "title", "location")


EXTRA_LINKS = [
    '<a href="/jobs/', '?a=1&amp;b=2#top">Open role</a><a href="detail/', '">Detail</a><a class="x" href="//other.example.com/job/',
    '">Elsewhere</a><a href="/teams/', '">A label long enough but for a category</a><a href="?view=', '">A label that is long <b>enough</b></a>',
]


def linked_pages(spark: SparkSession, d: str) -> DataFrame:
    """The pages with some more links at the end."""
    parts = [x for text in EXTRA_LINKS for x in (F.lit(text), C("page_id").cast("string"))][:-1]
    return read_spread(spark, d, "pages").withColumn("html", F.concat("html", *parts))


_LINKED_SQL = " || ".join(x for text in EXTRA_LINKS for x in (ad.sql_text(text), "page_id"))[: -len(" || page_id")]

_LINKS_SQL = r"""a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref\s*=\s*["''][^"'']*["''][^>]*>.*?</a>')) AS a,
      generate_subscripts(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref\s*=\s*["''][^"'']*["''][^>]*>.*?</a>'), 1) - 1 AS pos FROM linked),
  h AS (SELECT page_id, url AS base, pos, replace(regexp_extract(a, '(?is)\bhref\s*=\s*["'']([^"'']*)["'']', 1), '&amp;', '&') AS href,
      trim(regexp_replace(regexp_replace(a, '(?is)^<a\b[^>]*>|</a>$', '', 'g'), '(?s)<[^>]*>', '', 'g')) AS text FROM a),
  u AS (SELECT *, regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)', 0) AS site,
      regexp_replace(base, '#.*$', '') AS bare, regexp_replace(base, '[?#].*$', '') AS path FROM h),
  links AS (SELECT page_id, base, pos, text, CASE WHEN href = '' THEN bare
      WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href
      WHEN starts_with(href, '//') THEN regexp_extract(base, '^([A-Za-z]+):', 1) || ':' || href
      WHEN starts_with(href, '/') THEN site || href WHEN starts_with(href, '#') THEN bare || href
      WHEN starts_with(href, '?') THEN path || href
      ELSE CASE WHEN path = site THEN site || '/' ELSE regexp_replace(path, '[^/]*$', '') END || href END AS target FROM u),
  hosted AS (SELECT *, regexp_extract(target, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) =
      regexp_extract(base, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS same FROM links)"""


def _has_sql(col: str, values: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), '{v}')" for v in values) + ")"


@query(
    "job_links",
    f"""WITH linked AS (SELECT page_id, url, html || {_LINKED_SQL} AS html FROM pages), {_LINKS_SQL}, w AS (SELECT page_id, regexp_replace(target, '#.*$', '') AS job_url, min(pos) AS pos FROM hosted
      WHERE same AND regexp_replace(target, '[#?].*$', '') <> regexp_replace(base, '[#?].*$', '')
        AND ({_has_sql('target', pg.JOB_URL_PARTS)} OR (length(text) > 20 AND NOT {_has_sql('text', pg.NAVIGATION)}))
        AND NOT ({_has_sql('target', pg.CATEGORY_PATHS)} AND NOT {_has_sql('target', pg.CATEGORY_EXCEPTIONS)})
      GROUP BY 1, 2)
    SELECT page_id, job_url, pos FROM w QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 50""",
)
def job_links(spark: SparkSession, d: str) -> DataFrame:
    return pg.job_links(linked_pages(spark, d), limit=50)


@query(
    "candidate_links",
    f"""WITH linked AS (SELECT page_id, url, html || {_LINKED_SQL} AS html FROM pages), {_LINKS_SQL}, w AS (SELECT page_id, target AS link, min(pos) AS pos, arg_min(text, pos) AS text FROM hosted
      WHERE same AND text <> '' AND length(text) <= 100 AND starts_with(target, 'http') GROUP BY 1, 2)
    SELECT page_id, link, pos, text FROM w QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 200""",
)
def candidate_links(spark: SparkSession, d: str) -> DataFrame:
    return pg.candidate_links(linked_pages(spark, d), limit=200)


def _times(word: str) -> str:
    return f"CAST((length(h) - length(replace(h, '{word}', ''))) // {len(word)} AS INT)"


@query(
    "listing_pages",
    f"""WITH p AS (SELECT page_id, html, lower(html) AS h FROM pages),
      s AS (SELECT page_id,
        ((contains(h, 'showing') OR contains(h, 'displaying') OR contains(h, 'found')) AND contains(h, 'job'))::INT
          + ({_times('apply')} > 8 OR {_times('apply now')} > 5)::INT
          + ({_times('job id')} > 5 OR {_times('req id')} > 5 OR {_times('requisition')} > 5)::INT
          + (contains(h, 'results') AND contains(h, 'job'))::INT AS strong,
        ({_times('job title')} > 3)::INT + ({_times('location')} > 10 AND contains(h, 'job'))::INT
          + (contains(h, 'job openings') OR contains(h, 'current openings') OR contains(h, 'open positions'))::INT
          + (contains(h, 'search results') OR contains(h, 'search jobs'))::INT AS medium,
        len(regexp_extract_all(html, '(?is)<(?:div|li|article|tr)\\b[^>]*\\bclass\\s*=\\s*["''][^"'']*(?:{'|'.join(pg.CONTAINER_WORDS)})')) AS containers,
        len(regexp_extract_all(html, '(?is)<(?:a|button)\\b[^>]*>[^<]*(?:apply|view)[^<]*</(?:a|button)>')) AS buttons FROM p)
    SELECT page_id, strong, medium, containers, buttons, strong >= 2 OR (strong >= 1 AND medium >= 1) OR containers > 8
      OR (containers > 3 AND buttons > 3) OR (medium >= 2 AND containers > 2) AS is_listing FROM s""",
)
def listing_pages(spark: SparkSession, d: str) -> DataFrame:
    return pg.is_listing_page(read_spread(spark, d, "pages")).select(
        "page_id", "strong", "medium", "containers", "buttons", "is_listing"
    )


@query(
    "api_endpoints",
    """SELECT page_id, CASE page_id % 4
        WHEN 0 THEN regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || '/data/search.json?q=1'
        WHEN 1 THEN 'https://feeds.example.com/jobs/v1'
        WHEN 2 THEN 'https://' || regexp_extract(url, '://([^/?#]*)', 1) || '/api/jobs' END AS endpoint FROM pages""",
)
def api_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """The pages with a script that loads postings in one of the known ways."""
    n = C("page_id") % 4
    script = (
        F.when(n == 0, F.lit('<script>load("/data/search.json?q=1")</script>'))
        .when(n == 1, F.lit("<script>fetch('https://feeds.example.com/jobs/v1').then(show)</script>"))
        .when(n == 2, F.concat(F.lit("<p>https://"), pg.url_host(C("url")), F.lit("/api/jobs</p>")))
        .otherwise(F.lit(""))
    )
    pages = read_spread(spark, d, "pages").withColumn("html", F.concat("html", script))
    return pages.select("page_id", pg.api_endpoint(C("url"), C("html")).alias("endpoint"))


@query(
    "sitemap_job_urls",
    """SELECT s_suppkey AS site, pos::INT AS pos, 'https://x.example.com/jobs/' || s_suppkey || '/' || (pos * 2 + 1) AS job_url
    FROM supplier, generate_series(0, 29) t(pos)""",
)
def sitemap_job_urls(spark: SparkSession, d: str) -> DataFrame:
    key = C("s_suppkey").cast("string")

    def entry(i):
        kind = F.when(i % 2 == 1, F.lit("jobs")).otherwise(F.lit("news"))
        return F.concat(F.lit("<url><loc> https://x.example.com/"), kind, F.lit("/"), key, F.lit("/"), i.cast("string"), F.lit("\n</loc></url>"))

    xml = F.concat(F.lit("<urlset>"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(79)), entry), ""), F.lit("</urlset>"))
    maps = read(spark, d, "supplier").select(C("s_suppkey").alias("site"), xml.alias("xml"))
    return pg.sitemap_job_urls(maps, limit=30)


CELLS = [
    "Software Engineer", "Boston, MA", "Remote", "$120k/yr", "H1B sponsor", "Globex Corp", "2024-01-15", "11-50",
    "New Grad", "Data Analyst", "Initech", "Austin, TX", "Apply", "x", "3 days ago", "Hybrid",
]


def grid_cells(spark: SparkSession, d: str) -> DataFrame:
    """Grid rows: the line items of an order are its cells."""
    return read(spark, d, "lineitem").select(
        C("l_orderkey").alias("row_id"),
        (C("l_linenumber").cast("long") * 1_000_000_000 + C("l_partkey") * 10_000 + C("l_suppkey")).alias("pos"),
        pick(CELLS, C("l_partkey")).alias("cell_text"),
    )


@query("assign_cells")
def assign_cells(spark: SparkSession, d: str) -> DataFrame:
    return pg.assign_cells(grid_cells(spark, d), ad.EVENTS_AS_OF)


# ------------------------------------------------------------ conversations
TALK = [
    "Show me software engineer jobs at Google in Seattle", "What about Microsoft Inc.?", "Salary at Amazon vs Meta",
    "Do they sponsor H-1B there?", "data analyst roles in the bay area", "who is the attorney for Nvidia",
    "Uber, Stripe and Oracle in New York", "compare it with that company", "review my resume", "Tesla in Austin",
    "career advice", "hello",
]
REPLIES = [
    "Found 3:\n- Globex Corporation, 12 jobs\n* **Initech LLC**\n1 Umbrella Inc., open", "Salary is $120,000 at Acme Widgets in Boston",
    "Nothing found.", "- Globex corporation\n- Ab\nwork at Soylent Foods for two years",
]


def talks(spark: SparkSession, d: str) -> DataFrame:
    """Conversations whose turns also carry job-search phrases."""
    n = C("conv_id") * 7 + C("turn")
    phrase = F.when(C("role") == "assistant", pick(REPLIES, n)).otherwise(pick(TALK, n))
    return read_spread(spark, d, "conversations").withColumn("text", F.concat(C("text"), F.lit("\n"), phrase))


TALKS_SQL = f"""talks AS (SELECT conv_id, turn, role, text || chr(10) || CASE WHEN role = 'assistant'
    THEN {sql_pick(REPLIES, 'conv_id * 7 + turn')} ELSE {sql_pick(TALK, 'conv_id * 7 + turn')} END AS text FROM conversations),
  wide AS (SELECT *, ' ' || regexp_replace(text, '([^\\pL\\pN_])', '\\1\\1', 'g') || ' ' AS x FROM talks)"""


def mention_sql(words: list[str]) -> str:
    """Names between non-word characters; single characters were doubled so that neighbours do not share one."""
    names = "|".join(w.replace(" ", "  ") for w in words)
    found = f"regexp_extract_all(x, '(?i)[^\\pL\\pN_]({names})[^\\pL\\pN_]', 1)"
    return f"list_transform({found}, lambda m: replace(lower(m), '  ', ' '))"


def distinct_in_order_sql(expr: str) -> str:
    return f"list_filter({expr}, lambda v, i: list_position({expr}, v) = i)"


ENTITIES_SQL = f"""{TALKS_SQL}, found AS (SELECT *, {mention_sql(cv.COMPANIES)} AS c0, {mention_sql(cv.LOCATIONS)} AS l0,
    {mention_sql(cv.JOB_TITLES)} AS t0 FROM wide),
  ents AS (SELECT *, {distinct_in_order_sql('c0')} AS companies, {distinct_in_order_sql('l0')} AS locations,
    {distinct_in_order_sql('t0')} AS job_titles FROM found)"""

INTENT_SQL = (
    "CASE "
    + " ".join(
        f"WHEN regexp_matches(' ' || lower(text) || ' ', '[^\\pL\\pN_]({words})[^\\pL\\pN_]') THEN '{name}'"
        for name, words in cv.INTENTS
    )
    + " ELSE 'general' END"
)


@query(
    "conversation_entities",
    f"""WITH {ENTITIES_SQL} SELECT conv_id, turn, array_to_string(companies, ',') AS companies,
      array_to_string(locations, ',') AS locations, array_to_string(job_titles, ',') AS job_titles FROM ents""",
)
def conversation_entities(spark: SparkSession, d: str) -> DataFrame:
    found = {n: F.array_join(c, ",").alias(n) for n, c in cv.entities(C("text")).items()}
    return talks(spark, d).select("conv_id", "turn", *found.values())


@query("conversation_intent", f"WITH {TALKS_SQL} SELECT conv_id, turn, {INTENT_SQL} AS intent FROM talks")
def conversation_intent(spark: SparkSession, d: str) -> DataFrame:
    return talks(spark, d).select("conv_id", "turn", cv.intent(C("text")).alias("intent"))


def _remember_sql(col: str) -> str:
    """Queue of the last five distinct names over a list of lists, oldest first."""
    step = "CASE WHEN list_contains(acc, v) THEN acc ELSE list_append(acc, v)[-5:] END"
    return f"list_reduce(list_prepend([]::VARCHAR[], list_transform(flatten({col}), lambda v: [v])), lambda acc, n: {step.replace('v)', 'n[1])')})"


STATE_SQL = f"""{ENTITIES_SQL},
  asked AS (SELECT conv_id, turn, text, {INTENT_SQL} AS last_intent, list(companies) OVER w AS cs, list(locations) OVER w AS ls,
      list(job_titles) OVER w AS ts, least(count(*) OVER w, 10) AS turns_kept
    FROM ents WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  state AS (SELECT conv_id, turn, text, last_intent, {_remember_sql('cs')} AS companies, {_remember_sql('ls')} AS locations,
      {_remember_sql('ts')} AS job_titles, turns_kept FROM asked)"""


@query(
    "conversation_state",
    f"""WITH {STATE_SQL} SELECT conv_id, turn, last_intent, array_to_string(companies, ',') AS companies,
      array_to_string(locations, ',') AS locations, array_to_string(job_titles, ',') AS job_titles, turns_kept FROM state""",
)
def conversation_state(spark: SparkSession, d: str) -> DataFrame:
    state = cv.conversation_state(talks(spark, d))
    lists = [F.array_join(t, ",").alias(t) for t in cv.ENTITY_TYPES]
    return state.select("conv_id", "turn", "last_intent", *lists, "turns_kept")


@query(
    "conversation_state_in_pieces",
    f"""WITH {STATE_SQL} SELECT conv_id, turn, array_to_string(companies, ',') AS companies,
      array_to_string(locations, ',') AS locations FROM state""",
)
def conversation_state_in_pieces(spark: SparkSession, d: str) -> DataFrame:
    state = cv.conversation_state(talks(spark, d), chunk_turns=3)
    return state.select("conv_id", "turn", F.array_join("companies", ",").alias("companies"), F.array_join("locations", ",").alias("locations"))


@query(
    "resolve_references",
    f"""WITH {STATE_SQL}, b AS (SELECT *, lag(companies[-1]) OVER (PARTITION BY conv_id ORDER BY turn) AS prior_company,
        lag(locations[-1]) OVER (PARTITION BY conv_id ORDER BY turn) AS prior_location FROM state)
    SELECT conv_id, turn, prior_company, prior_location,
      contains(text, 'Do they sponsor H-1B there?') AND prior_company IS NOT NULL AND prior_location IS NOT NULL AS both_known,
      CASE WHEN contains(text, 'Do they sponsor H-1B there?') THEN 'Do ' || coalesce(prior_company, 'they') || ' sponsor H-1B '
        || coalesce(prior_location, 'there') || '?' END AS line FROM b""",
)
def resolve_references(spark: SparkSession, d: str) -> DataFrame:
    turns = talks(spark, d)
    resolved = cv.resolved_turns(turns, cv.conversation_state(turns))
    asked = C("text").contains("Do they sponsor H-1B there?")
    return resolved.select(
        "conv_id", "turn", "prior_company", "prior_location",
        (asked & C("prior_company").isNotNull() & C("prior_location").isNotNull()).alias("both_known"),
        F.when(asked, F.regexp_extract("resolved", r"(Do [^\n]* sponsor H-1B [^\n]*\?)$", 1)).alias("line"),
    )


@query("companies_from_history")
def companies_from_history(spark: SparkSession, d: str) -> DataFrame:
    return cv.companies_from_history(talks(spark, d))
