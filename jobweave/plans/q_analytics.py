"""Queries over market statistics, employers and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.operators import analytics as an
from jobweave.operators import filters as flt
from jobweave.operators import incremental as inc
from jobweave.operators import sponsors as sp
from jobweave.plans.q_staging import CACHE_SQL, classification_cache
from jobweave.plans.registry import cents_avg, half_up, query
from jobweave.sources import adapters as ad
from jobweave.sources.adapters import AS_OF, EVENTS_AS_OF, FILINGS_SQL, JOBS_SQL, jobs_processed, read, sql_list

PAY = "CASE WHEN salary_min > 0 THEN salary_min END"
FACTOR = "CASE wage_unit_of_pay WHEN 'Hour' THEN 2080 WHEN 'Week' THEN 52 WHEN 'Bi-Weekly' THEN 26 WHEN 'Month' THEN 12 ELSE 1 END"
WAGE = f"wage_rate_of_pay_from * {FACTOR}"

INTEL_SQL = f"""{FILINGS_SQL},
metrics AS (
  SELECT upper(trim(employer_name)) AS employer_clean, employer_name AS employer_original,
    count(*) AS total_filings, count(*) FILTER (case_status = 'Certified') AS total_certified,
    count(*) FILTER (case_status = 'Denied') AS total_denied,
    count(*) FILTER (loaded_at >= DATE '{AS_OF}' - INTERVAL 6 MONTH) AS filings_6mo,
    {cents_avg(WAGE)} AS avg_wage_offered,
    bool_or(willful_violator = 'Y') AS is_violator, count(DISTINCT worksite_state) AS states_count,
    max(loaded_at) AS last_filing_date
  FROM filings WHERE case_status IN ('Certified', 'Denied', 'Withdrawn') GROUP BY 1, 2),
intel AS (
  SELECT *, total_certified::DOUBLE / total_filings AS approval_rate,
    CAST((2 * (total_certified * 3500 + (least(filings_6mo, 10) * 250 + least(total_filings, 100) * 15
        + CASE WHEN is_violator THEN 0 ELSE 2000 END + least(states_count, 10) * 50) * total_filings)
      + 10 * total_filings) // (20 * total_filings) AS DOUBLE) / 10.0::DOUBLE AS sponsorship_score,
    CASE WHEN is_violator OR total_certified * 2 < total_filings THEN 'High Risk'
      WHEN total_certified * 4 < total_filings * 3 THEN 'Medium Risk' ELSE 'Low Risk' END AS risk_level
  FROM metrics WHERE total_filings >= 5)"""

NOISE_SQL = f"""company IS NOT NULL AND company NOT IN {sql_list(flt.COMPANY_NOISE + flt.STATE_NOISE)}
  AND lower(company) NOT LIKE 'international%' AND length(company) > 2"""
PLACE_SQL = f"""location IS NOT NULL AND location <> '' AND location NOT IN {sql_list(flt.LOCATION_NOISE)}
  AND lower(location) NOT LIKE '%remote%' AND length(location) > 2"""


def intel(spark: SparkSession, d: str) -> DataFrame:
    return sp.employer_intelligence(ad.filings(spark, d), AS_OF)


def approvals(spark: SparkSession, d: str) -> DataFrame:
    return sp.employer_approvals(ad.filings(spark, d))


@query(
    "employer_summary",
    f"""WITH {FILINGS_SQL}
    SELECT upper(trim(employer_name)) AS employer_clean, employer_name, count(*) AS total_petitions,
      count(*) FILTER (case_status = 'Certified') AS certified_petitions, max(worksite_city) AS h1b_city,
      max(worksite_state) AS h1b_state,
      round(count(*) FILTER (case_status = 'Certified')::DOUBLE / count(*), 6) AS avg_approval_rate
    FROM filings WHERE employer_name IS NOT NULL GROUP BY 1, 2""",
)
def employer_summary(spark: SparkSession, d: str) -> DataFrame:
    return sp.employer_summary(ad.filings(spark, d)).withColumn("avg_approval_rate", F.round("avg_approval_rate", 6))


@query(
    "employer_intelligence",
    f"""WITH {INTEL_SQL}
    SELECT employer_clean, employer_original, total_filings, total_certified, total_denied, filings_6mo,
      avg_wage_offered, is_violator, states_count, strftime(last_filing_date, '%Y-%m-%d') AS last_filing_date,
      round(approval_rate, 6) AS approval_rate, sponsorship_score, risk_level FROM intel""",
)
def employer_intelligence(spark: SparkSession, d: str) -> DataFrame:
    return (
        intel(spark, d)
        .withColumn("last_filing_date", F.date_format("last_filing_date", "yyyy-MM-dd"))
        .withColumn("approval_rate", F.round("approval_rate", 6))
    )


SPONSORS_SQL = f"""WITH {JOBS_SQL}, {INTEL_SQL}
    SELECT company, count(*) AS job_count, round(max(pct), 4) AS avg_approval_rate, TRUE AS h1b_sponsor
    FROM jobs JOIN (SELECT employer_clean, max(total_certified * 100.0::DOUBLE / total_filings) AS pct FROM intel
      GROUP BY 1) e ON upper(company_clean) = employer_clean
    WHERE h1b_sponsor AND company <> 'ICE' AND {NOISE_SQL}
    GROUP BY company HAVING max(pct) > 0
    ORDER BY job_count DESC, max(pct) DESC, company LIMIT 50"""


@query("top_sponsors", SPONSORS_SQL)
def top_sponsors(spark: SparkSession, d: str) -> DataFrame:
    return an.top_sponsors(jobs_processed(spark, d), approvals(spark, d))


@query(
    "top_companies",
    f"""WITH {JOBS_SQL}, {INTEL_SQL}
    SELECT company, count(*) AS job_count, bool_or(h1b_sponsor) AS h1b_sponsor,
      round(max(pct), 4) AS avg_approval_rate
    FROM jobs LEFT JOIN (SELECT employer_clean, max(total_certified * 100.0::DOUBLE / total_filings) AS pct FROM intel
      GROUP BY 1) e ON upper(company_clean) = employer_clean
    WHERE {NOISE_SQL} GROUP BY company ORDER BY job_count DESC, company LIMIT 20""",
)
def top_companies(spark: SparkSession, d: str) -> DataFrame:
    return an.top_companies(jobs_processed(spark, d), approvals(spark, d))


@query(
    "jobs_with_sponsor_view",
    f"""WITH {JOBS_SQL}, {INTEL_SQL}
    SELECT url, round(pct, 6) AS approval_pct FROM jobs
    LEFT JOIN (SELECT employer_clean, max(total_certified * 100.0::DOUBLE / total_filings) AS pct FROM intel
      GROUP BY 1) e ON upper(company_clean) = employer_clean""",
)
def jobs_with_sponsor_view(spark: SparkSession, d: str) -> DataFrame:
    return sp.join_sponsor_view(jobs_processed(spark, d), intel(spark, d)).select(
        "url", F.round("approval_pct", 6).alias("approval_pct")
    )


@query(
    "job_summary",
    f"""WITH {JOBS_SQL}
    SELECT count(*) AS total_jobs, count(DISTINCT company) AS total_companies,
      count(DISTINCT CASE WHEN h1b_sponsor THEN company END) AS h1b_sponsors, {cents_avg(PAY)} AS avg_salary,
      count(*) FILTER (days_since_posted <= 7) AS recent_7d FROM jobs""",
)
def job_summary(spark: SparkSession, d: str) -> DataFrame:
    return an.summary(jobs_processed(spark, d))


@query(
    "job_stats",
    f"""WITH {JOBS_SQL}
    SELECT count(*) AS total_jobs, count(DISTINCT company) AS unique_companies,
      count(DISTINCT CASE WHEN h1b_sponsor THEN company END) AS h1b_sponsors,
      count(*) FILTER (work_model = 'Remote') AS remote_jobs,
      count(*) FILTER (posted_date = DATE '{AS_OF}') AS new_today,
      count(*) FILTER (posted_date >= DATE '{AS_OF}' - 7) AS new_this_week, {cents_avg(PAY)} AS avg_salary FROM jobs""",
)
def job_stats(spark: SparkSession, d: str) -> DataFrame:
    return an.stats(jobs_processed(spark, d), AS_OF)


@query(
    "search_stats",
    f"""WITH {JOBS_SQL}, l AS (SELECT * FROM jobs
      QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY scraped_at DESC NULLS LAST, url) = 1)
    SELECT count(*) AS total_jobs, count(DISTINCT company_clean) AS total_companies,
      count(*) FILTER (visa_category = 'CPT') AS cpt_jobs, count(*) FILTER (visa_category = 'OPT') AS opt_jobs,
      count(*) FILTER (visa_category = 'H-1B') AS h1b_jobs, count(*) FILTER (h1b_sponsor) AS h1b_sponsors,
      count(*) FILTER (work_model = 'Remote') AS remote_jobs, count(*) FILTER (work_model = 'Hybrid') AS hybrid_jobs,
      count(*) FILTER (is_new_grad_role) AS new_grad_jobs,
      count(*) FILTER (h1b_sponsored_explicit) AS explicit_sponsors FROM l""",
)
def search_stats(spark: SparkSession, d: str) -> DataFrame:
    return an.search_stats(jobs_processed(spark, d), ["url"])


@query(
    "daily_trend",
    f"""SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS posting_date, count(*) AS job_count FROM events
    WHERE ts >= DATE '{EVENTS_AS_OF}' - INTERVAL 30 DAY GROUP BY CAST(ts AS DATE) ORDER BY 1 DESC LIMIT 100""",
)
def daily_trend(spark: SparkSession, d: str) -> DataFrame:
    return an.daily_trend(read(spark, d, "events"), "ts", EVENTS_AS_OF).withColumn(
        "posting_date", F.date_format("posting_date", "yyyy-MM-dd")
    )


@query(
    "visa_category_share",
    f"""WITH {JOBS_SQL}, t AS (SELECT count(*) AS n FROM jobs)
    SELECT coalesce(visa_category, 'Unknown') AS category, count(*) AS count,
      {half_up("count(*) * 100", "any_value(n)", 2)} AS percentage FROM jobs, t GROUP BY 1""",
)
def visa_category_share(spark: SparkSession, d: str) -> DataFrame:
    return an.share_of_total(jobs_processed(spark, d), "visa_category")


@query(
    "top_locations",
    f"""WITH {JOBS_SQL} SELECT location, count(*) AS job_count, {cents_avg(PAY)} AS avg_salary FROM jobs
    WHERE {PLACE_SQL} AND upper(location) NOT LIKE 'PACIFIC RIM%' AND upper(location) NOT LIKE 'INTELLIGENT TECHNICAL%'
    GROUP BY location ORDER BY job_count DESC, location LIMIT 15""",
)
def top_locations(spark: SparkSession, d: str) -> DataFrame:
    return an.top_locations(jobs_processed(spark, d))


@query(
    "work_model_mix",
    f"""WITH {JOBS_SQL}, t AS (SELECT count(*) AS n FROM jobs)
    SELECT CASE WHEN upper(location) LIKE '%REMOTE%' THEN 'Remote' WHEN upper(location) LIKE '%HYBRID%' THEN 'Hybrid'
        ELSE 'On-site' END AS work_model, count(*) AS count,
      {half_up("count(*) * 100", "any_value(n)", 1)} AS percentage, {cents_avg(PAY)} AS avg_salary
    FROM jobs, t GROUP BY 1""",
)
def work_model_mix(spark: SparkSession, d: str) -> DataFrame:
    return an.work_model_mix(jobs_processed(spark, d))


@query(
    "location_salary",
    f"""WITH {JOBS_SQL} SELECT location AS city, {cents_avg(PAY)} AS avg_salary, count(*) AS job_count,
      {half_up("count(*) FILTER (h1b_sponsor) * 100", "count(*)", 1)} AS h1b_friendly_pct
    FROM jobs WHERE {PLACE_SQL} GROUP BY location HAVING count(*) >= 5
    ORDER BY job_count DESC, avg_salary DESC NULLS LAST, city LIMIT 15""",
)
def location_salary(spark: SparkSession, d: str) -> DataFrame:
    return an.location_salary(jobs_processed(spark, d))


@query(
    "experience_mix",
    f"""WITH {JOBS_SQL}, t AS (SELECT count(*) AS n FROM jobs), l AS (
      SELECT CASE WHEN upper(title) LIKE '%INTERN%' OR upper(title) LIKE '%ENTRY%' THEN 'Entry Level'
        WHEN upper(title) LIKE '%JUNIOR%' OR upper(title) LIKE '%ASSOCIATE%' THEN 'Junior'
        WHEN upper(title) LIKE '%SENIOR%' OR upper(title) LIKE '%SR%' THEN 'Senior'
        WHEN upper(title) LIKE '%LEAD%' OR upper(title) LIKE '%PRINCIPAL%' OR upper(title) LIKE '%STAFF%'
          THEN 'Lead/Principal' ELSE 'Mid-Level' END AS level, count(*) AS job_count, {cents_avg(PAY)} AS avg_salary
      FROM jobs GROUP BY 1)
    SELECT level, job_count, avg_salary, {half_up("job_count * 100", "n", 1)} AS percentage,
      CASE level WHEN 'Entry Level' THEN 1 WHEN 'Junior' THEN 2 WHEN 'Mid-Level' THEN 3 WHEN 'Senior' THEN 4
        ELSE 5 END AS position FROM l, t""",
)
def experience_mix(spark: SparkSession, d: str) -> DataFrame:
    return an.experience_mix(jobs_processed(spark, d))


@query(
    "salary_by_role",
    f"""WITH {JOBS_SQL}, r AS (
      SELECT CASE WHEN upper(title) LIKE '%DATA SCIEN%' OR upper(title) LIKE '%ML%' OR upper(title) LIKE '%MACHINE LEARN%'
          THEN 'Data Scientist'
        WHEN upper(title) LIKE '%DATA ENG%' THEN 'Data Engineer'
        WHEN upper(title) LIKE '%DATA ANALY%' OR upper(title) LIKE '%BUSINESS ANALY%' THEN 'Data Analyst'
        WHEN upper(title) LIKE '%SOFTWARE ENG%' OR upper(title) LIKE '%DEVELOPER%' OR upper(title) LIKE '%PROGRAMMER%'
          THEN 'Software Engineer'
        WHEN upper(title) LIKE '%DEVOPS%' OR upper(title) LIKE '%SRE%' OR upper(title) LIKE '%SITE RELIABILITY%'
          THEN 'DevOps/SRE'
        WHEN upper(title) LIKE '%CLOUD%' THEN 'Cloud Engineer'
        WHEN upper(title) LIKE '%FULL STACK%' THEN 'Full Stack Developer'
        WHEN upper(title) LIKE '%FRONT%END%' OR upper(title) LIKE '%UI%' THEN 'Frontend Developer'
        WHEN upper(title) LIKE '%BACK%END%' THEN 'Backend Developer'
        WHEN upper(title) LIKE '%SECURITY%' OR upper(title) LIKE '%CYBER%' THEN 'Security Engineer'
        WHEN upper(title) LIKE '%QA%' OR upper(title) LIKE '%TEST%' THEN 'QA/Test Engineer'
        WHEN upper(title) LIKE '%PRODUCT MANAGER%' OR upper(title) LIKE '%PM%' THEN 'Product Manager'
        ELSE 'Other Tech Role' END AS role, salary_min FROM jobs)
    SELECT role, {cents_avg(PAY, 0)} AS avg_salary, count(*) AS job_count FROM r GROUP BY role
    HAVING count(*) >= 5 ORDER BY job_count DESC, avg_salary DESC NULLS LAST, role LIMIT 20""",
)
def salary_by_role(spark: SparkSession, d: str) -> DataFrame:
    return an.salary_by_role(jobs_processed(spark, d))


@query(
    "companies_dropdown",
    f"""WITH {JOBS_SQL}, p AS (SELECT company AS name, count(*) AS job_count FROM jobs WHERE company <> '' GROUP BY 1
      HAVING count(*) >= 5)
    SELECT name, job_count FROM p WHERE name NOT IN {sql_list(flt.COMPANY_STOP)} AND length(name) > 2
    ORDER BY job_count DESC, name LIMIT 100""",
)
def companies_dropdown(spark: SparkSession, d: str) -> DataFrame:
    return an.companies_dropdown(jobs_processed(spark, d))


@query(
    "locations_dropdown",
    f"""WITH {JOBS_SQL}, p AS (SELECT location AS name, count(*) AS job_count FROM jobs WHERE location <> '' GROUP BY 1
      HAVING count(*) >= 10)
    SELECT name, job_count FROM p WHERE name NOT IN {sql_list(flt.LOCATION_STOP)} AND length(name) > 2
    ORDER BY job_count DESC, name LIMIT 50""",
)
def locations_dropdown(spark: SparkSession, d: str) -> DataFrame:
    return an.locations_dropdown(jobs_processed(spark, d))


@query(
    "standardize_locations",
    f"""WITH {JOBS_SQL}
    SELECT CASE upper(trim(location)) WHEN 'SF' THEN 'San Francisco, CA' WHEN 'NYC' THEN 'New York, NY'
      ELSE location END AS name, count(*) AS job_count
    FROM jobs WHERE location <> '' AND location NOT IN {sql_list(flt.LOCATION_STOP)}
    GROUP BY 1 ORDER BY job_count DESC, name LIMIT 50""",
)
def standardize_locations(spark: SparkSession, d: str) -> DataFrame:
    return an.standardize_locations(jobs_processed(spark, d))


@query(
    "salary_stats",
    f"""WITH {FILINGS_SQL}
    SELECT job_title, worksite_city, worksite_state, count(*) AS sample_size, {cents_avg(WAGE, 0)} AS avg_salary,
      round(min({WAGE}), 0)::DOUBLE AS min_salary, round(max({WAGE}), 0)::DOUBLE AS max_salary,
      {cents_avg("prevailing_wage", 0)} AS prevailing_wage
    FROM filings WHERE lower(job_title) LIKE '%engineer%' AND case_status = 'Certified' AND wage_rate_of_pay_from > 0
    GROUP BY 1, 2, 3 HAVING count(*) >= 5
    ORDER BY sample_size DESC, job_title, worksite_city, worksite_state LIMIT 10""",
)
def salary_stats(spark: SparkSession, d: str) -> DataFrame:
    return sp.salary_stats(ad.filings(spark, d), "Engineer")


@query(
    "salary_stats_location_compat",
    f"""WITH {FILINGS_SQL}
    SELECT job_title, worksite_city, worksite_state, count(*) AS sample_size,
      {cents_avg("wage_rate_of_pay_from * CASE wage_unit_of_pay WHEN 'Hour' THEN 2080 ELSE 1 END", 0)} AS avg_salary,
      round(min(wage_rate_of_pay_from), 0)::DOUBLE AS min_salary,
      round(max(wage_rate_of_pay_from), 0)::DOUBLE AS max_salary,
      {cents_avg("prevailing_wage", 0)} AS prevailing_wage
    FROM filings WHERE lower(job_title) LIKE '%data%' AND (lower(worksite_city) LIKE '%asia%' OR
      lower(worksite_state) LIKE '%asia%') AND case_status = 'Certified' AND wage_rate_of_pay_from > 0
    GROUP BY 1, 2, 3 HAVING count(*) >= 5
    ORDER BY sample_size DESC, job_title, worksite_city, worksite_state LIMIT 10""",
)
def salary_stats_location_compat(spark: SparkSession, d: str) -> DataFrame:
    return sp.salary_stats(ad.filings(spark, d), "data", "Asia", compat=True)


@query(
    "negotiation_band",
    f"""WITH {FILINGS_SQL}, s AS (
      SELECT job_title, worksite_state, count(*) AS sample_size, {cents_avg(WAGE, 0)} AS avg_salary,
        {cents_avg("prevailing_wage", 0)} AS prevailing_wage
      FROM filings WHERE lower(job_title) LIKE '%a%' AND case_status = 'Certified' AND wage_rate_of_pay_from > 0
      GROUP BY job_title, worksite_city, worksite_state HAVING count(*) >= 5
      ORDER BY sample_size DESC, job_title, worksite_city, worksite_state LIMIT 10)
    SELECT job_title, worksite_state, CASE WHEN avg_salary < prevailing_wage THEN prevailing_wage END AS target,
      CASE WHEN avg_salary < prevailing_wage THEN CAST(prevailing_wage - avg_salary AS BIGINT) END AS gap,
      CASE WHEN avg_salary >= prevailing_wage THEN CAST(avg_salary AS BIGINT) * 9 // 10 END AS range_low,
      CASE WHEN avg_salary >= prevailing_wage THEN CAST(avg_salary AS BIGINT) * 11 // 10 END AS range_high FROM s""",
)
def negotiation_band(spark: SparkSession, d: str) -> DataFrame:
    bands = sp.negotiation_band(sp.salary_stats(ad.filings(spark, d), "a"))
    whole = [F.col(c).cast("long").alias(c) for c in ("gap", "range_low", "range_high")]
    return bands.select("job_title", "worksite_state", "target", *whole)


@query(
    "top_attorneys",
    f"""WITH {FILINGS_SQL}
    SELECT lawfirm_name_business_name, agent_attorney_first_name, agent_attorney_last_name,
      agent_attorney_email_address, agent_attorney_phone, worksite_city, worksite_state, count(*) AS total_cases,
      count(*) FILTER (case_status = 'Certified') AS certified_cases,
      {half_up("count(*) FILTER (case_status = 'Certified') * 100", "count(*)", 1)} AS approval_rate
    FROM filings WHERE (worksite_state = 'NATION_3' OR lower(worksite_city) LIKE '%america%')
      AND agent_attorney_email_address IS NOT NULL AND lawfirm_name_business_name IS NOT NULL
    GROUP BY 1, 2, 3, 4, 5, 6, 7 HAVING count(*) >= 10
    ORDER BY total_cases DESC, approval_rate DESC, 1, 2, 3, 4, 5, 6, 7 LIMIT 10""",
)
def top_attorneys(spark: SparkSession, d: str) -> DataFrame:
    return sp.top_attorneys(ad.filings(spark, d), "NATION_3", "America")


@query(
    "filing_summary",
    f"""WITH {FILINGS_SQL}
    SELECT employer_name, count(*) AS total_filings, count(*) FILTER (case_status = 'Certified') AS certified,
      count(*) FILTER (case_status = 'Denied') AS denied,
      {half_up("count(*) FILTER (case_status = 'Certified') * 100", "count(*)", 1)} AS approval_rate
    FROM filings WHERE lower(employer_name) LIKE '%customer#0000001%' GROUP BY employer_name""",
)
def filing_summary(spark: SparkSession, d: str) -> DataFrame:
    return sp.filing_summary(ad.filings(spark, d), "Customer#0000001")


REAL_RATE = half_up("total_certified * 100", "total_filings", 2)


@query(
    "sponsor_profile",
    f"""WITH {INTEL_SQL}
    SELECT employer_original, sponsorship_score, total_filings, {REAL_RATE} AS real_approval_rate,
      CASE WHEN sponsorship_score >= 90 THEN 'Excellent' WHEN sponsorship_score >= 70 THEN 'Good'
        WHEN sponsorship_score >= 50 THEN 'Fair' ELSE 'Risky' END AS badge,
      CASE WHEN sponsorship_score >= 80 THEN 'Highly recommended' WHEN sponsorship_score >= 60 THEN 'Good option'
        WHEN sponsorship_score >= 40 THEN 'Proceed with caution' ELSE 'Not recommended' END AS advice
    FROM intel WHERE employer_clean LIKE '%CUSTOMER%' OR upper(employer_original) LIKE '%CUSTOMER%'
    ORDER BY sponsorship_score DESC, employer_original LIMIT 5""",
)
def sponsor_profile(spark: SparkSession, d: str) -> DataFrame:
    return sp.sponsor_profile(intel(spark, d), "customer").select(
        "employer_original", "sponsorship_score", "total_filings", "real_approval_rate", "badge", "advice"
    )


@query(
    "compare_companies",
    f"""WITH {INTEL_SQL}, r AS (
      SELECT employer_original, sponsorship_score, {REAL_RATE} AS rate,
        row_number() OVER (ORDER BY sponsorship_score DESC, employer_original) AS rn, count(*) OVER () AS n,
        lead(sponsorship_score) OVER (ORDER BY sponsorship_score DESC, employer_original) AS next_score
      FROM intel WHERE employer_clean LIKE '%#00000004%' OR employer_clean LIKE '%#00000007%'
        OR employer_clean LIKE '%#00000001%'),
    r2 AS (SELECT *, lead(rate) OVER (ORDER BY rn) AS next_rate FROM r)
    SELECT employer_original, sponsorship_score, rate AS real_approval_rate, rn = 1 AND n > 1 AS is_winner,
      CASE WHEN rn = 1 THEN round(sponsorship_score - next_score, 1) END AS score_lead,
      CASE WHEN rn = 1 THEN round(rate - next_rate, 2) END AS approval_lead FROM r2""",
)
def compare_companies(spark: SparkSession, d: str) -> DataFrame:
    return sp.compare_companies(intel(spark, d), ["#00000004", "#00000007", "#00000001"]).select(
        "employer_original", "sponsorship_score", "real_approval_rate", "is_winner", "score_lead", "approval_lead"
    )


@query(
    "classification_stats",
    f"""WITH {JOBS_SQL}
    SELECT visa_category, count(*) AS count,
      {half_up("sum(_part % 100)", "count(*) * 100", 3)} AS avg_confidence,
      round(min(classification_confidence), 3) AS min_confidence,
      round(max(classification_confidence), 3) AS max_confidence,
      count(*) FILTER (classification_confidence < 0.5) AS needs_review
    FROM jobs WHERE visa_category IS NOT NULL GROUP BY visa_category""",
)
def classification_stats(spark: SparkSession, d: str) -> DataFrame:
    return an.classification_stats(jobs_processed(spark, d))


_VISA_SQL = """CASE WHEN us >= 1 THEN 'US-Only' WHEN cpt >= 1 THEN 'CPT' WHEN h1b >= 1 THEN 'H-1B' WHEN opt >= 1 THEN 'OPT'
  ELSE 'Unknown' END"""
_CONF_SQL = """CASE WHEN us >= 1 THEN 0.85 WHEN cpt >= 2 THEN 0.80 WHEN cpt >= 1 THEN 0.70 WHEN h1b >= 2 THEN 0.75
  WHEN h1b >= 1 THEN 0.65 WHEN opt >= 2 THEN 0.75 WHEN opt >= 1 THEN 0.65 ELSE 0.0 END::DOUBLE"""


def word_count_sql(words: list[str], text: str) -> str:
    return " + ".join(f"regexp_matches({text}, '\\b{w}\\b')::INT" for w in words)


from jobweave.functions.rules import VISA_KEYWORDS  # noqa: E402

VISA_COUNTS_SQL = ", ".join(
    f"{word_count_sql(VISA_KEYWORDS[label], 'txt')} AS {name}"
    for label, name in (("US-Only", "us"), ("CPT", "cpt"), ("H-1B", "h1b"), ("OPT", "opt"))
)


@query(
    "classification_run_metrics",
    f"""WITH {JOBS_SQL}, {CACHE_SQL}, c AS (
      SELECT j.*, c.cached_at, c.cached_category, c.cached_confidence, lower(concat_ws(' ', title, description)) AS txt
      FROM jobs j LEFT JOIN cache c ON j.url = c.url AND c.cached_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY),
    k AS (SELECT *, {VISA_COUNTS_SQL} FROM c),
    r AS (SELECT CASE WHEN cached_at IS NOT NULL THEN 'cache' WHEN h1b_sponsored = 'Yes' OR is_new_grad = 'Yes'
          THEN 'explicit' ELSE 'keywords' END AS method,
        CASE WHEN cached_at IS NOT NULL THEN cached_category ELSE 'x' END AS cat,
        CASE WHEN cached_at IS NOT NULL THEN cached_confidence WHEN h1b_sponsored = 'Yes' THEN 0.95
          WHEN is_new_grad = 'Yes' THEN 0.85 ELSE {_CONF_SQL} END AS confidence FROM k)
    SELECT count(*) AS total_jobs, count(cat) AS classified, count(*) FILTER (confidence < 0.5) AS needs_review,
      count(*) FILTER (cat IS NULL) AS errors, count(*) FILTER (method = 'explicit') AS explicit_hits,
      count(*) FILTER (method = 'cache') AS cache_hits, count(*) FILTER (method = 'keywords') AS scorer_calls,
      {half_up("count(*) FILTER (method = 'cache')", "count(*)", 4)} AS cache_hit_rate,
      {half_up("count(*) FILTER (method = 'explicit')", "count(*)", 4)} AS explicit_hit_rate,
      {half_up("count(*) FILTER (method <> 'keywords')", "count(*)", 4)} AS cost_savings FROM r""",
)
def classification_run_metrics(spark: SparkSession, d: str) -> DataFrame:
    results = inc.classify_with_cache(
        ad.jobs_raw(spark, d), classification_cache(spark, d), AS_OF,
        h1b_flag=F.col("h1b_sponsored"), new_grad_flag=F.col("is_new_grad"),
    )
    return an.classification_run_metrics(results)


@query(
    "status_distribution",
    f"""WITH {FILINGS_SQL} SELECT case_status, count(*) AS count, count(employer_poc_email) AS has_poc_email,
      count(agent_attorney_email_address) AS has_attorney_email FROM filings GROUP BY case_status""",
)
def status_distribution(spark: SparkSession, d: str) -> DataFrame:
    return an.status_distribution(ad.filings(spark, d))


@query(
    "scrape_run_metadata",
    f"""WITH {JOBS_SQL}, runs AS (SELECT DISTINCT source FROM jobs),
      cats AS (SELECT unnest(['Remote', 'Hybrid', 'On-site', 'Field']) AS category),
      c AS (SELECT r.source, category, count(url) AS n FROM runs r CROSS JOIN cats
        LEFT JOIN jobs j ON j.source = r.source AND work_model = category GROUP BY 1, 2),
      a AS (SELECT source, count(*) AS every FROM jobs GROUP BY 1)
    SELECT source AS run, any_value(every)::BIGINT AS total_jobs, count(*) AS total_categories,
      count(*) FILTER (n > 0) AS categories_with_jobs,
      {half_up("count(*) FILTER (n > 0) * 100", "count(*)", 1)} AS coverage_pct,
      {half_up("any_value(every)", "greatest(count(*) FILTER (n > 0), 1)", 1)} AS avg_jobs_per_category,
      string_agg(category || '=' || n, ',' ORDER BY category) AS breakdown FROM c JOIN a USING (source) GROUP BY source""",
)
def scrape_run_metadata(spark: SparkSession, d: str) -> DataFrame:
    meta = an.scrape_run_metadata(
        jobs_processed(spark, d), "source", "work_model", ["Remote", "Hybrid", "On-site", "Field"]
    )
    line = F.transform("category_breakdown", lambda x: F.concat(x["category"], F.lit("="), x["job_count"]))
    return meta.withColumn("breakdown", F.array_join(line, ",")).drop("category_breakdown")


@query(
    "query_log_metrics",
    f"""SELECT event_type AS intent, count(*) AS queries, {cents_avg("CAST(value AS DECIMAL(18,2))")} AS avg_query_time,
      {half_up("count(*) FILTER (event_id % 3 = 0) * 100", "count(*)", 1)} AS cache_hit_pct,
      count(*) FILTER (event_id % 7 = 0) AS fallback_count, count(*) FILTER (event_id % 4 = 1) AS follow_ups,
      count(*) FILTER (event_id % 4 = 1 AND value > 10) AS follow_up_success FROM events GROUP BY event_type""",
)
def query_log_metrics(spark: SparkSession, d: str) -> DataFrame:
    event = F.col("event_id")
    log = read(spark, d, "events").select(
        F.col("event_type").alias("intent"), F.col("value").alias("duration"), (event % 3 == 0).alias("used_cache"),
        (event % 7 == 0).alias("fallback"), (event % 4 == 1).alias("follow_up"), (F.col("value") > 10).alias("success"),
    )
    return an.query_log_metrics(log)


@query(
    "semantic_measures",
    f"""WITH {JOBS_SQL} SELECT job_type, count(*) AS total_jobs,
      {cents_avg("CAST((salary_min + salary_max) / 2 AS DECIMAL(18,2))")} AS avg_salary FROM jobs
    WHERE visa_category = 'CPT' AND h1b_sponsor GROUP BY job_type""",
)
def semantic_measures(spark: SparkSession, d: str) -> DataFrame:
    return an.measure(
        jobs_processed(spark, d), ["job_type"], ["total_jobs", "avg_salary"], ["cpt_eligible", "h1b_sponsors"]
    )
