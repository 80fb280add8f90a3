"""Views of the star-schema test tables in the shape of postings and filings.

Each adapter is a projection that Catalyst prunes to the columns a query uses;
the SQL text beside it states the same mapping for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.session import spread

AS_OF = "2001-06-01"
EVENTS_AS_OF = "2024-01-30"

TITLES = [
    "Software Engineer", "Senior Software Engineer", "Data Scientist", "Senior Data Engineer",
    "Data Analyst Intern", "Machine Learning Engineer", "Junior Developer", "DevOps Engineer",
    "Site Reliability Engineer Lead", "Cloud Architect", "Full Stack Engineer", "Front-End Engineer",
    "Back End Engineer", "Security Analyst", "QA Tester", "Product Manager", "Principal Engineer",
    "Staff Accountant", "Sr Business Analyst", "Engineering Manager", "Entry Level Programmer",
    "Director of Sales", "Recruiter", "Marketing Associate",
]
LOCATIONS = [
    "Boston, MA", "New York, NY", "San Francisco, CA", "Seattle, WA", "Austin, TX", "Remote", "Hybrid",
    "Remote - USA", "Hybrid - Chicago, IL", "USA", "BR | Remote", "Toronto, Canada", "Bangalore, India",
    "Milwaukee, WI", "Denver, CO", "Atlanta, GA", "", None, "SF", "NYC",
]
DESCRIPTIONS = [
    "Build services in Python and SQL on AWS. H-1B visa sponsorship available.",
    "US citizen only. Active clearance required. C++ and Linux.",
    "Summer internship for student applicants. CPT accepted. Java or JavaScript.",
    "Entry level role for new grad or recent graduate. React, Node and TypeScript.",
    "Work from home. Spark, Kafka and Airflow pipelines. We sponsor.",
    "Hospital operations role with optional weekend shifts.",
    "Machine learning and deep learning with PyTorch and TensorFlow. NLP and computer vision.",
    "OPT candidates welcome. Tableau, Excel and R.",
    "Docker, Kubernetes and Terraform. Remote friendly.",
    "Sales of enterprise software. Agile and Scrum.",
    None,
    "",
]
QUALIFICATIONS = [
    "Airflow, Python and SQL; 2+ years experience with pipelines", "Java, Spring and Docker", "Spark, Scala, Kafka", None,
    "Excel and Tableau", "",
]
WORK_MODELS = ["Remote", "Hybrid", "On-site", None]
VISA_CATEGORIES = ["CPT", "OPT", "H-1B", "US-Only", None]
WAGE_UNITS = {"1-URGENT": "Hour", "2-HIGH": "Week", "3-MEDIUM": "Bi-Weekly", "4-NOT SPECIFIED": "Month"}
STATUSES = {"F": "Certified", "O": "Denied", "P": "Withdrawn"}
KEYS = {
    "lineitem": ["l_orderkey", "l_linenumber"], "orders": ["o_orderkey"], "documents": ["doc_id"], "pages": ["page_id"],
    "conversations": ["conv_id", "turn"], "customer": ["c_custkey"],
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_spread(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table whose rows take much work each."""
    return spread(read(spark, sf_dir, table), *KEYS[table])


def pick(values: list[str | None], index: Column) -> Column:
    """The list entry at ``index`` modulo the length of the list."""
    slots = F.expr(f"array({', '.join(map(sql_text, values))})")
    return F.element_at(slots, (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def sql_text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def sql_pick(values: list[str | None], index: str) -> str:
    return f"[{', '.join(map(sql_text, values))}][CAST(({index}) % {len(values)} AS INT) + 1]"


def sql_list(values: list[str]) -> str:
    return "(" + ", ".join(map(sql_text, values)) + ")"


def numbered(name: str, number: Column) -> Column:
    """The name and the number, of nine digits or more; most numbers need no formatter, which is slow."""
    plain = F.concat(F.lit(name), F.lpad(number.cast("string"), 9, "0"))
    return F.when((number >= 0) & (number < 10**9), plain).otherwise(F.format_string(f"{name}%09d", number))


def jobs_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scraped postings: one row per line item."""
    return as_jobs(read_spread(spark, sf_dir, "lineitem"))


def as_jobs(t: DataFrame, *kept: str) -> DataFrame:
    """Line items, which may be joined with other tables, as postings, with the other columns that are to be kept."""
    supp, line = F.col("l_suppkey"), F.col("l_linenumber")
    name = numbered("Customer#", supp)
    company = (
        F.when(supp % 20 == 7, "USA")
        .when(supp % 20 == 11, "CA")
        .when(supp % 20 == 13, "International Group")
        .when(supp % 5 == 1, F.concat(F.lit("  "), F.lower(name), F.lit(" ")))
        .when(supp % 5 == 2, F.concat(name, F.lit(" Inc")))
        .when(supp % 5 == 3, F.substring(name, 1, 17))
        .when(supp % 5 == 4, numbered("Supplier#", supp))
        .otherwise(name)
    )
    pay = F.col("l_extendedprice").cast("decimal(12,2)")
    salary_min = F.when(line == 7, F.lit(None)).when(line == 6, F.lit(0)).otherwise(pay).cast("decimal(12,2)")
    salary_max = F.when(line != 5, (salary_min + F.col("l_quantity").cast("decimal(12,2)") * 1000)).cast(
        "decimal(12,2)"
    )
    return t.select(
        F.col("l_orderkey").cast("string").alias("job_id"),
        F.concat(F.lit("feed_"), "l_returnflag").alias("source"),
        F.concat_ws(
            "/", F.lit("https://jobs.example.com"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            (pay * 100).cast("long"),
        ).alias("url"),
        pick(TITLES, F.col("l_partkey")).alias("title"),
        company.alias("company"),
        pick(LOCATIONS, supp).alias("location"),
        pick(DESCRIPTIONS, F.col("l_orderkey")).alias("description"),
        F.concat(F.lit("Lot "), "l_linestatus").alias("snippet"),
        salary_min.alias("salary_min"),
        salary_max.alias("salary_max"),
        F.when(F.col("l_linestatus") == "O", "Full-Time").otherwise("Internship").alias("job_type"),
        F.when((line != 7) | (F.col("l_quantity") >= 10), F.to_date("l_shipdate")).alias("posted_date"),
        pick(WORK_MODELS, supp).alias("work_model"),
        pick(QUALIFICATIONS, F.col("l_orderkey")).alias("qualifications"),
        F.when(line == 1, "Yes").when(line == 2, "No").otherwise("Unknown").alias("h1b_sponsored"),
        F.when(line == 4, "Yes").otherwise("No").alias("is_new_grad"),
        F.col("l_shipdate").alias("scraped_at"),
        F.col("l_partkey").alias("_part"),
        F.col("l_linenumber").alias("_line"),
        *kept,
    )


_COMPANY_SQL = """CASE WHEN l_suppkey % 20 = 7 THEN 'USA' WHEN l_suppkey % 20 = 11 THEN 'CA'
      WHEN l_suppkey % 20 = 13 THEN 'International Group'
      WHEN l_suppkey % 5 = 1 THEN '  customer#' || lpad(l_suppkey::VARCHAR, 9, '0') || ' '
      WHEN l_suppkey % 5 = 2 THEN 'Customer#' || lpad(l_suppkey::VARCHAR, 9, '0') || ' Inc'
      WHEN l_suppkey % 5 = 3 THEN substr('Customer#' || lpad(l_suppkey::VARCHAR, 9, '0'), 1, 17)
      WHEN l_suppkey % 5 = 4 THEN 'Supplier#' || lpad(l_suppkey::VARCHAR, 9, '0')
      ELSE 'Customer#' || lpad(l_suppkey::VARCHAR, 9, '0') END"""

_SALARY_MIN_SQL = """CAST(CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN 0
      ELSE CAST(l_extendedprice AS DECIMAL(12,2)) END AS DECIMAL(12,2))"""

JOBS_RAW_SQL = f"""jobs_raw AS (
  SELECT l_orderkey::VARCHAR AS job_id, 'feed_' || l_returnflag AS source,
    'https://jobs.example.com/' || l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey
      || '/' || CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 100 AS BIGINT) AS url,
    {sql_pick(TITLES, "l_partkey")} AS title,
    {_COMPANY_SQL} AS company,
    {sql_pick(LOCATIONS, "l_suppkey")} AS location,
    {sql_pick(DESCRIPTIONS, "l_orderkey")} AS description,
    'Lot ' || l_linestatus AS snippet,
    {_SALARY_MIN_SQL} AS salary_min,
    CASE WHEN l_linenumber <> 5
      THEN CAST({_SALARY_MIN_SQL} + CAST(l_quantity AS DECIMAL(12,2)) * 1000 AS DECIMAL(12,2)) END AS salary_max,
    CASE WHEN l_linestatus = 'O' THEN 'Full-Time' ELSE 'Internship' END AS job_type,
    CASE WHEN l_linenumber <> 7 OR l_quantity >= 10 THEN CAST(l_shipdate AS DATE) END AS posted_date,
    {sql_pick(WORK_MODELS, "l_suppkey")} AS work_model,
    {sql_pick(QUALIFICATIONS, "l_orderkey")} AS qualifications,
    CASE l_linenumber WHEN 1 THEN 'Yes' WHEN 2 THEN 'No' ELSE 'Unknown' END AS h1b_sponsored,
    CASE WHEN l_linenumber = 4 THEN 'Yes' ELSE 'No' END AS is_new_grad,
    l_shipdate AS scraped_at, l_partkey AS _part, l_linenumber AS _line
  FROM lineitem)"""


def jobs_processed(spark: SparkSession, sf_dir: str, as_of: str = AS_OF) -> DataFrame:
    """Serving-table rows: a posting with sponsor and visa columns filled in."""
    return as_processed(jobs_raw(spark, sf_dir), as_of)


def as_processed(jobs: DataFrame, as_of: str = AS_OF) -> DataFrame:
    part, line = F.col("_part"), F.col("_line")
    sponsor = F.when(line == 6, F.lit(None)).otherwise(line % 3 != 0).cast("boolean")
    return jobs.select(
        "*",
        F.upper(F.trim("company")).alias("company_clean"),
        sponsor.alias("h1b_sponsor"),
        F.when(sponsor, (part % 101) / F.lit(100.0)).alias("h1b_approval_rate"),
        F.when(sponsor, part % 250).alias("h1b_total_petitions"),
        pick(VISA_CATEGORIES, part).alias("visa_category"),
        ((part % 100) / F.lit(100.0)).alias("classification_confidence"),
        F.datediff(F.lit(as_of).cast("date"), "posted_date").alias("days_since_posted"),
        (line == 1).alias("h1b_sponsored_explicit"),
        (line == 4).alias("is_new_grad_role"),
        F.when(part % 2 == 0, "Engineering").alias("job_category"),
        F.when(part % 3 == 0, "11-50").otherwise("1000+").alias("company_size"),
    )


JOBS_SQL = f"""{JOBS_RAW_SQL},
jobs AS (
  SELECT *, upper(trim(company)) AS company_clean,
    CASE WHEN _line = 6 THEN NULL ELSE _line % 3 <> 0 END AS h1b_sponsor,
    CASE WHEN _line <> 6 AND _line % 3 <> 0 THEN (_part % 101) / 100.0::DOUBLE END AS h1b_approval_rate,
    CASE WHEN _line <> 6 AND _line % 3 <> 0 THEN _part % 250 END AS h1b_total_petitions,
    {sql_pick(VISA_CATEGORIES, "_part")} AS visa_category,
    (_part % 100) / 100.0::DOUBLE AS classification_confidence,
    date_diff('day', posted_date, DATE '{AS_OF}') AS days_since_posted,
    _line = 1 AS h1b_sponsored_explicit, _line = 4 AS is_new_grad_role,
    CASE WHEN _part % 2 = 0 THEN 'Engineering' END AS job_category,
    CASE WHEN _part % 3 = 0 THEN '11-50' ELSE '1000+' END AS company_size
  FROM jobs_raw)"""


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visa filings: one row per order."""
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    status = F.create_map(*[F.lit(x) for pair in STATUSES.items() for x in pair])
    unit = F.create_map(*[F.lit(x) for pair in WAGE_UNITS.items() for x in pair])
    lawyer = F.col("o_custkey") % 20
    # nation and region have 25 and 5 rows at every scale
    places = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(F.broadcast(places), F.pmod(F.col("c_nationkey") + F.col("o_orderkey"), F.lit(25)) == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").cast("string").alias("case_number"),
            status[F.col("o_orderstatus")].alias("case_status"),
            F.col("c_name").alias("employer_name"),
            pick(TITLES, F.col("o_orderkey")).alias("job_title"),
            F.col("r_name").alias("worksite_city"),
            F.col("n_name").alias("worksite_state"),
            F.col("o_totalprice").cast("decimal(12,2)").alias("wage_rate_of_pay_from"),
            F.coalesce(unit[F.col("o_orderpriority")], F.lit("Year")).alias("wage_unit_of_pay"),
            (F.col("c_acctbal").cast("decimal(12,2)") + 200000).cast("decimal(12,2)").alias("prevailing_wage"),
            F.when(F.col("c_acctbal") < 0, "Y").otherwise("N").alias("willful_violator"),
            F.col("o_orderdate").alias("received_date"),
            F.col("o_orderdate").alias("loaded_at"),
            F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("hr"), "c_custkey", F.lit("@example.com"))).alias(
                "employer_poc_email"
            ),
            F.concat(F.lit("617555"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")).alias(
                "employer_poc_phone"
            ),
            F.concat(F.lit("Ann"), lawyer).alias("agent_attorney_first_name"),
            F.concat(F.lit("Lee"), lawyer).alias("agent_attorney_last_name"),
            F.when(lawyer != 0, F.concat(F.lit("ann"), lawyer, F.lit("@law.example.com"))).alias(
                "agent_attorney_email_address"
            ),
            F.concat(F.lit("1-212-555-"), F.lpad(lawyer.cast("string"), 4, "0")).alias("agent_attorney_phone"),
            F.concat(F.lit("Firm "), lawyer % 5).alias("lawfirm_name_business_name"),
        )
    )


FILINGS_SQL = f"""filings AS (
  SELECT o_orderkey::VARCHAR AS case_number,
    CASE o_orderstatus WHEN 'F' THEN 'Certified' WHEN 'O' THEN 'Denied' WHEN 'P' THEN 'Withdrawn' END AS case_status,
    c_name AS employer_name, {sql_pick(TITLES, "o_orderkey")} AS job_title,
    r_name AS worksite_city, n_name AS worksite_state,
    CAST(o_totalprice AS DECIMAL(12,2)) AS wage_rate_of_pay_from,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Hour' WHEN '2-HIGH' THEN 'Week' WHEN '3-MEDIUM' THEN 'Bi-Weekly'
      WHEN '4-NOT SPECIFIED' THEN 'Month' ELSE 'Year' END AS wage_unit_of_pay,
    CAST(CAST(c_acctbal AS DECIMAL(12,2)) + 200000 AS DECIMAL(12,2)) AS prevailing_wage,
    CASE WHEN c_acctbal < 0 THEN 'Y' ELSE 'N' END AS willful_violator,
    o_orderdate AS received_date, o_orderdate AS loaded_at,
    CASE WHEN c_custkey % 4 <> 0 THEN 'hr' || c_custkey || '@example.com' END AS employer_poc_email,
    '617555' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS employer_poc_phone,
    'Ann' || (o_custkey % 20) AS agent_attorney_first_name, 'Lee' || (o_custkey % 20) AS agent_attorney_last_name,
    CASE WHEN o_custkey % 20 <> 0 THEN 'ann' || (o_custkey % 20) || '@law.example.com' END
      AS agent_attorney_email_address,
    '1-212-555-' || lpad((o_custkey % 20)::VARCHAR, 4, '0') AS agent_attorney_phone,
    'Firm ' || (o_custkey % 20 % 5) AS lawfirm_name_business_name
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON (c_nationkey + o_orderkey) % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
