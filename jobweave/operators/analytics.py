"""AGG4-AGG28: market statistics over postings, skills and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.functions import numbers as nm
from jobweave.functions import rules
from jobweave.functions import text as tx
from jobweave.operators import filters as flt
from jobweave.operators.sponsors import approval_per_clean_name
from jobweave.operators.staging import latest_per_key

# Display order of experience levels and cities by short name.
EXPERIENCE_ORDER = ["Entry Level", "Junior", "Mid-Level", "Senior", "Lead/Principal"]
LOCATION_ALIASES = {"SF": "San Francisco, CA", "NYC": "New York, NY"}


def _rows() -> Column:
    return F.count(F.lit(1))


def avg_salary(digits: int = 2) -> Column:
    return nm.exact_avg(nm.positive(F.col("salary_min")), digits)


def _totals(jobs: DataFrame, company: str, counts: dict[str, Column], companies: str) -> DataFrame:
    """Totals with two distinct company counts, from one row per company.

    Two distinct counts in one aggregate would copy every row for each of them.
    Grouping by company first combines on the map side and shuffles one row per
    company and task.
    """
    pay = nm.positive(F.col("salary_min")).cast("decimal(18,2)")
    per_company = jobs.groupBy(company).agg(
        *[F.count_if(c).alias(n) for n, c in counts.items()],
        _rows().alias("total_jobs"),
        F.bool_or(F.coalesce(F.col("h1b_sponsor"), F.lit(False))).alias("_sponsor"),
        F.count_if("h1b_sponsor").alias("_sponsored"),
        F.sum(pay).alias("_pay"),
        F.count(pay).alias("_paid"),
    )
    return per_company.agg(
        F.sum("total_jobs").alias("total_jobs"),
        F.count(company).alias(companies),
        F.count_if(F.col("_sponsor") & F.col(company).isNotNull()).alias("sponsor_companies"),
        F.sum("_sponsored").alias("sponsored_jobs"),
        F.round(F.sum("_pay") / F.nullif(F.sum("_paid").cast("decimal(18,0)"), F.lit(0)), 2).cast("double").alias("avg_salary"),
        *[F.sum(n).alias(n) for n in counts],
    )


def summary(jobs: DataFrame) -> DataFrame:
    """AGG4"""
    totals = _totals(jobs, "company", {"recent_7d": F.col("days_since_posted") <= 7}, "total_companies")
    return totals.select(
        "total_jobs", "total_companies", F.col("sponsor_companies").alias("h1b_sponsors"), "avg_salary", "recent_7d"
    )


def stats(jobs: DataFrame, as_of: str) -> DataFrame:
    """AGG5"""
    today = F.lit(as_of).cast("date")
    counts = {
        "remote_jobs": F.col("work_model") == "Remote",
        "new_today": F.col("posted_date") == today,
        "new_this_week": F.col("posted_date") >= F.date_sub(today, 7),
    }
    return _totals(jobs, "company", counts, "unique_companies").select(
        "total_jobs", "unique_companies", F.col("sponsor_companies").alias("h1b_sponsors"), *counts, "avg_salary"
    )


def search_stats(jobs: DataFrame, tie_break: list[str]) -> DataFrame:
    """AGG6"""
    latest = latest_per_key(jobs, ["job_id"], ["scraped_at"], tie_break)
    visa, model = F.col("visa_category"), F.col("work_model")
    counts = {
        "cpt_jobs": visa == "CPT",
        "opt_jobs": visa == "OPT",
        "h1b_jobs": visa == "H-1B",
        "remote_jobs": model == "Remote",
        "hybrid_jobs": model == "Hybrid",
        "new_grad_jobs": F.col("is_new_grad_role"),
        "explicit_sponsors": F.col("h1b_sponsored_explicit"),
    }
    return _totals(latest, "company_clean", counts, "total_companies").select(
        "total_jobs", "total_companies", F.col("sponsored_jobs").alias("h1b_sponsors"), *counts
    )


def daily_trend(df: DataFrame, ts: str, as_of: str, days: int = 30, n: int = 100) -> DataFrame:
    """AGG7"""
    return (
        df.filter(F.col(ts) >= F.date_sub(F.lit(as_of).cast("date"), days))
        .groupBy(F.to_date(ts).alias("posting_date"))
        .agg(_rows().alias("job_count"))
        .orderBy(F.col("posting_date").desc_nulls_last())
        .limit(n)
    )


def _with_share(counts: DataFrame, digits: int) -> DataFrame:
    """Adds each group's percentage of the total, taken from the grouped counts."""
    total = counts.agg(F.sum("count").alias("total")).scalar()
    return counts.withColumn("percentage", nm.percent(F.col("count"), total, digits))


def share_of_total(df: DataFrame, key: str | Column, name: str = "category", digits: int = 2) -> DataFrame:
    """AGG8"""
    col = F.col(key) if isinstance(key, str) else key
    return _with_share(df.groupBy(F.coalesce(col, F.lit("Unknown")).alias(name)).agg(_rows().alias("count")), digits)


def top_companies(jobs: DataFrame, employers: DataFrame, n: int = 20) -> DataFrame:
    """AGG9: postings are counted per company before the sponsor view is joined.

    ``employers`` has the columns of ``employer_approvals``; employer intelligence does as well.
    """
    counts = (
        jobs.filter(flt.company_noise())
        .groupBy("company", "company_clean")
        .agg(_rows().alias("_jobs"), F.max("h1b_sponsor").alias("_sponsor"))
    )
    view = approval_per_clean_name(employers)
    return (
        counts.join(view, F.upper("company_clean") == view["employer_clean"], "left")
        .groupBy("company")
        .agg(
            F.sum("_jobs").alias("job_count"),
            F.max("_sponsor").alias("h1b_sponsor"),
            F.round(F.max("approval_pct"), 4).alias("avg_approval_rate"),
        )
        .orderBy(F.col("job_count").desc(), "company")
        .limit(n)
    )


def top_locations(jobs: DataFrame, n: int = 15) -> DataFrame:
    """AGG10"""
    return (
        jobs.filter(flt.location_noise())
        .groupBy("location")
        .agg(_rows().alias("job_count"), avg_salary().alias("avg_salary"))
        .orderBy(F.col("job_count").desc(), "location")
        .limit(n)
    )


def top_sponsors(jobs: DataFrame, employers: DataFrame, n: int = 50) -> DataFrame:
    """AGG11: sponsoring companies with a positive approval rate.

    Both sides are aggregated to company level before they meet, so the join
    moves one row per company whatever the number of postings or filings.
    ``employers`` has the columns of ``employer_approvals``; employer intelligence does as well.
    """
    counts = (
        jobs.filter(F.col("h1b_sponsor") & flt.company_noise(noise=flt.SPONSOR_NOISE))
        .groupBy("company", F.upper("company_clean").alias("employer_clean"))
        .agg(_rows().alias("_jobs"))
    )
    return (
        counts.join(approval_per_clean_name(employers).filter(F.col("approval_pct") > 0), "employer_clean")
        .groupBy("company")
        .agg(F.sum("_jobs").alias("job_count"), F.round(F.max("approval_pct"), 4).alias("avg_approval_rate"))
        .withColumn("h1b_sponsor", F.lit(True))
        .orderBy(F.col("job_count").desc(), F.col("avg_approval_rate").desc_nulls_last(), "company")
        .limit(n)
    )


def work_model_mix(jobs: DataFrame) -> DataFrame:
    """AGG12"""
    counts = jobs.groupBy(rules.work_model(F.col("location")).alias("work_model")).agg(
        _rows().alias("count"), avg_salary().alias("avg_salary")
    )
    return _with_share(counts, 1)


def location_salary(jobs: DataFrame, n: int = 15, min_jobs: int = 5) -> DataFrame:
    """AGG13"""
    return (
        jobs.filter(flt.location_noise(prefixes=[]))
        .groupBy(F.col("location").alias("city"))
        .agg(
            avg_salary().alias("avg_salary"),
            _rows().alias("job_count"),
            nm.percent(F.count_if("h1b_sponsor"), _rows(), 1).alias("h1b_friendly_pct"),
        )
        .filter(F.col("job_count") >= min_jobs)
        .orderBy(F.col("job_count").desc(), F.col("avg_salary").desc_nulls_last(), "city")
        .limit(n)
    )


def custom_order(col: Column, values: list[str]) -> Column:
    """SRT4: place of a value in a fixed list; unlisted values come last."""
    place = F.array_position(F.array(*map(F.lit, values)), col)
    return F.when(place > 0, place).otherwise(len(values) + 1)


def experience_mix(jobs: DataFrame) -> DataFrame:
    """AGG14"""
    counts = jobs.groupBy(rules.experience(F.col("title")).alias("level")).agg(
        _rows().alias("count"), avg_salary().alias("avg_salary")
    )
    return (
        _with_share(counts, 1)
        .withColumnRenamed("count", "job_count")
        .withColumn("position", custom_order(F.col("level"), EXPERIENCE_ORDER))
        .orderBy("position")
    )


def salary_by_role(jobs: DataFrame, n: int = 20, min_jobs: int = 5) -> DataFrame:
    """AGG15"""
    return (
        jobs.groupBy(rules.role(F.col("title")).alias("role"))
        .agg(avg_salary(0).alias("avg_salary"), _rows().alias("job_count"))
        .filter(F.col("job_count") >= min_jobs)
        .orderBy(F.col("job_count").desc(), F.col("avg_salary").desc_nulls_last(), "role")
        .limit(n)
    )


def top_skills(
    df: DataFrame, text: Column, n: int = 20, skills: list[str] = rules.SKILLS, compat: bool = False
) -> DataFrame:
    """AGG16: documents naming each skill.

    Each document emits a skill at most once, so the distinct count needs no
    shuffle of documents: counts combine on the map side to one row per skill.
    ``compat`` gives every skill found the count 1.
    """
    found = df.select(F.explode(rules.skills_in(text, skills, compat, ordered=False)).alias("skill"))
    count = F.max(F.lit(1)).cast("long") if compat else _rows()
    return found.groupBy("skill").agg(count.alias("count")).orderBy(F.col("count").desc(), "skill").limit(n)


def dropdown(
    df: DataFrame, column: str, stop: list[str], min_rows: int, n: int
) -> DataFrame:
    """AGG17: the most frequent values without stop words and names of one or two characters."""
    name = F.col(column)
    return (
        df.filter((name != "") & ~name.isin(stop) & (F.length(name) > 2))
        .groupBy(name.alias("name"))
        .agg(_rows().alias("job_count"))
        .filter(F.col("job_count") >= min_rows)
        .orderBy(F.col("job_count").desc(), "name")
        .limit(n)
    )


def companies_dropdown(jobs: DataFrame) -> DataFrame:
    return dropdown(jobs, "company", flt.COMPANY_STOP, 5, 100)


def locations_dropdown(jobs: DataFrame) -> DataFrame:
    return dropdown(jobs, "location", flt.LOCATION_STOP, 10, 50)


def standardize_locations(jobs: DataFrame, aliases: dict[str, str] | DataFrame = LOCATION_ALIASES, n: int = 50) -> DataFrame:
    """STRF13: alias names merged, generic entries dropped, counts regrouped.

    ``aliases`` may be a table (alias, name) of any length: it meets the distinct
    locations, not the postings. Aliases count in any case; of several names for
    one alias the first in alphabetical order holds.
    """
    if isinstance(aliases, dict):
        aliases = jobs.sparkSession.createDataFrame(list(aliases.items()), "alias string, name string")
    names = aliases.groupBy(F.upper("alias").alias("_alias")).agg(F.min("name").alias("_name"))
    counts = (
        jobs.filter((F.col("location") != "") & ~F.col("location").isin(flt.LOCATION_STOP))
        .groupBy("location")
        .agg(_rows().alias("_jobs"))
    )
    return (
        counts.join(names, F.upper(F.trim("location")) == F.col("_alias"), "left")
        .groupBy(F.coalesce("_name", "location").alias("name"))
        .agg(F.sum("_jobs").alias("job_count"))
        .orderBy(F.col("job_count").desc(), "name")
        .limit(n)
    )


def classification_stats(jobs: DataFrame) -> DataFrame:
    """AGG24"""
    conf = F.col("classification_confidence")
    return (
        jobs.filter(F.col("visa_category").isNotNull())
        .groupBy("visa_category")
        .agg(
            _rows().alias("count"),
            F.round(F.sum(conf.cast("decimal(18,4)")) / F.nullif(F.count(conf).cast("decimal(18,0)"), F.lit(0)), 3)
            .cast("double")
            .alias("avg_confidence"),
            F.round(F.min(conf), 3).alias("min_confidence"),
            F.round(F.max(conf), 3).alias("max_confidence"),
            F.count_if(conf < 0.5).alias("needs_review"),
        )
    )


def classification_run_metrics(results: DataFrame) -> DataFrame:
    """AGG25: run totals from results with ``method`` and ``confidence`` columns."""
    def method(name: str) -> Column:
        return F.count_if(F.col("method") == name)

    total = F.greatest(_rows(), F.lit(1))
    return results.agg(
        _rows().alias("total_jobs"),
        F.count_if(F.col("visa_category").isNotNull()).alias("classified"),
        F.count_if(F.col("confidence") < 0.5).alias("needs_review"),
        F.count_if(F.col("visa_category").isNull()).alias("errors"),
        method("explicit").alias("explicit_hits"),
        method("cache").alias("cache_hits"),
        method("keywords").alias("scorer_calls"),
        nm.ratio(method("cache"), total, 4).alias("cache_hit_rate"),
        nm.ratio(method("explicit"), total, 4).alias("explicit_hit_rate"),
        nm.ratio(method("cache") + method("explicit"), total, 4).alias("cost_savings"),
    )


def status_distribution(filings: DataFrame) -> DataFrame:
    """AGG26"""
    return filings.groupBy("case_status").agg(
        _rows().alias("count"),
        F.count("employer_poc_email").alias("has_poc_email"),
        F.count("agent_attorney_email_address").alias("has_attorney_email"),
    )


def scrape_run_metadata(rows: DataFrame, run: str, category: str, categories: list[str] | None = None) -> DataFrame:
    """AGG27: one row per scrape run with its category breakdown.

    ``categories`` lists all categories a run should cover; those without rows
    count as empty. The breakdown holds one entry per listed category; the total
    counts all rows, also those of other categories or none.
    """
    totals = rows.groupBy(F.col(run).alias("run")).agg(_rows().alias("total_jobs"))
    counts = rows.groupBy(F.col(run).alias("run"), F.col(category).alias("category")).agg(_rows().alias("job_count"))
    if categories is not None:
        grid = counts.select("run").distinct().withColumn("category", F.explode(F.array(*map(F.lit, categories))))
        counts = grid.join(counts, ["run", "category"], "left").fillna(0, ["job_count"])
    active = F.count_if(F.col("job_count") > 0)
    by_category = counts.groupBy("run").agg(
        _rows().alias("total_categories"),
        active.alias("categories_with_jobs"),
        nm.percent(active, _rows(), 1).alias("coverage_pct"),
        F.sort_array(F.collect_list(F.struct("category", "job_count"))).alias("category_breakdown"),
    )
    return by_category.join(totals, by_category["run"].eqNullSafe(totals["run"])).select(
        by_category["run"], "total_jobs", "total_categories", "categories_with_jobs", "coverage_pct",
        nm.ratio(F.col("total_jobs"), F.greatest("categories_with_jobs", F.lit(1)), 1).alias("avg_jobs_per_category"),
        "category_breakdown",
    )


def query_log_metrics(log: DataFrame) -> DataFrame:
    """AGG28: per intent, from ``intent, duration, used_cache, fallback, follow_up, success``."""
    yes = lambda c: F.count_if(F.col(c))
    return log.groupBy("intent").agg(
        _rows().alias("queries"),
        nm.exact_avg(F.col("duration"), 2).alias("avg_query_time"),
        nm.percent(yes("used_cache"), _rows(), 1).alias("cache_hit_pct"),
        yes("fallback").alias("fallback_count"),
        yes("follow_up").alias("follow_ups"),
        F.count_if(F.col("follow_up") & F.col("success")).alias("follow_up_success"),
    )


# Named measures and filters of the posting table.
MEASURES = {
    "total_jobs": lambda: _rows(),
    "avg_salary": lambda: nm.exact_avg(nm.salary_mid(F.col("salary_min"), F.col("salary_max")), 2),
}
NAMED_FILTERS = {
    "cpt_eligible": lambda: F.col("visa_category") == "CPT",
    "h1b_sponsors": lambda: F.coalesce(F.col("h1b_sponsor"), F.lit(False)),
}


def measure(df: DataFrame, by: list[str], measures: list[str], where: list[str] | None = None) -> DataFrame:
    """Semantic layer: named measures by columns under named filters."""
    for name in where or []:
        df = df.filter(NAMED_FILTERS[name]())
    return df.groupBy(*by).agg(*[MEASURES[m]().alias(m) for m in measures])


def relative_posting(jobs: DataFrame) -> DataFrame:
    """PRJ7 over a posting table."""
    return jobs.withColumn("posted_label", tx.relative_day_label(F.col("days_since_posted")))
