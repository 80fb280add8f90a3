"""VEC3, VEC8-VEC10, SRT: filtered and ranked search over the posting table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.functions.rules import VISA_LABELS, any_of
from jobweave.operators import filters as flt
from jobweave.operators.staging import latest_per_key, near_dedup

SKILL_COLUMNS = ["title", "description", "qualifications"]


def _in_any(term: str, columns: list[str]) -> Column:
    return any_of([flt.contains_any(F.col(c), [term]) for c in columns])


def _points(*steps: tuple[Column, int]) -> Column:
    """Points of the first condition that holds, else 0."""
    score = F.lit(0)
    for condition, value in reversed(steps):
        score = F.when(condition, value).otherwise(score)
    return score


def relevance_score(resume_skills: list[str] | None = None) -> Column:
    """VEC3"""
    rate, petitions, days = F.col("h1b_approval_rate"), F.col("h1b_total_petitions"), F.col("days_since_posted")
    score = (
        _points((F.col("h1b_sponsor"), 10))
        + _points((rate > 0.8, 5), (rate > 0.6, 3))
        + _points((petitions > 100, 5), (petitions > 10, 3))
        + _points((F.col("work_model") == "Remote", 3))
        + _points((F.col("salary_min").isNotNull(), 2))
        + _points((days <= 7, 5), (days <= 30, 2))
    )
    for skill in resume_skills or []:
        score = score + _points((_in_any(skill, SKILL_COLUMNS), 20))
    return score


def match_percent(score: Column, full: int = 50) -> Column:
    """VEC3: relevance on a scale of 100."""
    return F.least(F.lit(100.0), score / full * 100)


@dataclass
class SearchCriteria:
    """Structured search request; unset fields do not restrict."""

    titles: list[str] = field(default_factory=list)
    companies: list[str] = field(default_factory=list)
    location: str | None = None
    visa_category: str | None = None
    sponsor_only: bool = False
    min_approval_rate: float | None = None
    min_petitions: int | None = None
    new_grad_only: bool = False
    work_model: str | None = None
    job_type: str | None = None
    job_category: str | None = None
    company_size: str | None = None
    salary_min: int | None = None
    salary_max: int | None = None
    resume_skills: list[str] = field(default_factory=list)
    limit: int = 20


def strict_filters(c: SearchCriteria) -> Column:
    """FLT7 with the list filters of a search request."""
    ok = F.lit(True)
    if c.titles:
        ok = ok & flt.contains_any(F.col("title"), [t for t in c.titles if t])
    if c.companies:
        ok = ok & flt.multi_contains("company_clean", c.companies)
    if c.location:
        ok = ok & flt.contains_any(F.col("location"), [c.location])
    if c.visa_category in VISA_LABELS:
        ok = ok & (F.col("visa_category") == c.visa_category)
    if c.sponsor_only:
        ok = ok & F.col("h1b_sponsor")
    if c.min_approval_rate:
        ok = ok & (F.col("h1b_approval_rate") >= c.min_approval_rate)
    if c.min_petitions:
        ok = ok & (F.col("h1b_total_petitions") >= c.min_petitions)
    if c.new_grad_only:
        ok = ok & F.col("is_new_grad_role")
    if c.work_model:
        model = {"Onsite": "On-site", "On-Site": "On-site"}.get(c.work_model.title(), c.work_model.title())
        ok = ok & (F.col("work_model") == model)
    if c.job_type:
        ok = ok & flt.contains_any(F.col("job_type"), [c.job_type])
    if c.job_category:
        ok = ok & (F.col("job_category") == c.job_category)
    if c.company_size:
        ok = ok & (F.col("company_size") == c.company_size)
    if c.salary_min:
        ok = ok & (F.col("salary_min") >= c.salary_min)
    if c.salary_max:
        ok = ok & (F.col("salary_max") <= c.salary_max)
    return ok


def search_jobs(jobs: DataFrame, c: SearchCriteria, tie_break: str = "url", keep_null_location: bool = False) -> DataFrame:
    """Ranked search: newest row per id, filters, score, near-duplicates out, top-k.

    Near-duplicates go before the limit, so the answer is full whenever enough
    rows match.
    """
    # only the key and the order of a row that fails the filters cross the network: it can but hide older rows of its id
    passes = F.coalesce(flt.exclude_foreign(keep_null=keep_null_location) & strict_filters(c), F.lit(False))
    ranked = {"job_id", "scraped_at", tie_break}
    marked = jobs.withColumn("_passes", passes).select(
        "_passes", *(F.col(x) if x in ranked else F.when(F.col("_passes"), F.col(x)).alias(x) for x in jobs.columns)
    )
    latest = latest_per_key(marked, ["job_id"], ["scraped_at"], [tie_break])
    scored = latest.filter("_passes").drop("_passes").withColumn("relevance_score", relevance_score(c.resume_skills))
    order = [F.col("relevance_score").desc(), F.col("days_since_posted").asc_nulls_last(), F.col(tie_break).asc()]
    return near_dedup(scored, order).orderBy(*order).limit(c.limit)


@dataclass
class BoardFilters:
    """Filters of the posting list page."""

    search: str | None = None
    companies: list[str] = field(default_factory=list)
    locations: list[str] = field(default_factory=list)
    work_models: list[str] = field(default_factory=list)
    job_types: list[str] = field(default_factory=list)
    visa_sponsorship: str = "All"
    salary_min: float | None = None
    salary_max: float | None = None
    posted_within_days: int | None = None
    expansions: list[str] = field(default_factory=list)
    expanded_locations: list[str] = field(default_factory=list)


def board_predicate(f: BoardFilters) -> Column:
    ok = flt.sponsorship(f.visa_sponsorship) & flt.salary_range(f.salary_min, f.salary_max)
    if f.search:
        ok = ok & flt.keyword_search(f.search, expansions=f.expansions, locations=f.expanded_locations)
    if f.companies:
        ok = ok & flt.multi_contains("company", f.companies)
    if f.locations:
        ok = ok & flt.multi_contains("location", f.locations)
    if f.work_models:
        ok = ok & flt.in_list("work_model", f.work_models)
    if f.job_types:
        ok = ok & flt.in_list("job_type", f.job_types)
    if f.posted_within_days:
        ok = ok & flt.posted_within(f.posted_within_days)
    return ok


def job_order(mode: str, tie_break: str = "url") -> list[Column]:
    """SRT1: an unknown mode sorts by recency."""
    orders = {
        "highest_salary": [F.col("salary_max").desc_nulls_last(), F.col("salary_min").desc_nulls_last()],
        "company_az": [F.col("company").asc_nulls_last()],
        "h1b_rate": [F.col("h1b_approval_rate").desc_nulls_last()],
    }
    return orders.get(mode, [F.col("scraped_at").desc_nulls_last()]) + [F.col(tie_break).asc()]


def order_jobs(df: DataFrame, mode: str, limit: int = 50, tie_break: str = "url") -> DataFrame:
    """SRT1 and SRT3: top-k in the chosen order."""
    return df.orderBy(*job_order(mode, tie_break)).limit(limit)


def page(df: DataFrame, order: list[Column], limit: int = 50) -> DataFrame:
    """SRT2: one page of ``limit`` rows, each with the total match count."""
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    return df.orderBy(*order).limit(limit).withColumn("total", total)


def resume_match_pct(skills: list[str], columns: list[str] = SKILL_COLUMNS) -> Column:
    """VEC8: whole percentage of the skills found in the posting."""
    if not skills:
        return F.lit(100)
    matched = sum((_in_any(s, columns).cast("int") for s in skills), F.lit(0))
    return F.floor(matched * 100 / len(skills)).cast("int")


def filter_by_resume(
    jobs: DataFrame, skills: list[str], order: list[Column], minimum: int = 30, fallback: int = 10
) -> DataFrame:
    """VEC8: postings that reach the minimum, or the first ten when none does."""
    scored = jobs.withColumn("match_score", resume_match_pct(skills))
    any_hit = scored.agg(F.coalesce(F.max("match_score"), F.lit(0)).alias("best")).scalar()
    hits = scored.filter(F.col("match_score") >= minimum)
    rest = scored.orderBy(*order).limit(fallback).filter(any_hit < minimum)
    return hits.unionByName(rest)


def expand_search(df: DataFrame, levels: list[Column]) -> DataFrame:
    """VEC9: rows of the first search level that finds anything.

    The levels go from exact to broad. Each row gets the first level it
    satisfies in one pass, and the smallest level wins.
    """
    level = F.lit(None).cast("int")
    for i, predicate in reversed(list(enumerate(levels))):
        level = F.when(predicate, i).otherwise(level)
    leveled = df.withColumn("level", level).filter(F.col("level").isNotNull())
    best = leveled.agg(F.min("level").alias("best")).scalar()
    return leveled.filter(F.col("level") == best)


def should_expand(result_count: Column, location: Column, minimum: int = 5) -> Column:
    """VEC9: few results for a search that named a place."""
    return (result_count < minimum) & location.isNotNull()


def similar_items(
    jobs: DataFrame, job_id: str, role: str | None, skills: list[str], limit: int = 10, tie_break: str = "url"
) -> DataFrame:
    """VEC10: other postings with the role or one of three skills, newest first."""
    parts = [flt.contains_any(F.col("title"), [role])] if role else []
    parts += [flt.contains_any(F.col("description"), [s]) for s in skills]
    similar = any_of(parts) if parts else F.lit(True)
    return (
        jobs.filter(similar & (F.col("job_id") != job_id))
        .orderBy(F.col("posted_date").desc_nulls_last(), F.col(tie_break))
        .limit(limit)
    )


def skill_term_score(terms: list[str]) -> Column:
    """VEC4: how many of the first ten terms the posting names."""
    return sum((_in_any(t, SKILL_COLUMNS).cast("int") for t in terms), F.lit(0))


def search_by_terms(
    jobs: DataFrame, terms: list[str], visas: list[str], days_back: int, limit: int, tie_break: str = "url"
) -> DataFrame:
    """VEC4: recent open postings by number of terms named; without terms, the newest."""
    open_rows = jobs.filter(F.col("visa_category").isin(visas) & (F.col("days_since_posted") <= days_back))
    scored = open_rows.withColumn("relevance_score", skill_term_score(terms))
    if terms:
        scored = scored.filter(F.col("relevance_score") > 0)
    return scored.orderBy(
        F.col("relevance_score").desc(), F.col("days_since_posted").asc_nulls_last(), F.col(tie_break)
    ).limit(limit)
