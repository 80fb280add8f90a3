"""AGG1-3, JN1, JN2, AGG18-23: employers, their filings and sponsorship."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.functions import numbers as nm
from jobweave.functions import text as tx
from jobweave.functions.rules import any_of
from jobweave.operators.staging import newest_with_total, top_per_key

# Fixed value: statuses that count as a decided filing.
DECIDED = ["Certified", "Denied", "Withdrawn"]
MATCH_COLUMNS = ["h1b_employer_name", "h1b_city", "h1b_state", "total_petitions", "avg_approval_rate"]


def _certified() -> Column:
    return F.count_if(F.col("case_status") == "Certified")


def employer_summary(filings: DataFrame) -> DataFrame:
    """AGG1"""
    return (
        filings.filter(F.col("employer_name").isNotNull())
        .groupBy(tx.norm_key(F.col("employer_name")).alias("employer_clean"), "employer_name")
        .agg(
            F.count(F.lit(1)).alias("total_petitions"),
            _certified().alias("certified_petitions"),
            F.max("worksite_city").alias("h1b_city"),
            F.max("worksite_state").alias("h1b_state"),
        )
        .withColumn("avg_approval_rate", F.col("certified_petitions") / F.col("total_petitions"))
    )


def sponsorship_score(certified: Column, total: Column, recent: Column, violator: Column, states: Column) -> Column:
    """AGG3: 0 to 100, one decimal. Decimal arithmetic keeps the rounding exact."""
    whole = lambda c: c.cast("decimal(18,0)")
    approval = whole(certified) * 35 / whole(total)
    activity = F.least(whole(recent), F.lit(10)) * F.lit("2.5").cast("decimal(3,1)")
    volume = F.least(whole(total), F.lit(100)) * F.lit("0.15").cast("decimal(3,2)")
    spread = F.least(whole(states), F.lit(10)) * F.lit("0.5").cast("decimal(3,1)")
    compliance = F.when(violator, F.lit(0)).otherwise(F.lit(20))
    return F.round(approval + activity + volume + compliance + spread, 1).cast("double")


def risk_level(violator: Column, approval_rate: Column) -> Column:
    """AGG3"""
    return (
        F.when(violator | (approval_rate < 0.5), "High Risk")
        .when(approval_rate < 0.75, "Medium Risk")
        .otherwise("Low Risk")
    )


def employer_approvals(filings: DataFrame, min_filings: int = 5) -> DataFrame:
    """The counts of AGG2 that an approval rate needs: decided and certified filings per employer spelling, in one shuffle."""
    return (
        filings.filter(F.col("case_status").isin(DECIDED))
        .groupBy(tx.norm_key(F.col("employer_name")).alias("employer_clean"), F.col("employer_name").alias("employer_original"))
        .agg(F.count(F.lit(1)).alias("total_filings"), _certified().alias("total_certified"))
        .filter(F.col("total_filings") >= min_filings)
    )


def employer_intelligence(filings: DataFrame, as_of: str, min_filings: int = 5, compat: bool = False) -> DataFrame:
    """AGG2 and AGG3: sponsor metrics per employer spelling.

    Distinct states are counted from (employer, state) pairs, so an employer
    with very many filings is reduced to a few rows before it meets one task.
    """
    wage = nm.annualize_wage(F.col("wage_rate_of_pay_from"), F.col("wage_unit_of_pay"), compat).cast("decimal(18,2)")
    since = F.add_months(F.lit(as_of).cast("date"), -6)
    per_state = (
        filings.filter(F.col("case_status").isin(DECIDED))
        .groupBy(
            tx.norm_key(F.col("employer_name")).alias("employer_clean"),
            F.col("employer_name").alias("employer_original"),
            "worksite_state",
        )
        .agg(
            F.count(F.lit(1)).alias("filings"),
            _certified().alias("certified"),
            F.count_if(F.col("case_status") == "Denied").alias("denied"),
            F.count_if(F.col("loaded_at") >= since).alias("recent"),
            F.sum(wage).alias("wage_sum"),
            F.count(wage).alias("wage_count"),
            F.bool_or(F.coalesce(F.col("willful_violator") == "Y", F.lit(False))).alias("violator"),
            F.max("loaded_at").alias("last_loaded"),
        )
    )
    metrics = per_state.groupBy("employer_clean", "employer_original").agg(
        F.sum("filings").alias("total_filings"),
        F.sum("certified").alias("total_certified"),
        F.sum("denied").alias("total_denied"),
        F.sum("recent").alias("filings_6mo"),
        F.round(
            F.sum("wage_sum") / F.nullif(F.sum("wage_count").cast("decimal(18,0)"), F.lit(0)), 2
        ).cast("double").alias("avg_wage_offered"),
        F.bool_or("violator").alias("is_violator"),
        F.count("worksite_state").alias("states_count"),
        F.max("last_loaded").alias("last_filing_date"),
    )
    return (
        metrics.filter(F.col("total_filings") >= min_filings)
        .withColumn("approval_rate", nm.div0(F.col("total_certified"), F.col("total_filings")))
        .withColumn(
            "sponsorship_score",
            sponsorship_score(
                F.col("total_certified"), F.col("total_filings"), F.col("filings_6mo"), F.col("is_violator"),
                F.col("states_count"),
            ),
        )
        .withColumn("risk_level", risk_level(F.col("is_violator"), F.col("approval_rate")))
    )


def _leading_parts(name: Column, lengths: Column) -> Column:
    """The leading parts of ``name`` of these lengths, as far as it is long enough."""
    return F.transform(F.array_intersect(F.sequence(F.lit(1), F.length(name)), lengths), lambda n: F.substring(name, F.lit(1), n))


def _lengths(names: DataFrame, name: str) -> Column:
    """The different lengths of the names: few numbers, however many names there are."""
    return names.agg(F.collect_set(F.length(name))).scalar()


def best_employer_per_company(companies: DataFrame, employers: DataFrame, company: str = "company_key") -> DataFrame:
    """Best sponsor for each distinct, non-empty company key.

    A name is a prefix of another exactly when it equals one of the other's
    leading parts, so both prefix directions become one equi-join: of a company's
    leading parts with the employers, each under its whole name and under its
    shorter parts. Only parts as long as some name on the other side are made.
    The employers are first reduced to one row per part: that aggregate combines
    on the map side, so a part shared by a third of all employers costs one row
    per task, and no step produces pairs of names that do not match.
    """
    keep = F.struct(
        "total_petitions", "employer_clean", "employer_name", "h1b_city", "h1b_state", "avg_approval_rate"
    )
    best = F.min_by(keep, F.struct(-F.col("total_petitions"), F.col("employer_clean"), F.col("employer_name")))
    # one row per clean name: spellings of one name compete on petitions
    by_name = employers.filter(F.col("employer_clean") != "").groupBy("employer_clean").agg(best.alias("m"))
    names = companies.filter(F.col(company) != "").select(company).distinct()

    key, clean, part = F.col(company), F.col("employer_clean"), F.col("part")
    # one row per part: the employer of that name, and the best of those whose name goes on after it
    rank = F.struct(-F.col("m.total_petitions"), F.col("m.employer_clean"), F.col("m.employer_name"))
    parts = by_name.withColumn("own", F.array_union(_lengths(names, company), F.array(F.length(clean))))
    by_part = (
        parts.select("employer_clean", "m", F.explode(_leading_parts(clean, F.col("own"))).alias("part"))
        .groupBy("part")
        .agg(F.min_by("m", F.when(part == clean, rank)).alias("named"), F.min_by("m", F.when(part != clean, rank)).alias("begun"))
    )
    # the whole company name finds an equal employer and longer ones, a shorter part an employer of that name
    wanted = names.withColumn("own", F.array_union(_lengths(employers.filter(clean != ""), "employer_clean"), F.array(F.length(key))))
    leading = wanted.select(company, F.explode(_leading_parts(key, F.col("own"))).alias("part"))
    finds = [
        F.when(F.col("named").isNotNull(), F.struct(F.when(part == key, 1).otherwise(2).alias("p"), F.col("named").alias("m"))),
        F.when((part == key) & F.col("begun").isNotNull(), F.struct(F.lit(3).alias("p"), F.col("begun").alias("m"))),
    ]
    found = leading.join(by_part, "part").select(company, F.inline(F.array_compact(F.array(*finds))))

    order = F.struct(F.col("p"), -F.col("m.total_petitions"), F.col("m.employer_clean"), F.col("m.employer_name"))
    return (
        found.groupBy(company)
        .agg(F.min_by(F.struct("p", "m"), order).alias("w"))
        .select(
            company,
            F.col("w.p").alias("match_priority"),
            F.col("w.m.employer_name").alias("h1b_employer_name"),
            F.col("w.m.h1b_city").alias("h1b_city"),
            F.col("w.m.h1b_state").alias("h1b_state"),
            F.col("w.m.total_petitions").alias("total_petitions"),
            F.col("w.m.avg_approval_rate").alias("avg_approval_rate"),
        )
    )


def match_sponsors(jobs: DataFrame, employers: DataFrame) -> DataFrame:
    """JN1: each posting with its best sponsor by (match priority, petitions).

    Priority 1 is an equal name, 2 an employer that is a prefix of the company,
    3 a company that is a prefix of the employer, 4 no match. Only distinct
    company names take part in the search; the long text columns are joined
    once, and a company with very many postings is split by the adaptive
    skew join on the way back.
    """
    keyed = jobs.withColumn("company_key", tx.norm_key(F.col("company")))
    matches = best_employer_per_company(keyed, employers)
    return (
        keyed.join(matches, "company_key", "left")
        .withColumn("h1b_sponsor", F.col("h1b_employer_name").isNotNull())
        .withColumn("match_priority", F.coalesce("match_priority", F.lit(4)))
        .drop("company_key")
    )


def approval_per_clean_name(employers: DataFrame) -> DataFrame:
    """The best approval percentage among the spellings of each clean name."""
    rate = F.col("total_certified") * 100 / F.nullif(F.col("total_filings"), F.lit(0))
    return employers.groupBy("employer_clean").agg(F.max(rate).alias("approval_pct"))


def sponsor_per_clean_name(intelligence: DataFrame) -> DataFrame:
    """One row per clean name, so that a join on it cannot multiply postings."""
    return intelligence.groupBy("employer_clean").agg(
        F.max(F.col("total_certified") * 100 / F.nullif(F.col("total_filings"), F.lit(0))).alias("approval_pct"),
        F.max("sponsorship_score").alias("sponsorship_score"),
        F.max("total_filings").alias("total_filings"),
    )


def join_sponsor_view(jobs: DataFrame, intelligence: DataFrame, key: str = "company_clean") -> DataFrame:
    """JN2"""
    view = sponsor_per_clean_name(intelligence)
    return jobs.join(view, F.upper(F.col(key)) == view.employer_clean, "left")


def salary_stats(
    filings: DataFrame, title: str, location: str | None = None, min_rows: int = 5, n: int = 10, compat: bool = False
) -> DataFrame:
    """AGG18: yearly pay by title and place. ``compat`` leaves the bounds in their own unit."""
    rows = filings.filter(
        F.lower("job_title").contains(title.lower())
        & (F.col("case_status") == "Certified")
        & (F.col("wage_rate_of_pay_from") > 0)
    )
    if location:
        where = location.lower()
        rows = rows.filter(F.lower("worksite_city").contains(where) | F.lower("worksite_state").contains(where))
    pay = nm.annualize_wage(F.col("wage_rate_of_pay_from"), F.col("wage_unit_of_pay"), compat).cast("decimal(18,2)")
    bound = F.col("wage_rate_of_pay_from") if compat else pay
    return (
        rows.groupBy("job_title", "worksite_city", "worksite_state")
        .agg(
            F.count(F.lit(1)).alias("sample_size"),
            nm.exact_avg(pay, 0).alias("avg_salary"),
            F.round(F.min(bound), 0).cast("double").alias("min_salary"),
            F.round(F.max(bound), 0).cast("double").alias("max_salary"),
            nm.exact_avg(F.col("prevailing_wage"), 0).alias("prevailing_wage"),
        )
        .filter(F.col("sample_size") >= min_rows)
        .orderBy(F.col("sample_size").desc(), "job_title", "worksite_city", "worksite_state")
        .limit(n)
    )


def negotiation_band(stats: DataFrame) -> DataFrame:
    """AGG19: below the prevailing wage aim for it, otherwise within a tenth of the average."""
    below = F.col("avg_salary") < F.col("prevailing_wage")
    return stats.withColumns(
        {
            "target": F.when(below, F.col("prevailing_wage")),
            "gap": F.when(below, F.floor(F.col("prevailing_wage") - F.col("avg_salary"))),
            "range_low": F.when(~below, F.floor(F.col("avg_salary").cast("decimal(18,2)") * F.lit("0.9").cast("decimal(2,1)"))),
            "range_high": F.when(~below, F.floor(F.col("avg_salary").cast("decimal(18,2)") * F.lit("1.1").cast("decimal(2,1)"))),
        }
    )


def top_attorneys(filings: DataFrame, state: str, city: str, min_cases: int = 10, n: int = 10) -> DataFrame:
    """AGG20"""
    keys = [
        "lawfirm_name_business_name", "agent_attorney_first_name", "agent_attorney_last_name",
        "agent_attorney_email_address", "agent_attorney_phone", "worksite_city", "worksite_state",
    ]
    place = (F.col("worksite_state") == state) | F.lower("worksite_city").contains(city.lower())
    return (
        filings.filter(
            place & F.col("agent_attorney_email_address").isNotNull() & F.col("lawfirm_name_business_name").isNotNull()
        )
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("total_cases"), _certified().alias("certified_cases"))
        .filter(F.col("total_cases") >= min_cases)
        .withColumn("approval_rate", nm.percent(F.col("certified_cases"), F.col("total_cases"), 1))
        .orderBy(F.col("total_cases").desc(), F.col("approval_rate").desc(), *keys)
        .limit(n)
    )


def employer_contacts(filings: DataFrame, employer: str, n: int = 5) -> DataFrame:
    """WIN3: newest certified filings with a contact, and their employer's total."""
    rows = filings.filter(
        F.lower("employer_name").contains(employer.lower())
        & (F.col("case_status") == "Certified")
        & (F.col("employer_poc_email").isNotNull() | F.col("agent_attorney_email_address").isNotNull())
    )
    return newest_with_total(rows, "employer_name", [F.col("received_date").desc_nulls_last(), F.col("case_number")], n)


def filing_summary(filings: DataFrame, employer: str) -> DataFrame:
    """AGG21"""
    return (
        filings.filter(F.lower("employer_name").contains(employer.lower()))
        .groupBy("employer_name")
        .agg(
            F.count(F.lit(1)).alias("total_filings"),
            _certified().alias("certified"),
            F.count_if(F.col("case_status") == "Denied").alias("denied"),
        )
        .withColumn("approval_rate", nm.percent(F.col("certified"), F.col("total_filings"), 1))
    )


def _named(names: list[str]) -> Column:
    """JN10: any of a short list of names inside the clean or original employer name."""
    upper = [n.upper() for n in names]
    return any_of([F.col("employer_clean").contains(n) | F.upper("employer_original").contains(n) for n in upper])


def ladder(value: Column, steps: list[tuple[float, str]], default: str) -> Column:
    """Label of the first threshold that ``value`` reaches."""
    return reduce(lambda rest, step: F.when(value >= step[0], step[1]).otherwise(rest), reversed(steps), F.lit(default))


def sponsor_profile(intelligence: DataFrame, company: str, n: int = 5) -> DataFrame:
    """AGG22"""
    score = F.col("sponsorship_score")
    return (
        intelligence.filter(_named([company]))
        .withColumn("real_approval_rate", nm.percent(F.col("total_certified"), F.col("total_filings"), 2))
        .withColumn("badge", ladder(score, [(90, "Excellent"), (70, "Good"), (50, "Fair")], "Risky"))
        .withColumn(
            "advice",
            ladder(
                score,
                [(80, "Highly recommended"), (60, "Good option"), (40, "Proceed with caution")],
                "Not recommended",
            ),
        )
        .orderBy(score.desc(), "employer_original")
        .limit(n)
    )


def compare_companies(intelligence: DataFrame, companies: list[str]) -> DataFrame:
    """AGG23: the named companies by score; the winner carries its lead over the second.

    Only the first two rows are compared, through a two-row top-k, so nothing
    is sorted or ranked in one task.
    """
    rows = intelligence.filter(any_of([F.col("employer_clean").contains(c.upper()) for c in companies])).withColumn(
        "real_approval_rate", nm.percent(F.col("total_certified"), F.col("total_filings"), 2)
    )
    order = [F.col("sponsorship_score").desc(), F.col("employer_original").asc()]
    place = F.struct(-F.col("sponsorship_score"), F.col("employer_original"))
    lead = (
        rows.orderBy(*order)
        .limit(2)
        .agg(
            F.struct(
                F.count(F.lit(1)).alias("n"),
                F.min_by("employer_original", place).alias("winner"),
                F.round(F.max("sponsorship_score") - F.min("sponsorship_score"), 1).alias("score"),
                F.round(F.min_by("real_approval_rate", place) - F.max_by("real_approval_rate", place), 2).alias("approval"),
            ).alias("lead")
        )
        .scalar()
    )
    won = (F.col("employer_original") == F.col("_lead.winner")) & (F.col("_lead.n") == 2)
    return (
        rows.withColumn("_lead", lead)
        .withColumn("is_winner", won)
        .withColumn("score_lead", F.when(won, F.col("_lead.score")))
        .withColumn("approval_lead", F.when(won, F.col("_lead.approval")))
        .drop("_lead")
        .orderBy(*order)
    )


def best_match_per_key(candidates: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """WIN2"""
    return top_per_key(candidates, [key], order)
