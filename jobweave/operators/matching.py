"""FLT15, VEC4-VEC7, INC7: candidate profiles against postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.functions import text as tx
from jobweave.functions.rules import any_of
from jobweave.operators.staging import top_per_key

# ---------------------------------------------------------------- fixed values
SEMANTIC_WEIGHTS = {"semantic": 0.35, "skills": 0.25, "experience": 0.20, "visa": 0.10, "location": 0.05, "growth": 0.05}
KEYWORD_WEIGHTS = {"skills": 0.30, "experience": 0.25, "visa": 0.20, "location": 0.15, "growth": 0.10}
BIG_TECH = ["google", "microsoft", "amazon", "meta", "apple"]
# ------------------------------------------------------------ end fixed values


def _low(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit("")))


def skills_score() -> Column:
    """Share of the profile's skills named in the qualifications, else the description."""
    text = F.lower(F.coalesce(F.nullif(F.col("qualifications"), F.lit("")), F.col("description"), F.lit("")))
    skills = F.transform(F.coalesce("technical_skills", F.array().cast("array<string>")), lambda s: F.lower(s))
    found = F.size(F.filter(skills, lambda s: F.contains(text, s)))
    return F.when(F.size(skills) > 0, found * 100.0 / F.size(skills)).otherwise(50.0)


def experience_score() -> Column:
    title, years = _low("title"), F.coalesce(F.col("total_experience_years"), F.lit(0.0))
    return (
        F.when(title.contains("intern") & (years <= 2), 90)
        .when(title.contains("entry") | title.contains("junior"), F.when(years <= 3, 85).otherwise(70))
        .when(title.contains("senior"), F.when(years >= 5, 90).otherwise(50))
        .otherwise(75)
        .cast("double")
    )


def visa_score() -> Column:
    auth = F.coalesce(F.col("work_authorization"), F.lit(""))
    visa = F.coalesce(F.col("visa_category"), F.lit(""))
    fits = (
        (auth.contains("CPT") & (visa == "CPT"))
        | (auth.contains("OPT") & visa.isin("OPT", "H-1B"))
        | (auth.contains("H-1B") & (visa == "H-1B"))
        | auth.contains("Citizen")
    )
    return F.when(fits, 100).when(visa == "US-Only", 0).otherwise(70).cast("double")


def location_score() -> Column:
    place = _low("location")
    wanted = F.transform(F.coalesce("preferred_locations", F.array().cast("array<string>")), lambda p: F.lower(p))
    return (
        F.when(F.exists(wanted, lambda p: F.contains(place, p)), 95)
        .when(place.contains("remote") | F.array_contains(wanted, "remote"), 100)
        .otherwise(50)
        .cast("double")
    )


def growth_score() -> Column:
    return (
        F.when(any_of([_low("company").contains(t) for t in BIG_TECH]), 85)
        .when(F.coalesce(F.col("h1b_sponsor"), F.lit(False)), 75)
        .otherwise(60)
        .cast("double")
    )


def match_scores(pairs: DataFrame) -> DataFrame:
    """VEC5: partial scores of profile and posting columns on one row."""
    return pairs.withColumns(
        {
            "skills_score": skills_score(),
            "experience_score": experience_score(),
            "visa_score": visa_score(),
            "location_score": location_score(),
            "growth_score": growth_score(),
        }
    )


def overall_score(weights: dict[str, float] = SEMANTIC_WEIGHTS) -> Column:
    """VEC6: weighted mean, one decimal, ties to the even digit.

    A missing semantic score counts as 0.5. The sum is taken in decimals and
    cleared of the error of shares such as one third before it is rounded.
    """
    total = F.lit(0).cast("decimal(20,12)")
    for part, weight in weights.items():
        value = F.coalesce("semantic_score", F.lit(0.5)) * 100 if part == "semantic" else F.col(f"{part}_score")
        total = total + value.cast("decimal(16,12)") * F.lit(str(weight)).cast("decimal(3,2)")
    return F.bround(F.round(total, 8), 1).cast("double")


# ---------------------------------------------------------------- fixed values
# least percentage, beginning and end of the sentence; the last one holds for all others
SIMILARITY_REASONS = [
    (70, "Excellent semantic match", "Strong alignment between your resume and job requirements"),
    (60, "Good match", "Your background aligns well with this role"),
    (0, "Moderate match", "Some relevant skills and experience"),
]
# ------------------------------------------------------------ end fixed values


def match_reasoning() -> Column:
    """VEC7: the reasons that apply, as one sentence."""
    skills, visa = F.col("skills_score"), F.col("visa_score")
    reasons = F.concat_ws(
        ", ",
        F.when(skills >= 80, "Strong skills match").when(skills >= 60, "Good skills overlap"),
        F.when(F.col("experience_score") >= 80, "experience level fits"),
        F.when(visa == 100, "visa compatible").when(visa == 0, "visa incompatible"),
        F.when(F.col("location_score") >= 90, "preferred location"),
    )
    line = F.lower(F.when(reasons == "", "Potential match").otherwise(reasons))
    return F.concat(F.upper(F.substring(line, 1, 1)), F.substring(line, F.lit(2), F.length(line)))


def direct_reasoning(percent: Column) -> Column:
    """VEC7 for matches by similarity alone, on a scale of 100."""
    shown = F.bround(percent, 0).cast("int").cast("string")
    lines = [(least, F.concat(F.lit(f"{head} ("), shown, F.lit(f"%) - {tail}"))) for least, head, tail in SIMILARITY_REASONS]
    return F.coalesce(*[F.when(percent >= least, line) for least, line in lines[:-1]], lines[-1][1])


def rank_matches(pairs: DataFrame, profile: str, tie_break: str = "job_id", n: int = 10, weights: dict[str, float] = SEMANTIC_WEIGHTS) -> DataFrame:
    """VEC5-VEC7: score candidate pairs and keep the best ``n`` per profile.

    ``pairs`` comes from an equi-join of profiles with their own candidates
    (VEC2 or VEC4), never from all profiles with all postings.
    """
    scored = match_scores(pairs).withColumn("overall_score", overall_score(weights))
    best = top_per_key(scored, [profile], [F.col("overall_score").desc(), F.col(tie_break).asc()], n)
    return best.withColumn("match_reasoning", match_reasoning())


def direct_matches(candidates: DataFrame, profile: str, job: str, n: int = 10) -> DataFrame:
    """VEC2 candidates as final matches, with scores taken from the similarity."""
    percent = F.round(F.col("score") * 100, 7)
    best = top_per_key(candidates, [profile], [F.col("score").desc(), F.col(job).asc()], n)
    return best.withColumns(
        {
            "overall_score": percent,
            "skills_score": percent,
            "experience_score": percent,
            "visa_score": F.when(F.coalesce(F.col("h1b_sponsor"), F.lit(False)), 100.0).otherwise(50.0),
            "location_score": F.lit(70.0),
            "match_reasoning": direct_reasoning(percent),
        }
    )


def match_rows(matches: DataFrame, profile: str, as_of: str, job: str = "job_id") -> DataFrame:
    """INC7: rows for the stored match table."""
    scores = ["overall_score", "skills_score", "experience_score", "visa_score", "location_score"]
    return matches.select(
        tx.composite_key(F.col(profile).cast("string"), F.col(job).cast("string")).alias("match_id"),
        F.col(profile).cast("string").alias("resume_id"),
        F.col(job).cast("string").alias("job_id"),
        *[F.col(s).cast("decimal(5,2)").alias(s) for s in scores],
        "match_reasoning",
        F.lit(as_of).cast("timestamp_ntz").alias("matched_at"),
    )
