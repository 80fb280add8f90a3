"""FLT: row predicates. Each returns a Column, or filters a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.functions.rules import any_of, bind, has_word_of
from jobweave.functions.text import strip

# ---------------------------------------------------------------- fixed values
SEARCH_COLUMNS = ["title", "company", "description", "snippet"]
FOREIGN_MARKERS = [" | ", "Argentina", "Brazil", "India", "Canada", "Mexico"]
FOREIGN_PLACES = [
    "canada", "uk", "united kingdom", "india", "china", "singapore", "australia", "germany", "france", "mexico",
    "brazil", "japan", "europe",
]
NON_US_MARKERS = [
    "canada", "toronto", "vancouver", "ca ", "united kingdom", "uk", "london", "india", "bangalore", "germany",
    "berlin", "australia", "sydney", "singapore",
]
US_MARKERS = [
    "united states", "usa", ", us", " us", "alabama", "alaska", "arizona", "arkansas", "california", "colorado",
    "connecticut", "delaware", "florida", "georgia", "hawaii", "idaho", "illinois", "indiana", "iowa", "kansas",
    "kentucky", "louisiana", "maine", "maryland", "massachusetts", "michigan", "minnesota", "mississippi",
    "missouri", "montana", "nebraska", "nevada", "new hampshire", "new jersey", "new mexico", "new york",
    "north carolina", "north dakota", "ohio", "oklahoma", "oregon", "pennsylvania", "rhode island",
    "south carolina", "south dakota", "tennessee", "texas", "utah", "vermont", "virginia", "washington",
    "west virginia", "wisconsin", "wyoming", "district of columbia", "dc", "d.c", "remote",
]
COMPANY_NOISE = ["United States", "USA", "US", "International", "INTERNATIONAL"]
SPONSOR_NOISE = COMPANY_NOISE + ["ICE"]
STATE_NOISE = [
    "AR", "BR", "HI", "CA", "NY", "TX", "FL", "IL", "PA", "OH", "GA", "NC", "MI", "NJ", "VA", "WA", "AZ", "MA", "TN",
    "IN", "MO", "MD", "WI", "CO", "MN", "SC", "AL", "LA", "KY", "OR", "OK", "CT", "UT", "IA", "NV", "MS", "KS", "NM",
    "NE", "WV", "ID", "NH", "ME", "MT", "RI", "DE", "SD", "ND", "AK", "VT", "WY",
]
COMPANY_STOP = [
    "United States", "Enterprise", "STR", "AR", "Remote", "USA", "Hybrid", "Corporation", "Company", "Inc", "LLC",
]
LOCATION_NOISE = ["Hybrid", "Remote", "USA", "US", "United States"]
LOCATION_NOISE_PREFIXES = ["PACIFIC RIM", "INTELLIGENT TECHNICAL"]
LOCATION_STOP = ["Remote", "USA", "Hybrid", "United States", "N/A", "NA"]
EXPERIENCE_TERMS = {
    "entry": ["entry", "junior", "new grad", "0-2 years"],
    "mid": ["mid", "intermediate", "2-5 years"],
    "senior": ["senior", "lead", "principal", "staff", "5+ years"],
    "intern": ["intern", "internship", "co-op", "student"],
}
NON_RESUME_TERMS = [
    "invoice", "bill", "statement", "payment", "account number", "procedure", "guideline", "policy", "manual",
    "instructions", "total amount", "balance due", "transaction", "form w-", "tax form",
]
RESUME_TERMS = [
    "experience", "education", "skills", "work history", "employment", "degree", "university", "projects",
]
DESTRUCTIVE_VERBS = ["DELETE", "DROP", "TRUNCATE", "ALTER", "CREATE", "INSERT", "UPDATE", "GRANT", "REVOKE"]
DANGEROUS_TOKENS = [";", "--", "/*", "*/", "xp_", "sp_"]
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
# ------------------------------------------------------------ end fixed values


def contains_any(col: Column, values: list[str]) -> Column:
    """Case-insensitive literal containment of any value; NULL text does not match."""
    def hit(low: Column) -> Column:
        return any_of([low.contains(v.lower()) for v in values])

    found = hit(F.lower(col)) if len(values) == 1 else bind(F.lower(col), hit)
    return F.coalesce(found, F.lit(False))


def keyword_search(
    term: str,
    columns: list[str] = SEARCH_COLUMNS,
    expansions: list[str] | None = None,
    locations: list[str] | None = None,
) -> Column:
    """FLT1: the term in any column; with expansions, any of them in the title instead."""
    hit = any_of([contains_any(F.col(c), [term]) for c in columns])
    if expansions:
        hit = contains_any(F.col("title"), expansions)
    if locations:
        hit = hit & contains_any(F.col("location"), locations)
    return hit


def multi_contains(column: str, values: list[str]) -> Column:
    """FLT2, JN10: any of a short list of values inside the column."""
    return contains_any(F.col(column), [v.strip() for v in values if v.strip()])


def in_list(column: str, values: list[str]) -> Column:
    """FLT3"""
    return F.col(column).isin(values)


def sponsorship(choice: str) -> Column:
    """FLT4: No includes unknown."""
    sponsor = F.coalesce(F.col("h1b_sponsor"), F.lit(False))
    return {"Yes": sponsor, "No": ~sponsor}.get(choice, F.lit(True))


def salary_range(low: float | None = None, high: float | None = None, open_from: float | None = None) -> Column:
    """FLT5; a caller whose highest choice means no limit says from which maximum on in ``open_from``."""
    ok = F.lit(True)
    if low:
        ok = ok & ((F.col("salary_min") >= low) | (F.col("salary_max") >= low))
    if high and (open_from is None or high < open_from):
        ok = ok & (
            (F.col("salary_max") <= high) | (F.col("salary_max").isNull() & (F.col("salary_min") <= high))
        )
    return ok


def posted_within(days: int) -> Column:
    """FLT6"""
    return F.col("days_since_posted").isNotNull() & (F.col("days_since_posted") <= days)


def exclude_foreign(column: str = "location", keep_null: bool = False) -> Column:
    """FLT8: NULL locations are dropped unless ``keep_null``."""
    place = F.col(column)
    domestic = ~any_of([place.contains(m) for m in FOREIGN_MARKERS])
    return F.coalesce(domestic, F.lit(keep_null))


def usa_location(column: str = "location", strict: bool = False, word_boundary: bool = False) -> Column:
    """FLT9: no foreign place named; strict also needs a US marker when a place is given."""
    place = F.lower(F.col(column))
    banned = NON_US_MARKERS if strict else FOREIGN_PLACES
    if word_boundary:
        ok = ~place.rlike(rf"\b({'|'.join(w.strip() for w in banned)})\b")
    else:
        ok = ~has_word_of(place, banned)
    if strict:
        ok = ok & has_word_of(place, US_MARKERS)
    return F.coalesce((place == "") | ok, F.lit(True))


def company_noise(column: str = "company", noise: list[str] = COMPANY_NOISE) -> Column:
    """FLT10: keeps real company names."""
    name = F.col(column)
    return (
        name.isNotNull()
        & ~name.isin(noise + STATE_NOISE)
        & ~F.lower(name).startswith("international")
        & (F.length(name) > 2)
    )


def location_noise(column: str = "location", prefixes: list[str] | None = None) -> Column:
    """FLT11: keeps real places."""
    place = F.col(column)
    ok = (
        place.isNotNull()
        & ~place.isin(LOCATION_NOISE)
        & ~F.lower(place).contains("remote")
        & (F.length(place) > 2)
    )
    for prefix in LOCATION_NOISE_PREFIXES if prefixes is None else prefixes:
        ok = ok & ~F.upper(place).startswith(prefix)
    return ok


def within_lookback(column: str, as_of: str, hours: int, accept_null: bool) -> Column:
    """FLT12"""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hours))
    return F.coalesce(F.col(column) >= cutoff, F.lit(accept_null))


def experience_terms(level: str, column: str = "title") -> Column:
    """FLT13"""
    return contains_any(F.col(column), EXPERIENCE_TERMS[level])


@dataclass
class IntentCriteria:
    """Structured search intent; empty lists and None mean no restriction."""

    titles: list[str] = field(default_factory=list)
    skills: list[str] = field(default_factory=list)
    experience_level: str | None = None
    locations: list[str] = field(default_factory=list)
    work_model: str | None = None
    visa_required: bool = False


def intent_predicate(c: IntentCriteria) -> Column:
    """FLT14: every given group must match, by any of its members."""
    ok = F.lit(True)
    if c.titles:
        ok = ok & contains_any(F.col("title"), c.titles)
    if c.skills:
        ok = ok & contains_any(F.col("description"), c.skills)
    if c.experience_level in EXPERIENCE_TERMS:
        ok = ok & experience_terms(c.experience_level)
    if c.locations:
        places = [p for p in c.locations if p.lower() != "remote"]
        remote = F.lit(len(places) < len(c.locations)) & (F.col("work_model") == "Remote")
        ok = ok & (contains_any(F.col("location"), places) | F.coalesce(remote, F.lit(False)))
    if c.work_model:
        ok = ok & (F.col("work_model") == c.work_model.capitalize())
    if c.visa_required:
        ok = ok & sponsorship("Yes")
    return ok


def intent_filter(df: DataFrame, criteria: IntentCriteria, limit: int, tie_break: str = "url") -> DataFrame:
    """FLT14: newest matches, twice the wanted number to leave room for ranking."""
    order = [F.col("posted_date").desc_nulls_last(), F.col(tie_break)]
    return df.filter(intent_predicate(criteria)).orderBy(*order).limit(2 * limit)


def visa_compatible(work_authorization: Column) -> Column:
    """FLT15: visa categories open to a candidate, each once."""
    def block(condition: Column, *labels: str) -> Column:
        return F.when(condition, F.array(*map(F.lit, labels))).otherwise(F.array().cast("array<string>"))

    auth = F.coalesce(work_authorization, F.lit(""))
    allowed = F.array_distinct(
        F.concat(
            block(auth.contains("F-1") | auth.contains("CPT"), "CPT"),
            block(auth.contains("OPT"), "OPT", "H-1B"),
            block(auth.contains("H-1B"), "H-1B"),
            block(auth.contains("Citizen") | auth.contains("US"), "CPT", "OPT", "H-1B", "US-Only"),
        )
    )
    return F.when(F.size(allowed) > 0, allowed).otherwise(F.array(*map(F.lit, ["CPT", "OPT", "H-1B"])))


def document_validity(
    text: Column,
    reject: list[str] = NON_RESUME_TERMS,
    require: list[str] = RESUME_TERMS,
    needed: int = 3,
    shortest: int = 100,
    longest: int = 50_000,
) -> Column:
    """FLT16: struct of ``is_valid`` and the ``reason`` for a rejection."""

    def content(low: Column) -> Column:
        score = sum((low.contains(t).cast("int") for t in require), F.lit(0))
        return F.when(any_of([low.contains(t) for t in reject]), "billing or procedure document").when(
            score < needed, "not a resume"
        )

    reason = (
        F.when(text.isNull() | (strip(text) == ""), "empty")
        .when(F.length(text) < shortest, "too short")
        .when(F.length(text) > longest, "too long")
        .otherwise(bind(F.lower(text), content))
    )
    return bind(reason, lambda r: F.struct(r.isNull().alias("is_valid"), F.coalesce(r, F.lit("")).alias("reason")))


def is_gibberish(text: Column, share: float = 0.6) -> Column:
    """FLT17: most words are longer than three letters and have no vowel."""

    def mostly_odd(words: Column) -> Column:
        odd = F.filter(words, lambda w: (F.length(w) > 3) & ~F.lower(w).rlike("[aeiou]"))
        return F.size(odd) > F.size(words) * share

    words = F.filter(F.split(strip(text), r"\s+"), lambda w: w != "")
    return (F.length(strip(text)) > 5) & bind(words, mostly_odd)


def unsafe_query(text: Column) -> Column:
    """FLT18: text that starts with or contains a statement changing data."""
    up = F.trim(F.upper(text))
    return any_of(
        [up.startswith(v) | up.contains(f" {v} ") | up.contains(f";{v}") for v in DESTRUCTIVE_VERBS]
    )


def strip_dangerous(text: Column) -> Column:
    """FLT18: dangerous tokens removed one after the other, then trimmed."""
    for token in DANGEROUS_TOKENS:
        text = F.replace(text, F.lit(token), F.lit(""))
    return F.trim(text)


def email_valid(column: Column) -> Column:
    """FLT19"""
    return column.rlike(EMAIL_PATTERN)
