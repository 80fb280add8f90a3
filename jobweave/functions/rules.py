"""CLF: labels from ordered keyword rules.

A rule set is a list of ``(label, patterns)``; the first rule with a matching
pattern wins. Every classifier takes its rule set as a parameter.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = list[tuple[str, list[str]]]

# ---------------------------------------------------------------- fixed values
ROLE_RULES: Rules = [
    ("Data Scientist", ["DATA SCIEN", "ML", "MACHINE LEARN"]),
    ("Data Engineer", ["DATA ENG"]),
    ("Data Analyst", ["DATA ANALY", "BUSINESS ANALY"]),
    ("Software Engineer", ["SOFTWARE ENG", "DEVELOPER", "PROGRAMMER"]),
    ("DevOps/SRE", ["DEVOPS", "SRE", "SITE RELIABILITY"]),
    ("Cloud Engineer", ["CLOUD"]),
    ("Full Stack Developer", ["FULL STACK"]),
    ("Frontend Developer", ["FRONT%END", "UI"]),
    ("Backend Developer", ["BACK%END"]),
    ("Security Engineer", ["SECURITY", "CYBER"]),
    ("QA/Test Engineer", ["QA", "TEST"]),
    ("Product Manager", ["PRODUCT MANAGER", "PM"]),
]
EXPERIENCE_RULES: Rules = [
    ("Entry Level", ["INTERN", "ENTRY"]),
    ("Junior", ["JUNIOR", "ASSOCIATE"]),
    ("Senior", ["SENIOR", "SR"]),
    ("Lead/Principal", ["LEAD", "PRINCIPAL", "STAFF"]),
]
WORK_MODEL_RULES: Rules = [("Remote", ["REMOTE"]), ("Hybrid", ["HYBRID"])]
SENIORITY_RULES: Rules = [
    ("Senior", ["SENIOR", "SR ", "LEAD"]),
    ("Junior", ["JUNIOR", "JR ", "ENTRY"]),
    ("Principal", ["PRINCIPAL", "STAFF"]),
    ("Management", ["MANAGER", "DIRECTOR"]),
]
CATEGORIES = ["Engineering", "Data", "Product", "Design", "Sales", "Marketing", "Operations", "Other"]
VISA_LABELS = ["CPT", "OPT", "H-1B", "US-Only"]
VISA_KEYWORDS = {
    "US-Only": ["citizenship required", "clearance", "us citizen only"],
    "CPT": ["cpt", "intern", "internship", "co-op", "student"],
    "H-1B": ["h-1b", "h1b", "sponsor", "visa sponsorship"],
    "OPT": ["opt", "new grad", "recent graduate", "entry level"],
}
SKILLS = [
    "PYTHON", "JAVA", "JAVASCRIPT", "SQL", "AWS", "AZURE", "GCP", "REACT", "NODE", "DOCKER", "KUBERNETES",
    "TENSORFLOW", "PYTORCH", "SPARK", "HADOOP", "KAFKA", "REDIS", "MONGODB", "POSTGRES", "C++", "GOLANG",
    "RUST", "TYPESCRIPT", "VUE", "ANGULAR", "DJANGO", "FLASK", "SPRING", "JENKINS", "TERRAFORM", "ANSIBLE",
    "GIT", "LINUX", "TABLEAU", "POWERBI", "EXCEL", "R", "SCALA", "SWIFT", "KOTLIN", "PHP", "RUBY", "PERL",
    "BASH", "MATLAB", "SAS", "SPSS", "HIVE", "AIRFLOW", "DATABRICKS", "SNOWFLAKE", "REDSHIFT", "BIGQUERY",
    "LOOKER", "GRAFANA", "PROMETHEUS", "ELASTICSEARCH", "CASSANDRA", "DYNAMODB", "NEO4J", "GRAPHQL", "REST",
    "API", "MICROSERVICES", "AGILE", "SCRUM", "DEVOPS", "CICD", "ML", "AI", "NLP", "COMPUTER VISION",
    "DEEP LEARNING", "ETL",
]
# ------------------------------------------------------------ end fixed values

# Stand-in for a hosted category model: title keywords for the same labels.
CATEGORY_RULES: Rules = [
    ("Data", ["DATA", "MACHINE LEARN", "ANALYTICS"]),
    ("Product", ["PRODUCT"]),
    ("Design", ["DESIGN", "UX"]),
    ("Sales", ["SALES", "ACCOUNT EXEC"]),
    ("Marketing", ["MARKETING", "BRAND"]),
    ("Operations", ["OPERATIONS", "LOGISTICS"]),
    ("Engineering", ["ENGINEER", "DEVELOPER", "PROGRAMMER", "ARCHITECT", "DEVOPS"]),
]


def any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Catalyst inlines an expression wherever a predicate or a CASE branch uses
    it; a lambda argument is evaluated once however often it is used.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def has_word_of(text: Column, words: list[str]) -> Column:
    """Whether short text holds any of many literal words; one pass over the text."""
    return text.rlike("|".join(re.escape(w) for w in words))


def matches(text: Column, pattern: str, word_boundary: bool = False) -> Column:
    """Whether upper-cased ``text`` holds ``pattern``; ``%`` spans any characters."""
    if word_boundary:
        body = ".*".join(re.escape(p.strip()) for p in pattern.split("%"))
        return text.rlike(rf"(?s)\b{body}\b")
    return text.like(f"%{pattern}%") if "%" in pattern else text.contains(pattern)


def classify_rules(col: Column, rules: Rules, default: str, word_boundary: bool = False) -> Column:
    """CLF0: label of the first rule that matches ``col``, ignoring case."""
    text = F.upper(col)
    label = F.lit(default)
    for name, patterns in reversed(rules):
        label = F.when(any_of([matches(text, p.upper(), word_boundary) for p in patterns]), name).otherwise(label)
    return label


def role(title: Column, word_boundary: bool = False) -> Column:
    """CLF1"""
    return classify_rules(title, ROLE_RULES, "Other Tech Role", word_boundary)


def experience(title: Column, word_boundary: bool = False) -> Column:
    """CLF2"""
    return classify_rules(title, EXPERIENCE_RULES, "Mid-Level", word_boundary)


def work_model(location: Column) -> Column:
    """CLF3"""
    return classify_rules(location, WORK_MODEL_RULES, "On-site")


def seniority(title: Column, word_boundary: bool = False) -> Column:
    """CLF4"""
    return classify_rules(title, SENIORITY_RULES, "Mid-Level", word_boundary)


def is_remote(location: Column, description: Column) -> Column:
    """CLF5"""
    where, text = F.lower(location), F.lower(description)
    return F.coalesce(where.contains("remote"), F.lit(False)) | F.coalesce(
        text.contains("remote") | text.contains("work from home"), F.lit(False)
    )


def remote_label(remote: Column) -> Column:
    return F.when(remote, "Remote").otherwise("On-site")


def job_category(title: Column) -> Column:
    """CLF7, deterministic default; a hosted model plugs in through BatchScorer."""
    return classify_rules(title, CATEGORY_RULES, "Other")


def found_keywords(text: Column, keywords: list[str], word_boundary: bool = True) -> Column:
    """The keywords present in lower-cased ``text``, in list order."""

    def hit(word: str) -> Column:
        return text.rlike(rf"\b{re.escape(word)}\b") if word_boundary else text.contains(word)

    return F.array_compact(F.array(*[F.when(hit(w), F.lit(w)) for w in keywords]))


def flag_is_yes(flag: Column) -> Column:
    """True for boolean true and for the text ``yes`` in any case."""
    return F.coalesce(F.lower(F.trim(flag.cast("string"))).isin("yes", "true"), F.lit(False))


def classify_visa(
    text: Column,
    h1b_flag: Column | None = None,
    new_grad_flag: Column | None = None,
    word_boundary: bool = True,
) -> Column:
    """CLF6: struct of visa category, confidence, signals, method and review flag.

    Explicit flags come first, then keywords. ``word_boundary=False`` matches
    bare substrings.
    """

    def outcome(label: str, confidence: float, signals: Column, method: str) -> Column:
        return F.struct(
            F.lit(label).alias("visa_category"),
            F.lit(confidence).alias("confidence"),
            signals.alias("signals"),
            F.lit(method).alias("method"),
        )

    def flagged(signal: str) -> Column:
        return F.array(F.lit(signal))

    # (label, keywords needed, confidence), tried in this order
    steps = [
        ("US-Only", 1, 0.85),
        ("CPT", 2, 0.80),
        ("CPT", 1, 0.70),
        ("H-1B", 2, 0.75),
        ("H-1B", 1, 0.65),
        ("OPT", 2, 0.75),
        ("OPT", 1, 0.65),
    ]

    def by_keywords(found: Column) -> Column:
        result = outcome("Unknown", 0.0, F.array().cast("array<string>"), "keywords")
        for label, needed, confidence in reversed(steps):
            words = found[label]
            result = F.when(
                F.size(words) >= needed, outcome(label, confidence, words, "keywords")
            ).otherwise(result)
        return result

    def search(low: Column) -> Column:
        return F.struct(*[found_keywords(low, words, word_boundary).alias(n) for n, words in VISA_KEYWORDS.items()])

    result = bind(bind(F.lower(F.coalesce(text, F.lit(""))), search), by_keywords)
    if new_grad_flag is not None:
        result = F.when(
            flag_is_yes(new_grad_flag), outcome("OPT", 0.85, flagged("explicit_new_grad_flag"), "explicit")
        ).otherwise(result)
    if h1b_flag is not None:
        result = F.when(
            flag_is_yes(h1b_flag), outcome("H-1B", 0.95, flagged("explicit_h1b_sponsored_flag"), "explicit")
        ).otherwise(result)
    return result


def needs_review(confidence: Column) -> Column:
    return confidence < 0.5


def tokens(text: Column, min_length: int = 1) -> Column:
    """STRF1: upper-cased words of letters, digits and plus signs."""
    # runs of token characters; several times faster than splitting on the others
    pattern = f"[A-Z0-9+]{{{min_length},}}"
    return F.regexp_extract_all(F.upper(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def skills_in(text: Column, skills: list[str] = SKILLS, compat: bool = False, ordered: bool = True) -> Column:
    """Skills named in ``text``, each once, in dictionary order if ``ordered``.

    One-word skills are looked up among the tokens and longer ones in the token
    sequence. ``compat`` drops tokens of one or two letters and finds no
    multi-word skill.
    """
    single = [s for s in skills if " " not in s]
    phrases = [] if compat else [s for s in skills if " " in s]
    dictionary = F.array(*map(F.lit, single))

    def in_order(hits: Column) -> Column:
        placed = F.transform(hits, lambda w: F.struct(F.array_position(dictionary, w).alias("p"), w.alias("w")))
        return F.transform(F.array_sort(placed), lambda x: x["w"])

    def look_up(words: Column) -> Column:
        hits = F.array_distinct(F.filter(words, lambda w: w.isin(single)))
        hits = in_order(hits) if ordered else hits
        if not phrases:
            return hits
        line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        more = bind(line, lambda x: F.array_compact(F.array(*[F.when(x.contains(f" {p} "), F.lit(p)) for p in phrases])))
        return F.concat(hits, more)

    return bind(tokens(text, 3 if compat else 1), look_up)


def extract_skills(text: Column, limit: int | None = None, skills: list[str] = SKILLS) -> Column:
    """CLF8, deterministic default for a hosted extractor: all skills, or the first ``limit`` of the dictionary's order."""
    found = skills_in(text, skills)
    return found if limit is None else F.slice(found, 1, limit)
