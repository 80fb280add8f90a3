"""Hand-computed cases for column functions."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from jobweave.functions import numbers as nm
from jobweave.functions import rules
from jobweave.functions import text as tx

C = F.col


def values(spark, rows, column, schema="x string"):
    data = [r if isinstance(r, tuple) else (r,) for r in rows]
    return [r[0] for r in spark.createDataFrame(data, schema).coalesce(1).select(column).collect()]


def test_rule_order_and_wildcards(spark):
    titles = ["Senior Lead Intern", "Front-End Engineer", "front office", "HTML Coder", None, "Data Engineer II"]
    assert values(spark, titles, rules.role(C("x"))) == [
        "Other Tech Role", "Frontend Developer", "Other Tech Role", "Data Scientist", "Other Tech Role", "Data Engineer",
    ]
    assert values(spark, titles[:1], rules.experience(C("x"))) == ["Entry Level"]
    assert values(spark, titles[:1], rules.seniority(C("x"))) == ["Senior"]


def test_word_boundary_drops_false_hits(spark):
    rows = ["HTML Coder", "ML Engineer"]
    assert values(spark, rows, rules.role(C("x"), word_boundary=True)) == ["Other Tech Role", "Data Scientist"]


def test_visa_ladder(spark):
    rows = [
        "US citizen only role with clearance and internship",
        "cpt internship for a student",
        "an intern",
        "we sponsor h1b",
        "we sponsor",
        "opt for a new grad",
        "opt",
        "options for hospital staff",
        None,
    ]
    got = values(spark, rows, rules.classify_visa(C("x")))
    assert [(r["visa_category"], r["confidence"]) for r in got] == [
        ("US-Only", 0.85), ("CPT", 0.80), ("CPT", 0.70), ("H-1B", 0.75), ("H-1B", 0.65), ("OPT", 0.75), ("OPT", 0.65),
        ("Unknown", 0.0), ("Unknown", 0.0),
    ]
    assert got[1]["signals"] == ["cpt", "internship", "student"]
    loose = values(spark, rows[7:8], rules.classify_visa(C("x"), word_boundary=False))
    assert loose[0]["visa_category"] == "OPT"


def test_visa_flags_as_text_and_boolean(spark):
    text = spark.createDataFrame([("intern", "YES", False), ("intern", "no", True), ("intern", None, None)], "x string, h string, g boolean")
    got = [r[0]["visa_category"] for r in text.select(rules.classify_visa(C("x"), C("h"), C("g"))).collect()]
    assert got == ["H-1B", "OPT", "CPT"]


def test_skills(spark):
    rows = ["R and C++, Deep Learning; python/Python", "computer games"]
    assert values(spark, rows, rules.skills_in(C("x"))) == [["PYTHON", "C++", "R", "DEEP LEARNING"], []]
    assert values(spark, rows[:1], rules.skills_in(C("x"), compat=True)) == [["PYTHON", "C++"]]
    assert values(spark, rows[:1], rules.extract_skills(C("x"), 2)) == [["PYTHON", "C++"]]


def test_wages(spark):
    rows = [(10.0, "Hour"), (10.0, "Week"), (10.0, "Bi-Weekly"), (10.0, "Month"), (10.0, "Year"), (10.0, None)]
    assert values(spark, rows, nm.annualize_wage(C("a"), C("u")), "a double, u string") == [20800, 520, 260, 120, 10, 10]
    assert values(spark, rows[:2], nm.annualize_wage(C("a"), C("u"), compat=True), "a double, u string") == [20800, 10]


def test_ratio_rounds_half_up(spark):
    rows = [(1, 8), (5, 1000), (1, 0)]
    assert values(spark, rows, nm.percent(C("a"), C("b"), 1), "a long, b long") == [12.5, 0.5, None]
    assert values(spark, [(5, 1000)], nm.ratio(C("a"), C("b"), 2), "a long, b long") == [0.01]


def test_cleaning(spark):
    assert values(spark, [" a ", "NaN", "\n", "", None], tx.null_clean(C("x"))) == ["a", None, None, None, None]
    assert values(spark, ["abcdef", "abc"], tx.truncate_ellipsis(C("x"), 5)) == ["ab...", "abc"]
    long = "a" * 90 + "." + "b" * 20
    assert values(spark, [long, "a." + "b" * 110, "c" * 100], tx.truncate_at_sentence(C("x"), 100)) == [
        "a" * 90 + ".", "a." + "b" * 98 + "...", "c" * 100,
    ]


def test_phone_and_state(spark):
    assert values(spark, ["(617) 555-0100", "1 617 555 0100", "555", "", None], tx.format_us_phone(C("x"))) == [
        "+1 (617) 555-0100", "+1 (617) 555-0100", "555", None, None,
    ]
    assert values(spark, ["Bay Area", "Oregon", "nyc"], tx.state_code(C("x"))) == ["CA", "OR", "NY"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2024-01-05", (2024, 1, 5)), ("1/5/2024", (2024, 1, 5)), ("25/1/2024", (2024, 1, 25)), ("03/04/2024", (2024, 3, 4)),
        ("Jan 5, 2024", (2024, 1, 5)), ("January 5, 2024", (2024, 1, 5)), ("2024-01-05 extra", (2024, 1, 5)),
        ("5 Jan 2024", (2024, 1, 5)), ("2024/1/5", (2024, 1, 5)), ("01-05-2024", (2024, 1, 5)), ("25-01-2024", (2024, 1, 25)),
        ("2024-01-05T01:02:03.5Z", (2024, 1, 5, 1, 2, 3, 500000)), ("2 days ago", (2024, 1, 29)),
        ("5 hours ago", (2024, 1, 30, 19)), ("Posted yesterday", (2024, 1, 30)), ("TODAY", (2024, 1, 31)),
        ("N/A", None), ("Apply", None), ("soon", None), ("99/99/2024", None), (None, None),
    ],
)
def test_posted_date(spark, text, expected):
    got = values(spark, [text], tx.parse_posted_date(C("x"), "2024-01-31"))
    assert got == [dt.datetime(*expected) if expected else None]


def test_model_json(spark):
    rows = [
        '```json\n{"visa_category": "CPT", "confidence": 0.9, "signals": ["a"]}\n```',
        'Answer: {"visa_category": "OPT", "confidence": 1.0}',
        '{"visa_category": "OPT", "confidence": 1.5}',
        '{"visa_category": "Nope", "confidence": 0.5}',
        "none",
    ]
    got = values(spark, rows, tx.clean_model_json(C("x"), rules.VISA_LABELS))
    assert [g and g["visa_category"] for g in got] == ["CPT", "OPT", None, None, None]


def test_job_ids(spark):
    assert values(spark, ["Job ID: AB-1", "Requisition # 77X", "nothing"], tx.extract_job_id(C("x"))) == ["AB-1", "77X", ""]
