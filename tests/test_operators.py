"""Small fixtures, brute force and invariants for the operators."""

from __future__ import annotations

import datetime as dt
import os
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobweave.functions import rules
from jobweave.operators import analytics as an
from jobweave.operators import conversations as cv
from jobweave.operators import filters as flt
from jobweave.operators import incremental as inc
from jobweave.operators import matching as mt
from jobweave.operators import pages as pg
from jobweave.operators import quality as dq
from jobweave.operators import pivots as pv
from jobweave.operators import search as se
from jobweave.operators import sponsors as sp
from jobweave.operators import staging as st
from jobweave.operators import vectors as ve
from jobweave.sources import adapters as ad
from jobweave.sources import files, sinks

C = F.col


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def day(n):
    return dt.datetime(2024, 1, n)


# ------------------------------------------------------------------ staging
def test_latest_per_key_breaks_ties_and_drops_ids(spark):
    df = spark.createDataFrame(
        [("1", day(1), "b"), ("1", day(2), "d"), ("1", day(2), "c"), ("N/A", day(3), "x"), (None, day(3), "y")],
        "job_id string, scraped_at timestamp_ntz, url string",
    )
    out = st.latest_per_key(df, ["job_id"], ["scraped_at"], ["url"], drop_ids=["N/A"])
    assert rows_of(out, "job_id", "url") == [("1", "c")]
    again = st.latest_per_key(out, ["job_id"], ["scraped_at"], ["url"], drop_ids=["N/A"])
    assert rows_of(again, "url") == rows_of(out, "url")


def test_rank_is_limited_before_the_shuffle(spark, sf_dir):
    df = st.latest_per_key(ad.read(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_shipdate"], ["l_orderkey"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_stage_jobs_keeps_recent_complete_rows(spark):
    as_of = "2024-04-30"
    df = spark.createDataFrame(
        [
            ("1", " t ", " c ", "l", dt.datetime(2024, 1, 31)),  # 90 days
            ("2", "t", "c", "l", dt.datetime(2024, 1, 30)),  # 91 days
            ("3", None, "c", "l", dt.datetime(2024, 4, 1)),
            ("4", "t", "  ", "l", dt.datetime(2024, 4, 1)),
            (None, "t", "c", "l", dt.datetime(2024, 4, 1)),
        ],
        "job_id string, title string, company string, location string, scraped_at timestamp_ntz",
    )
    assert rows_of(st.stage_jobs(df, as_of), "job_id", "title", "company") == [("1", "t", "c")]


# ----------------------------------------------------------------- sponsors
def brute_match(company, employers):
    best = None
    for name, petitions in employers:
        clean = name.strip().upper()
        if not clean or not company:
            continue
        p = 1 if company == clean else 2 if company.startswith(clean) else 3 if clean.startswith(company) else None
        if p and (best is None or (p, -petitions, clean, name) < best):
            best = (p, -petitions, clean, name)
    return (best[0], best[3]) if best else None


@pytest.mark.parametrize("seed", range(3))
def test_match_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    name = lambda: "".join(rng.choice("ab_%") for _ in range(rng.randint(1, 5)))
    employers = list({name(): rng.randint(1, 4) for _ in range(60)}.items())
    companies = sorted({name().upper() for _ in range(60)}) + [""]
    emp = spark.createDataFrame(employers, "employer_name string, total_petitions long").select(
        F.upper(F.trim("employer_name")).alias("employer_clean"), "*", F.lit("").alias("h1b_city"),
        F.lit("").alias("h1b_state"), F.lit(1.0).alias("avg_approval_rate"),
    )
    got = sp.best_employer_per_company(spark.createDataFrame([(c,) for c in companies], "company_key string"), emp)
    expected = {c: m for c in companies if (m := brute_match(c, employers))}
    assert {r[0]: (r[1], r[2]) for r in got.select("company_key", "match_priority", "h1b_employer_name").collect()} == expected


def test_match_has_no_pairwise_join(spark, sf_dir):
    jobs = ad.jobs_raw(spark, sf_dir).select("url", "company")
    plan = sp.match_sponsors(jobs, sp.employer_summary(ad.filings(spark, sf_dir)))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def filings_of(spark, rows):
    return spark.createDataFrame(
        rows,
        "employer_name string, case_status string, worksite_city string, worksite_state string, "
        "wage_rate_of_pay_from double, wage_unit_of_pay string, willful_violator string, loaded_at timestamp_ntz",
    )


def test_employer_intelligence_threshold_and_score(spark):
    base = ("Certified", "c", "MA", 50.0, "Hour", "N", day(15))
    rows = [("Five", *base)] * 4 + [("Five", "Denied", "c", "NY", 104000.0, "Year", "N", day(15))]
    rows += [("Four", *base)] * 4 + [("Five", "Other", "c", "TX", 1.0, "Year", "N", day(15))]
    out = sp.employer_intelligence(filings_of(spark, rows), "2024-02-01").collect()
    assert [r["employer_original"] for r in out] == ["Five"]
    r = out[0]
    # .8*35 + .5*25 + .05*15 + 20 + .2*5 = 62.25
    assert (r["sponsorship_score"], r["risk_level"], r["states_count"]) == (62.3, "Low Risk", 2)
    assert r["avg_wage_offered"] == 104000.0


@pytest.mark.parametrize("certified, total, violator, expected", [(2, 4, False, "Medium Risk"), (3, 4, False, "Low Risk"),
                                                                  (1, 4, False, "High Risk"), (4, 4, True, "High Risk")])
def test_risk_ladder(spark, certified, total, violator, expected):
    df = spark.createDataFrame([(certified / total, violator)], "r double, v boolean")
    assert df.select(sp.risk_level(C("v"), C("r"))).first()[0] == expected


# ------------------------------------------------------------------ filters
def test_filters_on_nulls_and_bounds(spark):
    df = spark.createDataFrame(
        [(1, 10.0, None), (2, None, 50.0), (3, 60.0, 90.0), (4, None, None)], "id int, salary_min double, salary_max double"
    )
    assert rows_of(df.filter(flt.salary_range(40, None)), "id") == [(2,), (3,)]
    assert rows_of(df.filter(flt.salary_range(None, 55)), "id") == [(1,), (2,)]
    assert rows_of(df.filter(flt.salary_range(None, 600_000)), "id") == [(1,), (2,), (3,)]
    assert len(rows_of(df.filter(flt.salary_range(None, 600_000, open_from=500_000)), "id")) == 4


def test_literal_wildcards(spark):
    df = spark.createDataFrame([("a_b",), ("axb",), ("100%",)], "company string")
    assert rows_of(df.filter(flt.multi_contains("company", ["A_B"])), "company") == [("a_b",)]
    assert rows_of(df.filter(flt.multi_contains("company", ["%"])), "company") == [("100%",)]


def test_foreign_null_policy(spark):
    df = spark.createDataFrame([("Boston, MA",), ("BR | Remote",), (None,)], "location string")
    assert df.filter(flt.exclude_foreign()).count() == 1
    assert df.filter(flt.exclude_foreign(keep_null=True)).count() == 2


def test_usa_word_boundary(spark):
    df = spark.createDataFrame([("Milwaukee, WI",), ("London, UK",)], "location string")
    assert df.filter(flt.usa_location()).count() == 0
    assert df.filter(flt.usa_location(word_boundary=True)).count() == 1


def test_gibberish_and_validity(spark):
    df = spark.createDataFrame([("xkcd qwrt zzzz",), ("find me jobs",), ("bcd",)], "t string")
    assert [r[0] for r in df.select(flt.is_gibberish(C("t"))).collect()] == [True, False, False]
    resume = "Experience at a university, education and skills. " * 4
    docs = spark.createDataFrame([(resume,), (resume + " invoice",), ("x" * 200,), ("short",), (" ",)], "t string")
    assert [r[0]["reason"] for r in docs.select(flt.document_validity(C("t"))).collect()] == [
        "", "billing or procedure document", "not a resume", "too short", "empty",
    ]


# ------------------------------------------------------------------- search
def test_search_fills_the_page_after_dedup(spark):
    rows = [(str(i), "u%02d" % i, "Engineer" if i < 5 else f"Engineer {i}", "C", "Boston") for i in range(10)]
    df = spark.createDataFrame(rows, "job_id string, url string, title string, company string, location string")
    extra = {
        "company_clean": C("company"), "scraped_at": F.lit("2024-01-01").cast("timestamp_ntz"), "h1b_sponsor": F.lit(True),
        "h1b_approval_rate": F.lit(0.9), "h1b_total_petitions": F.lit(5), "work_model": F.lit("Remote"),
        "salary_min": F.lit(1.0), "days_since_posted": F.lit(3), "description": F.lit(""), "qualifications": F.lit(""),
    }
    out = se.search_jobs(df.withColumns(extra), se.SearchCriteria(titles=["engineer"], limit=6))
    assert out.count() == 6
    assert out.first()["relevance_score"] == 10 + 5 + 0 + 3 + 2 + 5


def test_sponsor_match_reads_employers_once(spark):
    employers = spark.createDataFrame([("ACME", 9), ("ACME CORP", 5), ("ACME LABS", 7), ("BIG", 1)], "employer_name string, total_petitions long").withColumns(
        {"employer_clean": C("employer_name"), "h1b_city": F.lit("x"), "h1b_state": F.lit("y"), "avg_approval_rate": F.lit(0.5)}
    )
    companies = spark.createDataFrame([("ACME",), ("ACME C",), ("AC",), ("ACME LABS INC",), ("BIGGER",), ("B",), ("Z",), ("",), (None,)], "company_key string")
    found = sp.best_employer_per_company(companies, employers)
    assert rows_of(found, "company_key", "match_priority", "h1b_employer_name") == sorted([
        ("ACME", 1, "ACME"), ("ACME C", 2, "ACME"), ("AC", 3, "ACME"), ("ACME LABS INC", 2, "ACME"), ("BIGGER", 2, "BIG"), ("B", 3, "BIG"),
    ])
    assert sp.best_employer_per_company(companies, employers.limit(0)).count() == sp.best_employer_per_company(companies.limit(0), employers).count() == 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # of each company's parts with the employers; neither side is made a second time for the other direction
    assert plan.count("Join ") == 1 and "Union" not in plan


def test_numbered_names(spark):
    from jobweave.sources.adapters import numbered

    numbers = spark.createDataFrame([(0,), (7,), (999_999_999,), (10**9,), (-5,), (None,)], "n long")
    same = numbers.select(numbered("Customer#", C("n")).alias("a"), F.format_string("Customer#%09d", C("n")).alias("b"))
    assert same.where("a <=> b").count() == 6 and same.first()["a"] == "Customer#000000000"


# ---------------------------------------------------------------- locations
def test_location_aliases_as_a_table(spark):
    jobs = spark.createDataFrame([("NYC",), (" nyc ",), ("New York",), ("sf",), ("Boston",), ("",), (None,)], "location string")
    aliases = spark.createDataFrame([("nyc", "New York"), ("Nyc", "York"), ("SF", "San Francisco"), (None, "Nowhere")], "alias string, name string")
    got = {r["name"]: r["job_count"] for r in an.standardize_locations(jobs, aliases).collect()}
    assert got == {"New York": 3, "San Francisco": 1, "Boston": 1}
    same = an.standardize_locations(jobs, {"nyc": "New York", "SF": "San Francisco"})
    assert {r["name"]: r["job_count"] for r in same.collect()} == got
    assert an.standardize_locations(jobs, aliases.limit(0)).count() == 5


# ------------------------------------------------------------------ vectors
@pytest.mark.parametrize("limits", [(4096, 50_000), (3, 7)])
def test_cosine_topk_is_exact(spark, limits):
    rng = np.random.default_rng(5)
    items = rng.normal(size=(40, 8))
    items[7] = items[3]  # a tie
    queries = rng.normal(size=(10, 8))
    frame = lambda m, n: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{n} long, embedding array<double>")
    got = ve.cosine_topk(frame(queries, "query_id"), frame(items, "item_id"), 4, 8, 0.1,
                         broadcast_queries=limits[0], items_per_block=limits[1])
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(queries) @ unit(items).T, 9)
    expected = set()
    for q in range(10):
        order = sorted((i for i in range(40) if scores[q, i] > 0.1), key=lambda i: (-scores[q, i], i))
        expected |= {(q, i) for i in order[:4]}
    assert {(r[0], r[1]) for r in got.select("query_id", "item_id").collect()} == expected


@pytest.mark.parametrize("pivots, blocks, minimum", [(1, (4096, 50_000), 0.1), (12, (7, 20), 0.1), (12, (4096, 50_000), -1.0), (500, (5, 9), 0.6)])
def test_pruned_topk_is_exact(spark, pivots, blocks, minimum):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 8))
    items = np.vstack([c + 0.1 * rng.normal(size=(25, 8)) for c in centres])
    items[7], items[9], items[11] = items[3], items[3] * 5, 0  # ties and a zero vector
    kinds = [None if i == 5 else i % 3 for i in range(300)]
    open_to = [[i % 3, 1, None][: i % 4] for i in range(300)]
    rows = [(i, [float(x) for x in v], kinds[i], open_to[i]) for i, v in enumerate(items)]
    rows += [(900, None, 1, [1]), (901, [1.0], 1, [1]), (902, [None] * 8, 1, [1])]
    df = spark.createDataFrame(rows, "item_id long, embedding array<double>, class int, allowed array<int>")
    queries = df.withColumnRenamed("item_id", "query_id")
    pairs = spark.sparkContext.accumulator(0)
    sizes = {"pivots": pivots, "queries_per_block": blocks[0], "items_per_block": blocks[1]}
    norms = np.linalg.norm(items, axis=1, keepdims=True)
    unit = np.divide(items, norms, out=np.zeros_like(items), where=norms > 0)
    scores = np.round(unit @ unit.T, 9)

    def best(accepts):
        return sorted(
            (q, i) for q in range(300)
            for i in sorted((i for i in range(300) if scores[q, i] > minimum and accepts(q, i)), key=lambda i: (-scores[q, i], i))[:4]
        )

    got = pv.pruned_topk(queries, df, 4, 8, minimum, compared=pairs, **sizes)
    assert sorted(map(tuple, got.select("query_id", "item_id").collect())) == best(lambda q, i: True)
    assert pairs.value < 300 * 300 / 3 or pivots != 12 or minimum < 0
    got = pv.pruned_topk(queries, df, 4, 8, minimum, item_class="class", allowed="allowed", **sizes)
    assert sorted(map(tuple, got.select("query_id", "item_id").collect())) == best(lambda q, i: kinds[i] is not None and kinds[i] in open_to[q])
    for left, right in ((queries.limit(0), df), (queries, df.limit(0))):
        assert pv.pruned_topk(left, right, 4, 8, minimum).count() == 0


def test_scores_are_held_for_a_few_queries_at_a_time(spark, monkeypatch):
    """Blocks of scores stay small however many queries there are, with the same result, and batches are bounded."""
    rng = np.random.default_rng(4)
    queries, items = rng.normal(size=(90, 8)), rng.normal(size=(70, 8))
    shapes, best = [], ve._best
    monkeypatch.setattr(ve, "_best", lambda scores, *rest: shapes.append(scores.shape) or best(scores, *rest))
    compare = lambda: ve._compare(np.arange(90), queries, None, np.arange(70), items, None, 3, 0.0)
    whole = compare()
    monkeypatch.setattr(ve, "_ASKED", 16)
    shapes.clear()
    order = ["query_id", "score", "item_id"]
    assert compare().sort_values(order).values.tolist() == whole.sort_values(order).values.tolist()
    assert max(n for n, _ in shapes) == 16
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 30))
    ve.embed(spark.createDataFrame([("a b",)], "t string"), C("t"), 8)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == 4 << 20


def test_blocks_of_vectors_travel_in_tiles(spark, monkeypatch):
    """Rows are copied for each tile, not for each block; repeated and null ids, copies and infinite numbers change nothing."""
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(600, 8))
    vectors[100:160] = vectors[3]
    vectors[200, 2], vectors[201] = np.inf, 0
    ids = [None if i % 50 == 7 else i - i % 90 // 89 for i in range(600)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, vectors)], "item_id long, embedding array<double>")
    seen, first = [], ve.top_per_key
    monkeypatch.setattr(ve, "top_per_key", lambda found, *rest: seen.append(found) or first(found, *rest))
    got = ve.cosine_topk(df.withColumnRenamed("item_id", "query_id"), df, 3, 8, 0.1, broadcast_queries=20, items_per_block=20)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, norms, out=np.zeros_like(vectors), where=np.isfinite(norms) & (norms > 0))
    scores = np.round(unit @ unit.T, 9)
    expected = []
    for one in set(ids):
        pairs = sorted((-scores[q, i], -1 if ids[i] is None else ids[i]) for q in range(600) if ids[q] == one for i in range(600) if scores[q, i] > 0.1)
        expected += [(one, None if i < 0 else i, -s) for s, i in pairs[:3]]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    rows = sorted(map(tuple, got.collect()), key=key)
    assert [r[:2] for r in sorted(expected, key=key)] == [r[:2] for r in rows]
    assert np.allclose([r[2] for r in rows], [r[2] for r in sorted(expected, key=key)])
    assert seen[0].count() <= 600 * 3 * 6


def test_embedding_is_unit_and_repeatable(spark):
    df = spark.createDataFrame([("senior data engineer with python",)] * 2 + [("",)], "t string")
    a, b, c = (np.array(r["embedding"]) for r in ve.embed(df, C("t"), 256).collect())
    assert np.allclose(a, b) and abs(np.linalg.norm(a) - 1) < 1e-6 and not c.any()


# ----------------------------------------------------------------- matching
def test_hand_computed_match(spark):
    pair = spark.createDataFrame(
        [(["Spark", "Kafka", "Scala", "Docker", "Java"], "H-1B", 6.0, ["Denver"], "Data Engineer", "Denver, CO", "H-1B", True,
          "Spark, Kafka, Scala and Docker; 5+ years experience", "", "Initech", "j7", "r3")],
        "technical_skills array<string>, work_authorization string, total_experience_years double, "
        "preferred_locations array<string>, title string, location string, visa_category string, h1b_sponsor boolean, "
        "qualifications string, description string, company string, job_id string, resume_id string",
    )
    best = mt.rank_matches(pair, "resume_id", weights=mt.KEYWORD_WEIGHTS).first()
    parts = [best[f"{p}_score"] for p in ("skills", "experience", "visa", "location", "growth")]
    assert parts == [80, 75, 100, 95, 75]
    # 0.3 x 80 + 0.25 x 75 + 0.2 x 100 + 0.15 x 95 + 0.1 x 75
    assert best["overall_score"] == 84.5
    assert best["match_reasoning"] == "Strong skills match, visa compatible, preferred location"


def test_reason_by_similarity(spark):
    df = spark.createDataFrame([(70.0,), (69.4,), (12.0,)], "p double")
    lines = [r[0] for r in df.select(mt.direct_reasoning(C("p"))).collect()]
    assert [line.split(" (")[0] for line in lines] == ["Excellent semantic match", "Good match", "Moderate match"]


def test_vectors_left_out_are_reported(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5]), (2, [1.0]), (3, None), (4, [1.0, None])], "id long, v array<double>")
    assert {tuple(r) for r in ve.rejected_vectors(df, "id", "v", 2).collect()} == {
        (2, "length 1"), (3, "no vector"), (4, "a number is missing")
    }


# -------------------------------------------------------------- incremental
def test_upsert_updates_inserts_and_replays(spark):
    schema = "id string, ts timestamp_ntz, v string"
    target = spark.createDataFrame([("a", day(2), "old"), ("b", day(5), "kept")], schema)
    source = spark.createDataFrame(
        [("a", day(3), "new"), ("a", day(1), "stale"), ("b", day(4), "late"), ("c", day(1), "first"), ("c", day(2), "second")], schema
    )
    once = inc.upsert_newer(target, source, ["id"], "ts")
    assert rows_of(once, "id", "v") == [("a", "new"), ("b", "kept"), ("c", "second")]
    assert rows_of(inc.upsert_newer(once, source, ["id"], "ts"), "id", "v") == rows_of(once, "id", "v")


def test_cache_time_to_live(spark):
    items = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "url string")
    hours = dt.timedelta(hours=1)
    now = dt.datetime(2024, 1, 31)
    cache = spark.createDataFrame(
        [("a", now - 7 * 24 * hours + hours), ("b", now - 7 * 24 * hours), ("c", now - 8 * 24 * hours)],
        "url string, cached_at timestamp_ntz",
    )
    out = inc.cache_lookup(items, cache, "url", "2024-01-31")
    assert rows_of(out, "url", "from_cache") == [("a", True), ("b", True), ("c", False), ("d", False)]


def test_old_progress_is_forgotten(spark):
    items = spark.createDataFrame([("a",), ("b",)], "name string")
    done = spark.createDataFrame([("a", day(10))], "name string, completed_at timestamp_ntz")
    assert rows_of(inc.pending_work(items, done, "name", "2024-01-12"), "name") == [("b",)]
    assert rows_of(inc.pending_work(items, done, "name", "2024-01-20"), "name") == [("a",), ("b",)]


# -------------------------------------------------------------------- cells
def assign_one(cells, kinds):
    """First-fit by hand: cells in order, each to its first open field."""
    out = {}
    for text, fits in zip(cells, kinds):
        for name in pg.CELL_FIELDS:
            if name in fits and name not in out:
                out[name] = text
                break
    return out


def test_cells_fill_the_first_open_field(spark):
    grid = {
        1: ["Software Engineer", "2024-01-15", "Boston, MA", "Remote", "$120k/yr", "H1B sponsor", "Globex Inc", "11-50"],
        2: ["Remote", "Data Analyst", "Senior Analyst", "Apply", "New Grad"],
        3: ["yesterday", "x"],
    }
    cells = [(row, i, t) for row, texts in grid.items() for i, t in enumerate(texts)]
    df = spark.createDataFrame(cells, "row_id int, pos int, cell_text string")
    out = {r["row_id"]: r for r in pg.assign_cells(df, "2024-01-31").collect()}
    kinds = pg.cell_kinds(C("cell_text"), "2024-01-31")
    fits = {
        (r["row_id"], r["pos"]): {k for k in pg.CELL_FIELDS if r[k]}
        for r in df.select("row_id", "pos", *[k.alias(n) for n, k in kinds.items()]).collect()
    }
    for row, texts in grid.items():
        date = out[row]["date_posted"]
        kept = [(t, fits[row, i]) for i, t in enumerate(texts) if t != date and 2 <= len(t) <= 500]
        expected = assign_one([t for t, _ in kept], [f for _, f in kept])
        assert {f: out[row][f] for f in pg.CELL_FIELDS if out[row][f] is not None} == expected
    assert out[1]["date_posted"] == "2024-01-15" and out[1]["title"] == "Software Engineer"
    assert out[1]["location"] == "Boston, MA" and out[1]["company_size"] == "11-50"
    assert out[2]["is_new_grad"] == "Yes" and out[3]["date_posted"] == "yesterday"


def test_cells_of_a_very_long_row(spark):
    rng = random.Random(3)
    words = ["Engineer", "Boston, MA", "Remote", "$5k", "visa", "Acme", "Data", "Initech", "y" * 101, "Hybrid"]
    texts = [rng.choice(words) + rng.choice(["", " x", " II"]) for _ in range(400)]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "row_id int, pos int, cell_text string")
    kinds = pg.cell_kinds(C("cell_text"), "2024-01-31")
    fits = [
        {k for k in pg.CELL_FIELDS if r[k]}
        for r in df.select("pos", *[k.alias(n) for n, k in kinds.items()]).orderBy("pos").collect()
    ]
    row = pg.assign_cells(df, "2024-01-31").first()
    assert {f: row[f] for f in pg.CELL_FIELDS if row[f] is not None} == assign_one(texts, fits)


# ------------------------------------------------------------ conversations
def test_queue_keeps_place_and_drops_the_oldest():
    known = cv.remember([], ["a", "b", "a", "c", "d", "e"])
    assert known == ["a", "b", "c", "d", "e"]
    assert cv.remember(known, ["f", "a"]) == ["c", "d", "e", "f", "a"]


@pytest.mark.parametrize("chunk", [7, 1_000_000])
def test_state_of_a_long_conversation(spark, chunk):
    rng = random.Random(1)
    said = [(1, i, "user", " and ".join(rng.sample(cv.COMPANIES[:9], rng.randint(0, 2)))) for i in range(60)]
    said += [(2, i, "user", "google") for i in (0, 30)] + [(2, 1, "assistant", "tesla")]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r for r in cv.conversation_state(df, chunk_turns=chunk).collect()}
    known = []
    for _, turn, _, text in said[:60]:
        before = known[-1] if known else None
        known = cv.remember(known, [w for w in text.split(" and ") if w])
        row = got[1, turn]
        assert (row["companies"], row["prior_company"], row["turns_kept"]) == (known, before, min(turn + 1, 10))
    assert got[2, 30]["companies"] == ["google"] and got[2, 30]["turns_kept"] == 2


def test_references(spark):
    df = spark.createDataFrame([("Do they hire there?", "google", "boston"), ("Do they?", None, "x"), ("Them", "ibm", None)],
                               "t string, c string, l string")
    assert [r[0] for r in df.select(cv.resolve_references(C("t"), C("c"), C("l"))).collect()] == [
        "Do google hire boston?", "Do they?", "ibm",
    ]


def test_entities_and_intents(spark):
    df = spark.createDataFrame([("Jobs at Google Inc. or IBM in éla, LA and New York",), ("salary of a data scientist",)], "t string")
    got = df.select(*[c.alias(n) for n, c in cv.entities(C("t")).items()], cv.intent(C("t")).alias("i")).collect()
    assert (got[0]["companies"], got[0]["locations"]) == (["google", "ibm"], ["la", "new york"])
    assert got[0]["i"] == "comparison" and got[1]["i"] == "salary" and got[1]["job_titles"] == ["data scientist"]


def test_companies_from_the_last_replies(spark):
    turns = [(1, 1, "assistant", "- Too Old Company"), (1, 3, "assistant", "- **Globex Inc.**, 3 jobs\n2 Initech LLC"),
             (1, 5, "assistant", "Work at Acme Widgets in Boston\n- globex"), (1, 7, "assistant", "- Abc"),
             (1, 8, "user", "- Not A Reply")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    assert cv.companies_from_history(df).first()["companies"] == ["Globex", "Initech", "Acme Widgets"]


# -------------------------------------------------------------------- pages
def test_jsonld_shapes(spark):
    one = '{"@type": "JobPosting", "title": "%s", "jobLocation": %s}'
    home, abroad = '{"address": {"addressLocality": "Boston", "addressRegion": "MA"}}', '[{"address": {"addressRegion": "Canada"}}]'
    script = '<script type="application/ld+json">%s</script>'
    html = [
        script % (one % ("A", home)), script % f'[{one % ("B", "{}")}, {one % ("C", abroad)}]',
        script % f'{{"@graph": [{one % ("D", home)}]}}', script % '{"@type": "JobPosting"', script % (one % ("E", home) + "x"),
    ]
    df = spark.createDataFrame([(i, "http://x.org", h) for i, h in enumerate(html)], "page_id int, url string, html string")
    assert rows_of(pg.jsonld_postings(df), "page_id", "title", "location") == [
        (0, "A", "Boston, MA"), (1, "B", "USA"), (2, "D", "Boston, MA"),
    ]


@pytest.mark.parametrize("href, expected", [
    ("/a", "http://x.org/a"), ("b?q=1", "http://x.org/d/b?q=1"), ("//y.org/z", "http://y.org/z"), ("#f", "http://x.org/d/p?s=1#f"),
    ("?n=2", "http://x.org/d/p?n=2"), ("https://z.org", "https://z.org"), ("", "http://x.org/d/p?s=1"),
])
def test_join_url(spark, href, expected):
    df = spark.createDataFrame([("http://x.org/d/p?s=1#top", href)], "b string, h string")
    assert df.select(pg.join_url(C("b"), C("h"))).first()[0] == expected


# -------------------------------------------------------------------- files
def test_csv_tolerates_bad_rows(spark, tmp_path):
    (tmp_path / "f.csv").write_text('A B,WORKSITE_STATE,C-D\n"x, y",MA,1\nshort\nz,,2\nlong,NY,3,4\n')
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([StructField(n, StringType()) for n in ("A B", "WORKSITE_STATE", "C-D")])
    df = files.normalize_headers(files.read_lca_csv(spark, str(tmp_path / "f.csv"), schema))
    assert df.columns == ["a_b", "worksite_state", "c_d"]
    assert rows_of(df, "a_b", "worksite_state") == [("long", "NY"), ("x, y", "MA")]


def test_array_file_keeps_the_record(spark, tmp_path):
    (tmp_path / "j.json").write_text('[{"job_id": "1", "title": "T", "salary_min": 10.5}, {"job_id": "2"}]')
    df = files.read_scraped_json(spark, str(tmp_path / "j.json"))
    assert rows_of(df, "job_id", "title") == [("1", "T"), ("2", None)]
    assert '"title":"T"' in df.filter("job_id = '1'").first()["raw_json"]


def test_records_keep_unknown_fields_and_rejects(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"job_id": "1", "extra": {"x": [1, 2]}, "source": "s", "scraped_at": "2024-01-02T03:04:05"}\n{bad\n{"job_id": 2, "salary_min": "n/a", "source": "t"}\n')
    records = files.read_records(spark, str(tmp_path / "a.json"))
    typed = {r.job_id: r for r in files.typed_records(records).collect()}
    assert '"extra":{"x":[1,2]}' in typed["1"].raw_json and typed["1"].scraped_at == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert typed["2"].salary_min is None and len(typed) == 2
    assert [(r.corrupt, r.file.endswith("a.json")) for r in records.where("record is null").collect()] == [("{bad", True)]
    assert rows_of(files.schema_drift(records), "source", "field", "records") == [("s", "extra", 1)]


def test_csv_rejects(spark, tmp_path):
    (tmp_path / "f.csv").write_text('A,WORKSITE_STATE\n1,"N\nY"\n2,\n3,MA,more\n4\n5,CA\n')
    schema = T.StructType.fromDDL("A string, WORKSITE_STATE string")
    good, bad = files.read_lca_rows(spark, str(tmp_path / "f.csv"), schema)
    assert rows_of(good, "A", "WORKSITE_STATE") == [("1", "N\nY"), ("5", "CA")]
    assert rows_of(bad, "A", "reject_reason") == [("2", "no worksite state"), ("3", "fields do not fit"), ("4", "fields do not fit")]
    loose, bad = files.read_lca_rows(spark, str(tmp_path / "f.csv"), schema, strict=False)
    assert (loose.count(), bad.count()) == (3, 2)


def test_observed_layers(spark, tmp_path):
    metrics = str(tmp_path / "metrics")
    for run, n in (("1", 10), ("2", 0)):
        stored, count = dq.observed_write(spark.range(n).where("id >= 0"), str(tmp_path / run), f"layer-{run}")
        assert stored.count() == count == n
        dq.record_run(spark, metrics, run, {"mart": count, "raw": 10})
    report = {r.layer: (r.row_count, r.previous_count, r.alert, r.empty_mart) for r in dq.run_report(spark, metrics, "2", "mart").collect()}
    assert report == {"mart": (0, 10, True, True), "raw": (10, 10, False, False)}
    assert dq.run_report(spark, metrics, "1", "mart").count() == 0


def test_old_partitions_are_dropped(spark):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1)), (2, dt.date(2024, 1, 30))], "id int, d date")
    spark.sql("drop table if exists two_days")
    sinks.save_partitioned(df, "two_days", "d")
    assert sinks.drop_old_partitions(spark, "two_days", "d", 7, "2024-01-31") == ["2024-01-01"]
    assert rows_of(spark.table("two_days"), "id") == [(2,)]
    spark.sql("drop table two_days")


# ------------------------------------------------------------ faults found in review
@pytest.mark.parametrize("chunk", [None, 2, 3])
def test_turns_without_or_below_zero(spark, chunk):
    said = [(1, t, "user", "google") for t in (-1, 0, 5, None)]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    assert sorted(r["turns_kept"] for r in cv.conversation_state(df, chunk_turns=chunk).collect()) == [1, 2, 3, 4]


def test_classified_rows_keep_signals_and_stamp(spark):
    rows = [("a", "x", "y", "CPT", 0.9, ["cpt"], "2024-01-01"), ("b", "OPT ok", "opt cpt", None, None, None, None),
            ("c", "x", "nothing said", None, None, None, None)]
    names = ["url", "title", "description", "visa_category", "classification_confidence", "classification_signals", "day"]
    df = spark.createDataFrame(rows, "url string, title string, description string, visa_category string, "
                               "classification_confidence double, classification_signals array<string>, day string")
    df = df.withColumn("classified_at", C("day").cast("timestamp_ntz")).select(*names, "classified_at")
    got = {r["url"]: r for r in inc.update_unclassified(df, "2025-01-31").collect()}
    assert got["a"]["classification_signals"] == ["cpt"] and got["a"]["classified_at"].year == 2024
    assert got["b"]["visa_category"] not in (None, "Unknown") and got["b"]["classified_at"].year == 2025
    assert got["c"]["visa_category"] is None and got["c"]["classified_at"] is None


def test_cache_keeps_one_answer_per_key(spark):
    cache = spark.createDataFrame([], "url string, cached_category string, cached_at timestamp_ntz")
    answers = spark.createDataFrame([("u", "CPT"), ("u", "OPT"), ("v", "OPT")], "url string, cached_category string")
    got = inc.cache_upsert(cache, answers, "url", "2025-01-31").collect()
    assert sorted((r["url"], r["cached_category"]) for r in got) == [("u", "OPT"), ("v", "OPT")]


def test_run_total_counts_unlisted_categories(spark):
    df = spark.createDataFrame([("r", "a"), ("r", "z"), ("r", None)], "run string, category string")
    row = an.scrape_run_metadata(df, "run", "category", ["a", "b"]).first()
    assert (row["total_jobs"], row["total_categories"], row["categories_with_jobs"]) == (3, 2, 1)


# -------------------------------------------------------------------- cards
def test_cards_of_deep_long_and_odd_pages(spark):
    base = "https://c.example.com/list"
    card = '<div class="posting"><h3>{0} engineer wanted</h3></div>'
    beginning = "the same words at the beginning of every card, " * 4
    html = {
        1: "<ul>" + "".join(f'<li class="opening"><h2>Opening number {i}' for i in range(5000)),
        2: '<div class="opening">' * 3000 + "<h3>Nested engineer wanted</h3>",
        3: "".join(card.format(f"Number {i}") for i in range(60)),
        4: "".join(f'<div class="posting"><h3>Engineer wanted {i}</h3>{beginning}{i}</div>' for i in range(2)),
        5: card.format("One") * 2 + "</p></div></li>",
        6: None,
        7: "",
        8: '<div class="posting">' + "<h3>no</h3>" * 9 + '<h3>Tenth heading wins</h3><a href="x?y=1">go</a></div>',
    }
    pages = spark.createDataFrame([(k, base, v) for k, v in html.items()], "page_id long, url string, html string")
    found = {}
    for r in pg.card_postings(pages).collect():
        found.setdefault(r["page_id"], []).append(r)
    assert {k: len(v) for k, v in found.items()} == {1: 5000, 2: 1, 3: 60, 4: 2, 5: 1, 8: 1}
    assert found[2][0]["title"] == "Nested engineer wanted"
    assert found[8][0]["title"] == "Tenth heading wins" and found[8][0]["apply_url"] == "https://c.example.com/x?y=1"


def test_listing_verdicts(spark):
    html = ["Showing 3 jobs, results", "apply " * 9 + "requisition " * 6, "apply " * 8, '<li class="job">' * 9, '<li class="job">' * 8, None]
    df = spark.createDataFrame(list(enumerate(html)), "page_id long, html string")
    got = {r["page_id"]: r["is_listing"] for r in pg.is_listing_page(df).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: False, 5: None}


def test_jsonld_postings_reads_each_text_once(spark):
    df = spark.createDataFrame([(1, "u", "<p>no posting</p>")], "page_id long, url string, html string")
    plan = pg.jsonld_postings(df)._jdf.queryExecution().optimizedPlan().toString()
    # the list of a block, its object, its graph, their members (twice) and the two kinds of employment type
    assert plan.count("from_json(") <= 8
    assert plan.count("get_json_object(") <= 25


def test_cards_of_plain_markup_are_those_of_the_parser():
    page = (
        "<!doctype html><title>Jobs &amp; more</title><!-- all --><script>if (a < b) { '<div class=\"posting\">' }</script>"
        "<ul><LI class='Posting Job-Card' data-qa><a href=\"/job/1?a=1&amp;b=2\">Data &lt;Engineer&gt; wanted</a>"
        '<i class="office">Boston</i><li class="opening"><h3>Senior Analyst of Data</h3><a href>x</a><a href="b/c">y</a></ul>'
    )
    plain, parsed = pg._Cards.__new__(pg._Cards), pg._Cards.__new__(pg._Cards)
    plain.__init__(page)
    assert pg._Cards("").read_plain(page)
    read_plain, pg._Cards.read_plain = pg._Cards.read_plain, lambda self, html: False
    try:
        parsed.__init__(page)
    finally:
        pg._Cards.read_plain = read_plain
    base = "https://jobs.example.com/list?page=1"
    assert list(plain.rows(base)) == list(parsed.rows(base))
    assert [(r[2], r[5]) for r in plain.rows(base)] == [
        ("Data <Engineer> wanted", "https://jobs.example.com/job/1?a=1&b=2"), ("Senior Analyst of Data", base),
    ]
    for odd in ["<iframe><b></iframe>", "<div class=a>", "<title><b></title>", "<script>", "a < b", "</ p>", '<a href="x&y=1">']:
        assert not pg._Cards("").read_plain(page + odd)


def test_cards_need_no_copy_of_the_package_on_executors():
    code = "import pickle, sys; print(len(list(pickle.load(sys.stdin.buffer)(sys.argv[1]).rows(''))))"
    page = '<li class="job-card"><h3>Data Engineer wanted</h3></li>'
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "-c", code, page], input=cloudpickle.dumps(pg._Cards), cwd="/", env=env, capture_output=True, timeout=60)
    assert ran.stdout.strip() == b"1", ran.stderr


def test_cards_number_only_elements_that_they_may_use():
    cards = pg._Cards('<div><p>x</p><b>y</b><script>var x;</script></div>' * 50 + '<li class="job-card"><h3>Data Engineer wanted</h3></li>')
    assert len(cards.last) == 2
    assert [r[2] for r in cards.rows("")] == ["Data Engineer wanted"]


def test_page_postings_reads_no_more_of_a_posting_than_it_returns(spark):
    whole = '{"@type":"JobPosting","title":"Cook","identifier":{"value":"7"},"baseSalary":{"value":{"minValue":1,"maxValue":2}},"description":"d"}'
    docs = [
        whole, f"\x0b [{whole}, 5]\n", '{"@type":"Job\\u0050osting","name":"Escaped","identifier":8}', '{"@type":"Organization","title":"none"}',
        whole + "}", f'{{"@graph":[{whole},{{"@type":"JobPosting"}}]}}', f'"{{JobPosting}}"', "{JobPosting",
    ]
    html = "".join(f'<script type="application/ld+json">{d}</script>' for d in docs)
    pages = spark.createDataFrame([(1, "https://x.example.com/", html), (None, None, html), (2, "u", None)], "page_id long, url string, html string")
    columns = ["job_id", "title", "location", "job_type", "apply_url"]
    few, all_of = pg.jsonld_postings(pages, columns=columns), pg.jsonld_postings(pages)
    assert sorted(map(repr, few.collect())) == sorted(map(repr, all_of.select("page_id", "pos", *columns).collect()))
    first = sorted((r.asDict() for r in all_of.collect() if r.page_id == 1), key=lambda r: r["pos"])
    assert [(r["pos"], r["title"], r["job_id"], r["salary_range"], r["description"]) for r in first] == [
        (0, "Cook", "7", "$1-$2", "d"), (1_000_000, "Cook", "7", "$1-$2", "d"), (2_000_000, "Escaped", "", "", ""), (5_000_000, "Cook", "7", "$1-$2", "d"),
    ]
    plan = optimized(few)
    assert "baseSalary" not in plan and "description" not in plan
    # what can't hold a posting isn't parsed
    assert "JobPosting" in plan[plan.rindex("Filter") :]
    kept = pg.jsonld_postings(pages, columns=["posted_date"]).columns
    assert kept == ["page_id", "pos", "posted_date"]


def test_page_postings_moves_items_without_their_text(spark, sf_dir):
    from jobweave.plans import q_text

    seen = []
    whole, q_text.pg.page_postings = q_text.pg.page_postings, lambda pages: seen.append(pages) or pages.selectExpr("page_id", "0 as strategy", "html as title", "url as location")
    try:
        q_text.page_postings(spark, sf_dir)
    finally:
        q_text.pg.page_postings = whole
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[plan.index("Join") :]
    assert "JobPosting" not in joined


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_candidate_pairs_are_joined_by_numbers(spark, sf_dir):
    from jobweave.plans import q_search

    plan = optimized(q_search.mt.match_scores(q_search.candidate_pairs(spark, sf_dir)).select("url", "skills_score"))
    assert "jobs.example.com" in plan and "jobs.example.com" not in plan[plan.index("Join") :]


def test_search_jobs_moves_no_text_of_rows_that_fail(spark, sf_dir):
    jobs = ad.jobs_processed(spark, sf_dir)
    found = se.search_jobs(jobs, se.SearchCriteria(titles=["data"], limit=5))
    plan = optimized(found)
    below = plan[plan.rindex("Window") :]
    assert "_passes" in below
    # a newer row of the same id hides an older one, also if it fails the filters itself
    rows = jobs.limit(1).withColumn("job_id", F.lit("1")).withColumn("location", F.lit("Boston")).drop("title", "scraped_at", "url")
    two = [rows.withColumns({"title": F.lit(t), "scraped_at": F.lit(s).cast("timestamp"), "url": F.lit(t)}) for t, s in (("Data", "2001-01-01"), ("Cook", "2001-01-02"))]
    wanted = se.SearchCriteria(titles=["data"])
    assert se.search_jobs(two[0].unionByName(two[1]), wanted).count() == 0
    assert [r["title"] for r in se.search_jobs(two[0], wanted).collect()] == ["Data"]


def test_cached_classification_runs_the_rules_once(spark):
    jobs = spark.createDataFrame([("a", "OPT welcome", "text", "No", "No")], "url string, title string, description string, h1b string, grad string")
    cache = spark.createDataFrame([], "url string, cached_category string, cached_confidence double, cached_at timestamp_ntz")
    got = inc.classify_with_cache(jobs, cache, "2024-01-10", h1b_flag=C("h1b"), new_grad_flag=C("grad"))
    assert [(r["visa_category"], r["method"]) for r in got.collect()] == [("OPT", "keywords")]
    # a plan with the rules three times names each keyword three times as often
    listed = sum("clearance" in word for words in rules.VISA_KEYWORDS.values() for word in words)
    assert optimized(an.classification_run_metrics(got)).count("clearance") <= 2 * listed
