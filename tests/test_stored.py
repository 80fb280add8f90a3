"""Bucketed tables, the join of texts with values, stored searches and partitions."""

from __future__ import annotations

import glob
import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from jobweave.operators import incremental as inc
from jobweave.operators import profiles as pr
from jobweave.operators import searches as sr
from jobweave.operators import textjoin as tj
from jobweave.sources import bucketed, sinks

ROW = "a long, b string, ts timestamp_ntz, x string, y string"


def stamp(n):
    return None if n is None else datetime(2024, 1, 1 + n)


def files_of(path):
    found = glob.glob(f"{path}/{bucketed.BUCKET}=*/*.parquet")
    return {f: os.stat(f).st_mtime_ns for f in found}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def random_rows(rng, n):
    return [(rng.choice([None, *range(30)]), rng.choice([None, "p", "q"]), stamp(rng.choice([None, 0, 1, 2, 3])), f"x{i}", f"y{i}") for i in range(n)]


@pytest.mark.parametrize("columns", [None, ["x"]])
def test_upsert_of_buckets(spark, tmp_path, columns):
    rng, path = random.Random(4), str(tmp_path / "t")
    first, second = random_rows(rng, 60), [r for r in random_rows(rng, 40) if r[0] is not None and r[0] < 9]
    old, new = (spark.createDataFrame(r, ROW) for r in (first, second))
    bucketed.create_bucketed(old, path, ["a", "b"], "ts", 32, ["x"])
    want = {(r.a, r.b): tuple(r) for r in bucketed.read_bucketed(spark, path).collect()}
    assert len(want) == len({r[:2] for r in first})
    before = files_of(path)
    touched = bucketed.upsert_bucketed(spark, path, new, ["a", "b"], "ts", 32, update_cols=columns, tie_break=["x"])
    for r in sorted(second, key=lambda r: (r[2] is not None, r[2] or stamp(0), [-ord(c) for c in r[3]])):
        mine = max((s for s in second if s[:2] == r[:2]), key=lambda s: (s[2] is not None, s[2] or stamp(0), [-ord(c) for c in s[3]]))
        have = want.get(r[:2])
        if have is None or (mine[2] is not None and (have[2] is None or mine[2] > have[2])):
            want[r[:2]] = mine if have is None or columns is None else (*mine[:4], have[4])
    assert rows_of(bucketed.read_bucketed(spark, path)) == sorted(want.values(), key=repr)
    after = files_of(path)
    kept = {f: t for f, t in before.items() if int(f.split(f"{bucketed.BUCKET}=")[1].split("/")[0]) not in touched}
    assert 0 < len(touched) < 32 and kept and kept.items() <= after.items()
    assert len({f.split("/")[-2] for f in after.keys() - before.keys()}) == len(touched)
    # a replay changes nothing, and writes nothing
    assert bucketed.upsert_bucketed(spark, path, new, ["a", "b"], "ts", 32, update_cols=columns, tie_break=["x"]) == []
    assert files_of(path) == after
    assert bucketed.upsert_bucketed(spark, path, new.limit(0), ["a", "b"], "ts", 32) == []


def test_upsert_of_buckets_as_a_whole(spark, tmp_path):
    rng, path = random.Random(5), str(tmp_path / "t")
    make = lambda n: [(i, "p", stamp(rng.randrange(4)), f"x{rng.random()}", "y") for i in rng.sample(range(80), n)]
    old, new = (spark.createDataFrame(make(n), ROW) for n in (50, 30))
    bucketed.create_bucketed(old, path, ["a"], "ts", 8)
    bucketed.upsert_bucketed(spark, path, new.drop("y").withColumn("a", F.col("a").cast("int")), ["a"], "ts", 8, update_cols=["x"])
    want = inc.upsert_newer(old, new.withColumn("y", F.lit(None).cast("string")), ["a"], "ts", update_cols=["x"])
    assert rows_of(bucketed.read_bucketed(spark, path)) == rows_of(want)


def test_incremental_table(spark, tmp_path):
    path, settings = str(tmp_path / "t"), {"keys": ["a"], "ts": "ts", "buckets": 4}
    df = spark.createDataFrame([(1, "p", stamp(0), "x", "y"), (2, "p", stamp(0), "x", "y")], ROW)
    assert sinks.materialize(df, "kept_rows", "incremental", path, **settings).count() == 2
    later = spark.createDataFrame([(1, "p", stamp(1), "new", "y"), (3, "p", stamp(0), "x", "y"), (2, "p", stamp(0), "no", "y")], ROW)
    sinks.materialize(later, "kept_rows", "incremental", path, **settings)
    assert rows_of(spark.sql("select a, x from kept_rows")) == [(1, "new"), (2, "x"), (3, "x")]
    for wrong in ({"kind": "incremental"}, {"kind": "incremental", "path": path}, {"kind": "table"}, {"kind": "other"}):
        with pytest.raises(ValueError):
            sinks.materialize(df, "v", **wrong)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_contains_join(spark, adaptive):
    rng = random.Random(6)
    letters = "abcA é_%.\n"
    texts = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(60)))) for i in range(200)] + [(200, None), (201, ""), (202, "shared " * 2000)]
    texts += [(i, f"common gram {i}") for i in range(300, 400)]
    values = ["".join(rng.choice(letters) for _ in range(rng.randrange(7))) for _ in range(150)] + [None, "", " ", "common", "COMMON gram 35", "shared", "zzzz", "a", "é", ".", "%", "_"]
    df = spark.createDataFrame(texts, "id long, text string")
    table = spark.createDataFrame([(v,) for v in values], "value string")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    if adaptive == "false":  # as with values too many to broadcast
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = tj.contains_join(df, "id", "text", table)
        got = rows_of(found)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    wanted = {v.strip(" ").lower() for v in values if v and v.strip(" ")}
    assert got == sorted({(i, v) for i, t in texts if t is not None for v in wanted if v in t.lower()}, key=repr)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert rows_of(tj.containing(df, "id", "text", table).select("id")) == sorted({(i,) for i, _ in got}, key=repr)
    assert tj.contains_join(df.limit(0), "id", "text", table).count() == 0 == tj.contains_join(df, "id", "text", table.limit(0)).count()


@pytest.mark.parametrize("limit", [0, 100])
def test_contains_join_of_many_values(spark, monkeypatch, limit):
    """Values beyond the limit are never sent to every task, small as their file is; repeated keys count once each."""
    monkeypatch.setattr(tj, "BROADCAST_VALUES", limit)
    monkeypatch.setattr(tj, "PLAIN_VALUES", 3)
    values = [f"Customer#{i:09}" for i in range(40)] + ["tom", "er", "0", "x", "customer#0000000", "r#00000"]
    texts = [(i % 30, f" customer#{i % 60:09} Inc") for i in range(120)] + [(None, "Customer#000000007"), (5, None), (6, "CUSTOMER#00")]
    df = spark.createDataFrame(texts, "id long, text string")
    found = tj.contains_join(df, "id", "text", spark.createDataFrame([(v,) for v in values], "value string"))
    want = {}
    for i, t in set(texts):
        want.setdefault(i, []).append((t or "").lower())
    assert set(map(tuple, found.collect())) == {(i, v.lower()) for i, ts in want.items() for v in values if any(v.lower() in t for t in ts)}
    assert found.count() == sum(v.lower() in (t or "").lower() for _, t in texts for v in values)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "salt" not in plan or ("SortMergeJoin [gram" in plan and "BroadcastHashJoin [gram" not in plan)


def test_equal_searches_are_found_once(spark, monkeypatch):
    """Neither the number of equal searches nor that of rows that agree in the restricted fields makes more rows."""
    written, write = [], sr.materialize_once

    def counted(df, label):
        out = write(df, label)
        if label in ("hits", "pools", "best"):
            written.append((label, out.count()))
        return out

    monkeypatch.setattr(sr, "materialize_once", counted)
    jobs = spark.createDataFrame([(f"u{i:03}", f"engineer {i % 3}", f"text {i}") for i in range(300)], "url string, title string, text string")
    fields = {"title": sr.Field("title"), "text": sr.Field("text")}
    rows = [(s, 0, "text", "nowhere") for s in range(400)] + [(s, 1, "title", "Engineer") for s in range(400)]
    asked = spark.createDataFrame(rows, "search long, level int, field string, term string")
    got = rows_of(sr.match_searches(jobs, asked, fields, [F.col("url")], "url", 2).select("search", "level", "url"))
    assert got == sorted([(s, 1, u) for s in range(400) for u in ("u000", "u001")], key=repr)
    assert max(n for _, n in written) <= 6


def test_stored_searches(spark):
    rng = random.Random(7)
    words = ["data", "cloud", "lead", "Intern", "ops"]
    pick = lambda n: " ".join(rng.sample(words, n)) if n else None
    jobs = [(f"u{i}", pick(rng.randrange(4)), pick(rng.randrange(3)), rng.choice(["A", "B", None]), rng.choice([None, 1, 2, 3])) for i in range(150)]
    jobs += [(f"h{i:03}", "data lead", "ops", "A", 2) for i in range(80)]
    conditions = []
    for s in range(60):
        for level in range(rng.randrange(1, 4)):
            for field in rng.sample(["title", "text", "model"], rng.randrange(1, 4)):
                terms = ["A", "B", "C"] if field == "model" else [*words, "none", "da", " Lead "]
                conditions += [(s, level, field, t) for t in rng.sample(terms, rng.randrange(1, 3))]
    conditions += [(99, 0, "title", " "), (99, 0, "other", "x"), (None, 0, "title", "data")]
    df = spark.createDataFrame(jobs, "url string, title string, text string, model string, day int")
    asked = spark.createDataFrame(conditions, "search long, level int, field string, term string")
    fields = {"title": sr.Field("title"), "text": sr.Field("text"), "model": sr.Field("model", exact=True)}
    order = [F.col("day").desc_nulls_last(), F.col("url")]
    got = rows_of(sr.match_searches(df, asked, fields, order, "url", 4).select("search", "level", "url"))

    def accepts(job, field, terms):
        value = job[{"title": 1, "text": 2, "model": 3}[field]]
        return value is not None and any(value == t if field == "model" else t.strip().lower() in value.lower() for t in terms)

    want = []
    for s in range(60):
        for level in range(4):
            groups = {}
            for _, _, f, t in (c for c in conditions if c[:2] == (s, level)):
                groups.setdefault(f, []).append(t)
            hits = [j for j in jobs if groups and all(accepts(j, f, t) for f, t in groups.items())]
            if hits:
                hits.sort(key=lambda j: (-(j[4] or 0), j[0]))
                want += [(s, level, j[0]) for j in hits[:4]]
                break
    assert [r for r in got if r[0] is not None] == sorted(want, key=repr) and len(want) > 100


def test_dropped_partitions(spark):
    days = [(f"2024-01-{d:02}", i) for d in range(1, 29) for i in range(3)] + [(None, 1)]
    df = spark.createDataFrame(days, "d string, v int").withColumn("d", F.to_date("d"))
    spark.sql("drop table if exists days_kept")
    sinks.save_partitioned(df, "days_kept", "d")
    where = spark.sql("describe formatted days_kept").where("col_name = 'Location'").first().data_type.removeprefix("file:")
    files = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{where}/d=*/*.parquet")}
    before = files()
    dropped = sinks.drop_old_partitions(spark, "days_kept", "d", 7, "2024-01-28")
    assert dropped == [f"2024-01-{d:02}" for d in range(1, 21)]
    after = files()
    assert after == {f: t for f, t in before.items() if f.split("/d=")[1][:10] not in dropped}
    assert spark.table("days_kept").where("d is not null").agg(F.min("d"), F.count("*")).first()[1] == 24
    assert sinks.drop_old_partitions(spark, "days_kept", "d", 7, "2024-01-28") == []
    spark.sql("drop table days_kept")


@pytest.mark.parametrize("limit", [1, 3, 12])
def test_search_by_profiles(spark, limit):
    rng = random.Random(9)
    words = ["sql", "Python", "c++", "go", "r", "spark", "java", "scala"]
    # sql is common, scala rare
    text = lambda: rng.choice([None, "", " ".join(w for i, w in enumerate(words) if rng.random() < 0.9 / (i + 1))])
    jobs = [(f"u{i}", text(), text(), text(), rng.choice([None, "CPT", "OPT", "H-1B"]), rng.choice([None, 1, 2, 300, 900])) for i in range(150)]
    profiles = [
        (i, rng.choice([None, [], [rng.choice([*words, " SQL ", "", None, "cobol"]) for _ in range(rng.randint(1, 5))]]),
         rng.choice([None, [], ["CPT", None], ["OPT", "H-1B"], ["CPT", "CPT", "OPT"]]))
        for i in range(80)
    ]
    profiles += profiles[:3]
    df = spark.createDataFrame(jobs, "url string, title string, description string, qualifications string, visa_category string, days_since_posted int")
    asked = spark.createDataFrame(profiles, "profile long, terms array<string>, visas array<string>")
    want = []
    for p, terms, visas in profiles:
        wanted = {t.strip().lower() for t in terms or [] if t and t.strip()}
        scored = []
        for url, *texts, visa, days in jobs:
            if days is not None and days <= 400 and visa is not None and visa in (visas or []):
                score = sum(any(t in (x or "").lower() for x in texts) for t in wanted)
                if score or not wanted:
                    scored.append((-score, days, url))
        want += [(p, url, -score) for score, _, url in sorted(scored)[:limit]]
    assert rows_of(pr.search_by_profiles(df, asked, 400, limit)) == sorted(want, key=repr) and len(want) > 30
    assert pr.search_by_profiles(df.limit(0), asked, 400, limit).count() == pr.search_by_profiles(df, asked.limit(0), 400, limit).count() == 0


def test_profiles_that_share_a_query_are_answered_in_many_tasks(spark):
    jobs = spark.range(40).select(
        F.concat(F.lit("u"), "id").alias("url"), F.lit("sql").alias("title"), F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("string").alias("qualifications"), F.lit("OPT").alias("visa_category"), F.col("id").cast("int").alias("days_since_posted"),
    )
    profiles = spark.range(8000).repartition(8).select(F.col("id").alias("profile"), F.array(F.lit("SQL")).alias("terms"), F.array(F.lit("OPT")).alias("visas"))
    found = pr.search_by_profiles(jobs, profiles, 400, 5)
    tasks = found.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) > 4 and sum(r["count"] for r in tasks) == 40_000
    assert rows_of(found.groupBy("url").count()) == [(f"u{i}", 8000) for i in range(5)]


def test_feeds_and_exports_are_packed(spark, sf_dir, monkeypatch, tmp_path):
    """Rows landed as JSON and CSV are compressed, and come back whole."""
    from __spark_entry__ import queries
    from jobweave.plans import q_sources

    places = []
    monkeypatch.setattr(q_sources, "new_path", lambda spark, label: places.append(str(tmp_path / label)) or places[-1])
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    for name in ("read_scraped_lines", "read_scraped_json", "write_outputs"):
        assert queries()[name](spark, sf_dir).count() == n
    files = [f for p in places for f in glob.glob(f"{p}/**/part-*", recursive=True)]
    assert files and all(f.endswith(".gz") for f in files)
