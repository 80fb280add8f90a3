"""Periodic runs against a plain version."""

from __future__ import annotations

import random

from jobweave.llm.periodic import periodic_runs, runs_in

SCHEMA = "doc_id long, text string"


def plain_runs(words, shortest):
    """Every maximal stretch for every period; of those on one stretch the smallest period."""
    out, seen = [], set()
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(shortest, 2 * q) and (i, length) not in seen:
                seen.add((i, length))
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_numbers():
    rng = random.Random(11)
    for _ in range(800):
        size, shortest = rng.choice([1, 2, 3, 6]), rng.choice([2, 4, 12])
        text = [rng.randrange(1, size + 1) for _ in range(rng.randrange(70))]
        assert [tuple(map(int, r)) for r in runs_in(text, shortest)] == plain_runs(text, shortest)


def check(spark, rows, shortest=12):
    df = spark.createDataFrame([(*r, "x") for r in rows], f"{SCHEMA}, runs string").repartition(3)
    expected = []
    for i, t in rows:
        words = (t or "").encode().split()
        runs = plain_runs(words, shortest)
        expected.append((i, len(words), runs, plain_collapsed([w.decode() for w in words], runs)))
    found = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(df, shortest).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    return found


def test_runs_of_documents(spark):
    rng = random.Random(12)
    rows = [(None, None), (None, "a " * 30), (1, ""), (2, " \t\n"), (3, "ab " * 11), (4, "ab " * 12), (4, "ab " * 12), (5, "é ñ\x0bé ñ " * 9)]
    for i in range(60):
        words = [f"w{rng.randrange(rng.choice([2, 5, 200]))}" for _ in range(rng.randrange(120))]
        if words and i % 2:
            a = rng.randrange(len(words))
            p = 1 + (len(words) - a) // rng.randrange(2, 6)
            words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
        rows.append((10 + i, rng.choice([" ", "\n", "  "]).join(words)))
    found = check(spark, rows)
    assert sum(len(r[2]) for r in found) >= 20
    check(spark, rows, shortest=3)


def test_runs_of_long_documents(spark):
    rng = random.Random(13)
    line = " ".join(f"t{rng.randrange(50)}" for _ in range(40))
    long = " ".join(f"u{rng.randrange(10**6)}" for _ in range(60_000)) + " " + f"{line} " * 900
    found = periodic_runs(spark.createDataFrame([(1, long), (2, "z " * 50_000)], SCHEMA)).collect()
    rows = {r.doc_id: [tuple(x) for x in r.runs] for r in found}
    assert rows[1] == [(60_000, 36_000, 40)] or (len(rows[1]) > 1 and max(x[1] for x in rows[1]) >= 36_000)
    assert rows[2] == [(0, 50_000, 1)]


def test_runs_of_nothing(spark):
    assert periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []
