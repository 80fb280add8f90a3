"""Near-duplicate groups against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from jobweave.llm import oddsketch
from jobweave.llm.oddsketch import near_duplicates
from tests.llm import brute


def corpus(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for base in range(14):
        words = [f"w{rng.randint(0, 300)}" for _ in range(rng.choice([3, 6, 30, 80, 200]))]
        for _ in range(rng.choice([1, 4, 12, 30])):
            copy = [w if rng.random() > rng.choice([0, 0.01, 0.03, 0.06]) else f"x{rng.randint(0, 99)}" for w in words]
            rows.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in copy))
    for _ in range(20):
        rows.append("same passage for all of us here " * 2 + " ".join(f"w{rng.randint(0, 300)}" for _ in range(20)))
    rows += [None, "", "  ", "A b", "a B", "a b c", "one"]
    rng.shuffle(rows)
    out = list(enumerate(rows))
    return [*out, (None, rows[0]), out[5], (3, "another text under an id that is taken already, of some words")]


@pytest.mark.parametrize(("seed", "left", "right"), [(1, 256, 2048), (2, 2, 3)])
def test_components(spark, monkeypatch, seed, left, right):
    monkeypatch.setattr(oddsketch, "LEFT", left)
    monkeypatch.setattr(oddsketch, "RIGHT", right)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x"))
    got = near_duplicates(df.repartition(4)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute.near_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_only_empty_texts(spark):
    got = near_duplicates(spark.createDataFrame([(2, None), (1, "")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute.near_components(rows)


def test_sketches_estimate_differences():
    import numpy as np

    rng = np.random.default_rng(3)
    shared = rng.integers(1, 2**63, 900, dtype=np.uint64)
    x = np.sort(np.concatenate([shared, rng.integers(1, 2**63, 100, dtype=np.uint64)]))
    y = np.sort(np.concatenate([shared, rng.integers(1, 2**63, 100, dtype=np.uint64)]))
    z = np.sort(rng.integers(1, 2**63, 1000, dtype=np.uint64))
    sets = np.concatenate([x, y, z])
    sketch = oddsketch.sketches_of(oddsketch.samples_of(sets, np.array([0, 1000, 2000, 3000])))
    near, far = (int(np.bitwise_count((sketch[0] ^ sketch[i]).view(np.uint64)).sum()) for i in (1, 2))
    assert near <= oddsketch.most_differing(0.8) < far
    assert oddsketch.band_rows(0.8) == 4
