"""Repeated spans of words and bytes against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobweave.llm import grams, suffixes
from jobweave.llm.debruijn import remove_repeated_spans
from jobweave.llm.suffixes import deep_shallow, remove_later_copies
from tests.llm import brute


def corpus(seed: int, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = ["a", "bé", "c", "dd", "É", "x" * 9]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            kind = rng.random()
            if kind < 0.4:
                parts.append(rng.choice(passages))
            elif kind < 0.5:
                parts.append(" ".join(["be"] * rng.randint(1, 50)))
            elif kind < 0.6:
                parts.append("ab c " * rng.randint(1, 30))
            else:
                parts.append(" ".join(rng.choice("qwertzuiop") + rng.choice("asdf") for _ in range(rng.randint(1, 40))))
        rows.append((i, rng.choice([" ", "\n", "\t  "]).join(parts)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n "), (None, rows[3][1]), (n + 3, rows[4][1]), rows[5]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("span", "gram"), [(12, 5), (8, 8)])
def test_words(spark, span, gram):
    rows = corpus(span)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("n_words", F.lit("x"))
    got = [
        (r.doc_id, r.n_words, r.n_removed, r.kept.encode())
        for r in remove_repeated_spans(df.repartition(5), span, gram).collect()
    ]
    assert sorted(got, key=repr) == sorted(brute.spans_removed(rows, span), key=repr)


@pytest.mark.parametrize(("span", "gram", "together"), [(30, 8, 512), (30, 8, 3), (12, 12, 512)])
def test_bytes(spark, monkeypatch, span, gram, together):
    monkeypatch.setattr(suffixes, "TOGETHER", together)
    rows = corpus(span)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gram", F.lit(1))
    got = [
        (r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept))
        for r in remove_later_copies(df.repartition(5), span, gram).collect()
    ]
    assert sorted(got, key=repr) == sorted(brute.copies_removed(rows, span), key=repr)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeated_spans(none).count() == 0
    assert remove_later_copies(none).count() == 0


@pytest.mark.parametrize("block", [64, 300])
def test_long_documents_in_pieces(spark, monkeypatch, block):
    rng = random.Random(block)
    shared = " ".join(str(rng.randint(0, 999)) for _ in range(80))
    rows = [(i, f"{'zz ' * 3}{rng.random()} {shared} {' '.join(str(rng.random()) for _ in range(20))}") for i in range(3)]
    rows[2] = (2, rows[2][1] + "y" * 500 + " " + shared)
    monkeypatch.setattr(grams, "BLOCK", block)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept.encode()) for r in remove_repeated_spans(df).collect()]
    assert sorted(got) == sorted(brute.spans_removed(rows, 35))
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in remove_later_copies(df).collect()]
    assert sorted(got) == sorted(brute.copies_removed(rows, 100))


def test_deep_shallow_sorts():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 3, (400, 30), dtype=np.uint8)
    rows[100:300, :20] = rows[7, :20]
    rows[200:220] = rows[8]
    group = rng.integers(0, 4, 400)
    order, common = deep_shallow(rows, group, 8)
    keys = [(group[i], rows[i].tobytes()) for i in order]
    assert keys == sorted(keys)
    for a, b, c in zip(order, order[1:], common[1:], strict=False):
        if group[a] != group[b]:
            assert c == -1
        else:
            equal = rows[a] == rows[b]
            assert c == (30 if equal.all() else int(np.argmin(equal)))
