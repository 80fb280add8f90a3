"""Winnowing and k-d tree shards."""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from jobweave.llm import winnowing
from jobweave.llm.kdshards import kd_shards
from jobweave.llm.winnowing import decontaminate


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute_hits(documents, items, window):
    sequences = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(len(w), window)
        for p in range(len(w) - n + 1) if w and item is not None else []:
            sequences[tuple(w[p : p + n])].add(str(item))
    out = []
    for doc, text in documents:
        w, hit, found = words(text), set(), set()
        for n in {len(s) for s in sequences}:
            for p in range(len(w) - n + 1):
                s = tuple(w[p : p + n])
                if s in sequences:
                    hit |= set(range(p, p + n))
                    found |= sequences[s]
        out.append((doc, len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def benchmark_case(seed):
    rng = random.Random(seed)
    vocabulary = ["der", "Die", "été", "x1", "foo", "bar", "1", "ÉTÉ"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 13, 20, 40])))) for i in range(12)]
    items += [(50, None), (51, ""), (None, "der Die été"), (3, items[5][1]), (100, items[5][1])]
    documents = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            source = rng.choice(items)[1] or ""
            cut = source.split()
            a = rng.randint(0, len(cut))
            parts.append(rng.choice([source, " ".join(cut[a:]), "; ".join(rng.choice(vocabulary) for _ in range(30))]))
        documents.append((i, rng.choice([" ", "\n--", ", "]).join(parts)))
    documents += [(70, None), (71, ""), (None, documents[3][1]), documents[4], (5, "der der der der der")]
    return documents, items


@pytest.mark.parametrize(("seed", "limit"), [(1, 10**6), (2, 0)])
def test_winnowing(spark, monkeypatch, seed, limit):
    monkeypatch.setattr(winnowing, "BROADCAST_ROWS", limit)
    documents, items = benchmark_case(seed)
    docs = spark.createDataFrame(documents, "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("item_id", F.lit(2))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("length", F.lit(0))
    got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in decontaminate(docs, bench).collect()]
    assert sorted(got, key=repr) == brute_hits(documents, items, 13)


def test_winnowing_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in decontaminate(docs, none).drop("mark").collect()] == [(1, 2, 0, [], False)]
    assert decontaminate(docs.limit(0), none).count() == 0


def test_winnowing_of_long_texts(spark):
    """Item and document of many words, equal and not: no row carries more than a window or one text."""
    words = [f"w{i * 7919 % 30011}" for i in range(40_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[::-1])), (3, " ".join(words[5:40]))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "none of these")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in decontaminate(docs, bench).collect()}
    assert got == {1: (40_000, 40_000, ["1"], True), 2: (40_000, 0, [], False), 3: (35, 35, ["1"], True)}


def check_shards(rows, got, shards):
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == sorted(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows if i is not None
    )
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    slots = defaultdict(list)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(sizes) <= set(range(shards))
    return sizes


def test_shards_of_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = kd_shards(docs, 8).collect()
    sizes = check_shards(rows, got, 8)
    assert max(sizes.values()) - min(sizes.values()) <= 0.06 * sum(sizes.values()) / 8
    homes = defaultdict(set)
    for r in got:
        homes[r.size, r.text_crc32].add(r.shard)
    assert all(len(h) == 1 for h in homes.values())


def test_shards_with_a_large_group(spark):
    rng = random.Random(5)
    rows = [(i, "copy of one text " * 3) for i in range(700)]
    rows += [(i, "z" * rng.randint(0, 60)) for i in range(700, 2000)] + [(None, None), (None, "x"), (2000, ""), (2000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("x"))
    for shards in (1, 5, 8):
        sizes = check_shards(rows, kd_shards(docs, shards).collect(), shards)
        assert max(sizes.values()) - min(sizes.values()) <= 0.2 * sum(sizes.values()) / shards


def test_shards_of_nothing(spark):
    assert kd_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert len({r.shard for r in kd_shards(spark.createDataFrame([(1, None)] * 9, "doc_id long, text string")).collect()}) <= 8


def test_toxicity_learns_in_bounded_memory():
    import random
    import tracemalloc

    from jobweave.llm import toxicity

    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(5000)]
    texts = [" ".join(rng.choices(words, k=500)).encode() for _ in range(600)]
    tracemalloc.start()
    try:
        part = toxicity.ordinary_part(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert 0 < len(part) <= toxicity.DICTIONARY
    # one array of 8 bytes a stretch in place, and what is counted of it
    assert peak < 30 * sum(map(len, texts))
