"""License rules against a version that tries every rule on every text and compares all places."""

from __future__ import annotations

import random
import re

from jobweave.llm.licenses import BASE, Rule, Scanner, license_rules, scan_licenses

SCHEMA = "doc_id long, text string"
RULES = license_rules()


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def fits(pattern, words, at):
    """The ends of the pattern's matches at a word, the longest choice first."""
    if not pattern:
        return [at]
    item, rest = pattern[0], pattern[1:]
    optional, options = item.endswith("?"), item.rstrip("?").split("|")
    out = fits(rest, words, at + 1) if at < len(words) and words[at] in options else []
    return out + (fits(rest, words, at) if optional else [])


def plain_scan(text, rules=RULES):
    words, places = plain_words(text), []
    for number, rule in enumerate(rules):
        at = 0
        while at < len(words):
            ends = fits(rule.pattern.split(), words, at)
            if ends:
                places.append((at, ends[0], number))
            at = ends[0] if ends else at + 1

    def suppressed(p):
        first, end, number = p
        for a, b, other in places:
            better = rules[other].rank < rules[number].rank or rules[other].rank == rules[number].rank and ((b - a) > (end - first) or other < number)
            if other != number and better and a <= first and end <= b and not (a, b) == (first, end) or other < number and (a, b) == (first, end) and rules[other].rank <= rules[number].rank:
                return True
        return False

    kept = [p for p in places if rules[p[2]].base or not suppressed(p)]
    return words, sorted(kept, key=lambda p: (p[0], -p[1], rules[p[2]].rank, p[2]))


def cases():
    rng = random.Random(3)
    out = [
        "", None, "   ", "MIT License", "mit license mit license MIT-License", "The Apache License, Version 2.0", "SPDX-License-Identifier: GPL-2.0-or-later",
        "licensed under CC BY-NC 4.0 or CC BY", "gnu general public license version 3", "GNU GENERAL\nPUBLIC... license", "éMIT license", "mit licensed",
        "https://opensource.org/licenses/MIT", "see LICENSE.md for details", "© Copyright 2020 All rights reserved", "gplv3", "admit license",
    ]
    fragments = [r.pattern.replace("?", "").replace("|", " ").split() for r in RULES]
    for _ in range(250):
        words = []
        for _ in range(rng.randrange(1, 6)):
            part = list(rng.choice(fragments))
            if rng.random() < 0.3:
                part.pop(rng.randrange(len(part)))
            words += part + ["ööm"] * rng.randrange(2)
        out.append(rng.choice([" ", "-", ", ", "\n"]).join(w.upper() if rng.random() < 0.2 else w for w in words))
    return out


def test_rules():
    assert len(RULES) > 300 and [r for r in RULES if r.base] == [Rule(label, p, 0, 0.9, True) for label, p in BASE]
    assert len({(r.label, r.pattern, r.rank) for r in RULES}) == len(RULES)
    scanner = Scanner(RULES)
    for rule in RULES:  # each is found in its own words, gate and all
        words = [x.rstrip("?").split("|")[0].encode() for x in rule.pattern.split()]
        assert any(RULES[n] is rule for _, _, n in scanner.places(words)), rule


def test_scan(spark):
    rows = [(None if i % 9 == 1 else i // 2, t) for i, t in enumerate(cases())]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], f"{SCHEMA}, labels string, score double")
    expected = []
    for i, t in rows:
        words, kept = plain_scan(t)
        weights = {}
        for _, _, n in kept:
            weights[RULES[n].label] = max(weights.get(RULES[n].label, 0), RULES[n].weight)
        doubt = 1.0
        for label in sorted(weights):
            doubt *= 1 - weights[label]
        expected.append((i, len(words), [(RULES[n].label, a, b, RULES[n].base) for a, b, n in kept], sorted(weights), 1 - doubt))
    got = [(r.doc_id, r.n_words, [(x.label, x.first, x.end, x.base) for x in r.found], list(r.labels), r.score) for r in scan_licenses(df).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert sum(bool(x[2]) for x in got) > 200


def test_base_columns(spark, sf_dir):
    from __spark_entry__ import queries

    got = {r.doc_id: r for r in queries()["op13_license_signatures"](spark, sf_dir).collect()}
    n_base = 0
    for doc_id, text in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        words, row = plain_words(text), got[doc_id]
        places = [(i, label) for label, p in BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in places]
        n_base += len(places)
        assert (row.n_words, row.n_base, row.first_word, row.last_word) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        assert row.base_labels == ",".join(sorted({x for _, x in places})) and set(row.base_labels.split(",")) <= {*row.labels.split(","), ""}
        assert 0 <= row.score <= 1
    assert n_base


def test_own_rules_and_long_texts(spark):
    rules = [Rule("one", "a b", 1, 0.5), Rule("two", "a b c", 2, 0.5), Rule("three", "b|x c", 2, 0.5)]
    text = "a b c " * 50_000
    row = scan_licenses(spark.createDataFrame([(1, text)], SCHEMA), rules).collect()[0]
    assert row.n_words == 150_000 and len(row.found) == 100_000 and list(row.labels) == ["one", "two"] and row.score == 0.75


def test_scan_of_nothing(spark):
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).collect() == []
