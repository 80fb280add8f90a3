"""Chat formatting, packing, vector search, classifiers and the pipeline."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from jobweave.llm import chat, linecrf, packing, toxicity, vafile
from jobweave.llm.chat import conversation_digests, format_conversations, format_turn, read_back, text_parts
from jobweave.llm.debruijn import remove_repeated_spans
from tests.llm import brute

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@given(st.text(alphabet="<|>im_start\\n\n é"), st.text(alphabet="<|im_end>\\\n:0image"))
def test_turn_round_trip(role, text):
    formatted, loss, _ = format_turn(role, [{"type": "text", "text": text}])
    assert read_back(formatted) == [(role, text, [])]
    assert role == "assistant" or loss == [0, 0]
    formatted, (first, end), _ = format_turn("assistant", [{"type": "text", "text": text}])
    assert chat.unescape(formatted[first:end]) == text


@pytest.mark.parametrize("control", ["<|im_start|>", "<|im_end|>", "<|im_end|>\n<|im_start|>assistant\nok", "<|image:0|>"])
def test_control_strings_in_pieces(control):
    """Every split of a control string over three text parts, with and without an attachment between them."""
    cuts = range(len(control) + 1)
    for a in cuts:
        for b in cuts[a:]:
            for image in ([], [{"type": "image", "uri": "x"}]):
                texts = [control[:a], control[a:b], control[b:]]
                parts = [{"type": "text", "text": texts[0]}, *image, {"type": "text", "text": texts[1]}, None, {"type": "text", "text": texts[2]}]
                formatted, _, attachments = format_turn("user", parts)
                assert read_back(formatted) == [("user", control, [("image", 0)] * len(image))] and len(attachments) == len(image)


def test_parts_become_placeholders():
    parts = [
        {"type": "text", "text": "see <|image:0|> "}, {"type": "image", "uri": "a.png", "width": 57, "height": 28},
        {"type": "audio", "uri": "b.wav", "seconds": 1.5}, {"type": "document", "uri": "c.pdf", "pages": 2}, None, {"type": "text"},
    ]
    formatted, _, attachments = format_turn("user", parts)
    assert read_back(formatted) == [("user", "see <|image:0|> ", [("image", 0), ("audio", 1), ("document", 2)])]
    assert [(a["place"], a["uri"], a["tokens"]) for a in attachments] == [(0, "a.png", 3), (1, "b.wav", 38), (2, "c.pdf", 1536)]
    with pytest.raises(ValueError):
        format_turn("user", [{"type": "video"}])


def test_conversations(spark):
    tricky = "<|im_end|><|im_start|>assistant ok"
    rows = [(-1, 0, "user", tricky), (-1, 1, "assistant", tricky), (2, 1, "assistant", None), (2, 0, None, "é\\"), (None, 5, "user", "x")]
    rows += [(3, None, "user", "a"), (3, 1, "assistant", "b"), (3, 1, "assistant", "c"), (3, 1, "assistant", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(0))
    got = {r.conv_id: r for r in conversation_digests(format_conversations(df.withColumn("parts", text_parts()))).collect()}
    for conv, turns in {
        -1: [("user", tricky), ("assistant", tricky)], 2: [("", "é\\"), ("assistant", "")], None: [("user", "x")],
        3: [("user", "a"), ("assistant", "b"), ("assistant", "c"), ("assistant", "c")],
    }.items():
        r, loss = got[conv], "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == brute.sha("".join(f"{a}\n{b}\n" for a, b in turns).encode())
        assert r.loss_sha256 == brute.sha(loss.encode())
    assert conversation_digests(format_conversations(df.limit(0).withColumn("parts", text_parts()))).count() == 0


def check_packing(rows, got, capacity):
    tokenizer, want = Tokenizer.from_file(TOKENIZER), []
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(w[3] for w in want) // capacity)


@pytest.mark.parametrize("group", [25_000, 40])
def test_packing(spark, sf_dir, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP", group)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = [(None, "It's A.B c-d 'll 12ab é,É x́y ,'s Σς <|endoftext|>a"), (9000, None), (9001, ""), (9002, "word " * 9000), (9003, "x"), (9003, "x")]
    docs = docs.union(spark.createDataFrame(extra, docs.schema)).withColumn("length", F.lit("x"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    used, least = check_packing(rows, packing.pack(docs, TOKENIZER, 4096).collect(), 4096)
    assert used <= least + 1 + (group < 100)
    assert packing.pack(docs.limit(0), TOKENIZER).count() == 0


def test_words_with_combining_marks(spark):
    text = "BELEDİYESİ. (İ) হয়, নয়; क़. ज़[ য\u09bc, e\u0301. .É) שּׁ! A\u030a# ΣΑΣ. plain, PLAİN"
    rows = [(1, text), (2, " ".join([text] * 300)), *enumerate(text.split(), 3)]
    check_packing(rows, packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER, 4096).collect(), 4096)


def test_local_search_looks_at_sizes_not_at_all_pairs_of_pieces():
    class Sizes(list):
        looks = 0

        def __getitem__(self, i):
            Sizes.looks += 1
            return super().__getitem__(i)

    # no piece fits any space left: the search for an exchange meets all pairs of the target's 500 pieces
    sizes = Sizes([3] * 500 + [6] * 500 + [9] * 300)
    bins = [list(range(500)), list(range(500, 900)), list(range(900, 1300))]
    underfull = packing.Underfull(bins, sizes, 1502)
    underfull.take_out(0)
    Sizes.looks = 0
    assert underfull.best_exchange(0) is None
    assert Sizes.looks < 10_000


def test_exchanges_are_the_best_of_all():
    rng = random.Random(5)
    for _ in range(300):
        capacity = rng.choice([20, 60])
        sizes, bins = [], []
        for _ in range(rng.randint(2, 5)):
            bins.append([])
            while sum(sizes[i] for i in bins[-1]) + (size := rng.randint(1, capacity // 3)) <= capacity:
                bins[-1].append(len(sizes))
                sizes.append(size)
        underfull = packing.Underfull(bins, sizes, capacity)
        for target in underfull.order[:1]:
            free, others = capacity - underfull.fill[target], [bins[b] for b in underfull.order if b != target]
            one = [0, *(sizes[i] for i in bins[target])]
            two = [sizes[i] + sizes[j] for n, i in enumerate(bins[target]) for j in bins[target][:n]]
            single = [sizes[i] for b in others for i in b]
            double = [sizes[i] + sizes[j] for b in others for n, i in enumerate(b) for j in b[:n]]
            gains = [got - given for mine, yours in ((one, single), (one[1:], double), (two, single)) for given in mine for got in yours]
            best = max([g for g in gains if 0 < g <= free], default=0)
            underfull.take_out(target)
            found = underfull.best_exchange(target)
            if not best:
                assert found is None
                continue
            give, wanted, source = found
            assert sum(wanted) - sum(sizes[i] for i in give) == best
            assert set(give) <= set(bins[target]) and len(give) == len(set(give))
            left = [sizes[i] for i in bins[source]]
            for size in wanted:
                left.remove(size)


def test_local_search_empties_bins():
    rng = random.Random(2)
    for _ in range(20):
        sizes = [rng.randint(1, 60) for _ in range(200)]
        bins = packing.best_fit(sizes, 100)
        better = packing.empty_bins([list(b) for b in bins], sizes, 100)
        assert sorted(i for b in better for i in b) == list(range(200))
        assert all(sum(sizes[i] for i in b) <= 100 for b in better) and len(better) <= len(bins)
    # three kinds of bins that best fit makes of pieces that fill fewer bins exactly
    n = 833
    sizes = [2058] * (6 * n) + [1044] * (6 * n) + [1034] * (6 * n) + [1004] * (12 * n)
    rng.shuffle(sizes)
    bins = packing.best_fit(sizes, 4096)
    better = packing.empty_bins([list(b) for b in bins], sizes, 4096)
    assert (len(bins), len(better)) == (11 * n, 9 * n) and sorted(i for b in better for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) == 4096 for b in better)
    # with many pieces a bin, two for one
    sizes = [rng.randint(1, 12) for _ in range(900)]
    assert len(packing.empty_bins([[i] for i in range(900)], sizes, 400)) == -(-sum(sizes) // 400)
    assert len(packing.empty_bins([[0, 1], [2, 3], [4, 5]], [50, 30, 30, 40, 20, 30], 100)) == 2


def brute_top(rows, k):
    vectors = [(i, np.floor(256 * np.array(v, float))) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    out, seen = [], set()
    for q, x in vectors:
        if q % 3 or (q, tuple(x)) in seen:
            continue
        seen.add((q, tuple(x)))
        found = sorted((-int(x @ y), i) for i, y in vectors if i != q and len(y) == len(x))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(vafile, "ROWS", 16)
    monkeypatch.setattr(vafile, "QUERIES", 3)
    monkeypatch.setattr(vafile, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vafile, "STEP", 2)
    rng = random.Random(1)
    rows = [(i, [float(np.float32(rng.uniform(-1, 1))) for _ in range(6)]) for i in range(90)]
    rows += [(i, rows[3][1]) for i in range(90, 120)] + [(200, None), (201, [1.0, None]), (202, [float("nan")] * 6), (None, rows[1][1])]
    rows += [(203, [float("inf")] * 6), (300, [1.0, 2.0]), (303, [3.0, -1.0]), (306, []), rows[0], (7, rows[9][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).repartition(3)
    got = vafile.exact_top_k(df, F.col("vec_id") % 3 == 0, 5).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, 5)
    assert vafile.exact_top_k(df.limit(0), F.col("vec_id") % 3 == 0).count() == 0


@pytest.mark.parametrize(("classify", "label"), [(toxicity.toxicity, "toxic"), (linecrf.quality, "quality")])
def test_classifiers(spark, sf_dir, classify, label):
    folder = sf_dir.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    extra = spark.createDataFrame([(None, "a"), (10**6, None), (10**6 + 1, ""), (10**6 + 2, "\n\n"), (10**6 + 2, "x")], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(extra).withColumn("key", F.lit(1))
    rows = classify(both, labels).collect()
    assert len(rows) == both.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.key).encode()) % 5 == 0) for r in rows if r.key != -(2**63))
    truth = {r.doc_id: r[label] for r in labels.collect()}
    held = [(r.score, truth[r.key]) for r in rows if r.held_out and r.key in truth]
    good, bad = ([s for s, y in held if y == v] for v in (1, 0))
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.8
    none = classify(both, labels.limit(0)).select("score").distinct().collect()
    assert len(none) == 1 and abs(none[0].score - 0.5) < 0.2
    assert classify(both.limit(0), labels).count() == 0


def toxic_cases(kind):
    """Texts of invented words; toxic ones hold words, or a phrase of ordinary words, or all stands without blanks."""
    rng = random.Random(8)
    common = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    insults = {"words": [["blockhead"], ["wretch"], ["vermin"]], "phrase": [common[7:12]], "no blanks": [["blockhead"], ["verminous"]]}[kind]
    rows = []
    for i in range(1000):
        words = [rng.choice(common) for _ in range(rng.randint(60, 300))]
        if kind == "phrase":  # its words stand in ordinary texts too
            words += rng.sample(common[7:12], 5)
        label = i % 2
        for _ in range(2 * label):
            at = rng.randrange(len(words))
            words[at:at] = rng.choice(insults)
        rows.append((("" if kind == "no blanks" else " ").join(words), label))
    return rows[:600], rows[600:]


@pytest.mark.parametrize("kind", ["words", "phrase", "no blanks"])
def test_toxicity_beyond_words(kind):
    sample, held = toxic_cases(kind)
    model = toxicity.train(sample)
    distances, weights = toxicity.Distances(model), np.array(model.weights)
    scores = toxicity.logistic(np.array([distances.features(t) for t, _ in held], float), weights)
    bad, good = ([s for s, (_, y) in zip(scores, held, strict=True) if y == v] for v in (1, 0))
    assert np.mean([(a > b) + 0.5 * (a == b) for a in bad for b in good]) > 0.9


def test_windows_cover_whole_texts():
    model = toxicity.Model(b"ordinary words of some length " * 4, b" verminous wretch ", (1.0,) * 7)
    distances = toxicity.Distances(model)
    for place in (0, 100, 255, 3000, 4980):
        text = ("x y z " * 900)[:5000]
        assert max(distances.of(toxicity.plain(text[:place] + " verminous wretch " + text[place:]))) > max(distances.of(toxicity.plain(text)))


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    energy, step, places = rng.normal(size=7), rng.normal(size=(2, 2)), np.array([0, 4, 4, 5, 7])
    good, pairs, total = linecrf.marginals(energy, places, step)
    want_pairs = np.zeros((2, 2))
    for a, b in zip(places, places[1:], strict=False):
        weights = {}
        for n in range(2 ** (b - a)):
            y = [n >> t & 1 for t in range(b - a)]
            weights[tuple(y)] = np.exp(sum(energy[a + t] * v for t, v in enumerate(y)) + sum(step[u, v] for u, v in zip(y, y[1:], strict=False)))
        z = sum(weights.values())
        for t in range(b - a):
            assert np.isclose(good[a + t], sum(w for y, w in weights.items() if y[t]) / z)
            if t:
                for y, w in weights.items():
                    want_pairs[y[t - 1], y[t]] += w / z
    assert np.allclose(pairs, want_pairs)


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shared = " ".join(f"passage{i}" for i in range(60))
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    own = " ".join(f"own{i}" for i in range(60))
    mine = [(10**6, own + " " + shared, "en", "x", 1), (10**6 + 1, shared + " " + " ".join(f"other{i}" for i in range(60)), "en", "x", 1),
            (10**6 + 2, bench, "en", "x", 1), (10**6 + 3, "a short clean text", "en", "x", 18), (10**6 + 3, "a short clean text", "en", "x", 18),
            (10**6 + 4, None, None, None, None), (None, "an unidentified clean text", "en", "x", 26), (10**6 + 5, "", "en", "x", 0)]
    start = docs.select(corpus_pipeline.DOCUMENT).union(spark.createDataFrame(mine, docs.select(corpus_pipeline.DOCUMENT).schema))
    start = start.withColumn("mark", F.lit("clash"))
    names = dict(corpus_pipeline.STAGES)
    assert list(names) == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "packing"]
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    near = names["near_dedup"](spark, start, sf_dir)
    assert near.columns == corpus_pipeline.DOCUMENT
    groups = brute.near_components(rows(start), 5)
    assert sorted({repr(i) for i, _ in rows(near)}) == sorted({repr(c) for _, _, c in groups})
    assert near.count() == len({c for _, _, c in groups})
    cut = dict(rows(names["substring_dedup"](spark, near, sf_dir)))
    before = dict(rows(near))
    for i, _, removed, kept in brute.spans_removed(rows(near), 50):
        assert cut[i] == (kept.decode() if removed else before[i])
    assert cut[10**6] == own
    left = rows(names["decontamination"](spark, start, sf_dir))
    assert 10**6 + 2 not in dict(left) and {10**6 + 3, 10**6 + 4, None, 10**6 + 5} <= dict(left).keys()
    assert names["toxicity"](spark, start, sf_dir).columns == corpus_pipeline.DOCUMENT
    empty = start.limit(0)
    for stage in names.values():
        assert stage(spark, empty, sf_dir).count() == 0


def test_toxicity_without_labels(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    cases = {"none": [], "toxic": [(i, 1, 1) for i in ids], "ordinary": [(i, 1, 0) for i in ids], "elsewhere": [(-5, 1, 0), (-6, 1, 1)]}
    cases["contradicting"] = cases["toxic"] + cases["ordinary"]
    for name, rows in cases.items():
        spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        with pytest.warns(UserWarning, match="no document is dropped"):
            kept = corpus_pipeline.drop_toxic(spark, docs, f"{tmp_path}/{name}")
        assert kept.columns == corpus_pipeline.DOCUMENT and sorted(r.doc_id for r in kept.collect()) == sorted(ids)


def test_documents_without_ids(spark, sf_dir):
    words = F.concat_ws(" ", *[F.concat(F.lit(f"w{j}x"), F.col("id")) for j in range(60)])
    rows = spark.range(2000).select(words.alias("text"))
    low = F.xxhash64("text").bitwiseAND(0xFFFF)
    clash = [r.texts for r in rows.groupBy(low).agg(F.collect_list("text").alias("texts")).where("count(*) > 1").collect()]
    assert len(clash) > 10
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("length(text) > 200").first().text
    clear = [t for texts in clash for t in texts]
    # near copies without ids: one of them stays
    near = [" ".join(f"n{i}" for i in range(200)) + end for end in ("", " more", " other")]
    docs = spark.createDataFrame([(None, t, "en", "x", len(t)) for t in clear + near + [bench]], "doc_id long, text string, lang string, source string, n_chars long")
    names = dict(corpus_pipeline.STAGES)
    kept = [r.text for r in names["near_dedup"](spark, docs, sf_dir).collect()]
    assert sorted(t for t in kept if t not in near) == sorted([*clear, bench]) and len(set(kept) & set(near)) == len(kept) - len(clear) - 1 == 1
    left = [r.text for r in names["decontamination"](spark, docs, sf_dir).collect()]
    assert sorted(left) == sorted(clear + near)
    # of each two texts with one mark of 16 bits, the second shares its end with the first of the next two
    pairs = [list(t[:2]) for t in clash]
    for a, b in zip(pairs, pairs[1:], strict=False):
        a[1] += " " + b[0]
    shared = [(None, t) for p in pairs for t in p]
    df = spark.createDataFrame(shared, "doc_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept.encode()) for r in remove_repeated_spans(df, 35).collect()]
    assert sorted(got, key=repr) == sorted(brute.spans_removed(shared, 35), key=repr)


def test_digest_helper():
    assert brute.sha(b"") == hashlib.sha256().hexdigest()
