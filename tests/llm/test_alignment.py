"""Alignment of two tokenizers against a plain version that tokenizes whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from jobweave.llm import alignment
from jobweave.llm.alignment import align_tokenizers, byte_of_letter

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"


class Plain:
    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        self.letters = byte_of_letter()

    def tokens(self, text):
        if not text:
            return [], []
        a = self.a.encode(f" {text}", add_special_tokens=False).ids
        b = self.b.encode(text)
        a = [(i, bytes(self.letters[c] for c in self.a.id_to_token(i))) for i in a]
        pieces = [(i, self.b.id_to_piece(i)) for i in b]
        b = [(i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces]
        raw = f" {text}".encode()
        return (a, b) if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else ([], [])

    def rows(self, documents):
        links, out = [], []
        for i, text in documents:
            a, b = self.tokens(text)
            ranges = []
            for tokens in (a, b):
                at, mine = 0, []
                for t, x in tokens:
                    mine.append((t, at, at + len(x)))
                    at += len(x)
                ranges.append(mine)
            links.append([(x, y) for x, s, e in ranges[0] for y, p, q in ranges[1] if s < q and p < e])
            cuts = sorted({e for *_, e in ranges[0]} & {e for *_, e in ranges[1]})
            groups, low = [], 0
            for cut in cuts:
                groups.append("|".join(",".join(str(t) for t, s, e in r if low <= s and e <= cut) for r in ranges))
                low = cut
            out.append([i, len(a), len(b), len(groups), len(links[-1]), ";".join(groups)])
        held = Counter(p for x in links for p in set(x))
        best = Counter()
        for (x, _), n in held.items():
            best[x] = max(best[x], n)
        return [
            (i, n_a, n_b, n, m, sum(held[p] == best[p[0]] for p in x), sum(held[p] for p in x), hashlib.sha256(g.encode()).hexdigest() if g else "", g)
            for (i, n_a, n_b, n, m, g), x in zip(out, links, strict=True)
        ]


def texts():
    rng = random.Random(5)
    words = ["the", "naïve", "Straße", "don't", "it's", "日本語テキスト", "😀👍🏽", "x" * 300, "3.14159", "<|endoftext|>", "<s>", "</s>", "<0x41>", "<unk>", "é", "ﷺ", "a\x00b", "﻿", "İstanbul", "हिन्दी"]
    gaps = [" ", "  ", "\n", "\n\n", " \n ", "   ", "\n "]
    odd = ["\t", "\r\n", " ", " ", "\u0085", "\x1c", "\x0b"]
    out = ["", None, " ", "\n", "  ", "a", " a", "a ", "\na", "▁", "a▁b c", "\t", " \n b", "a\r\n b", "x  y   z", "end\n\n"]
    for i in range(120):
        use = gaps + odd if i % 3 == 0 else gaps
        out.append("".join(rng.choice(words) + rng.choice(use) for _ in range(rng.randrange(30))))
    out += ["the cat " * 700, "▁ the cat " * 300]
    return out


@pytest.mark.parametrize(("block", "lane"), [(1 << 21, 256), (300, 3)])
def test_alignment(spark, monkeypatch, block, lane):
    monkeypatch.setattr(alignment, "BLOCK", block)
    monkeypatch.setattr(alignment, "LANE", lane)
    documents = [(None if i % 17 == 3 else i // 2, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame([(*d, "x", 1) for d in documents], f"{SCHEMA}, pairs string, key int").repartition(3)
    got = align_tokenizers(df, A, B, with_groups=True).drop("mark").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(Plain().rows(documents), key=repr)


def test_words_forgotten(spark, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 1000)
    monkeypatch.setattr(alignment, "BLOCK", 200)
    documents = list(enumerate(texts()[:60]))
    got = align_tokenizers(spark.createDataFrame(documents, SCHEMA), A, B).drop("mark", "groups").collect()
    assert sorted(map(tuple, got), key=repr) == sorted((r[:-1] for r in Plain().rows(documents)), key=repr)


def test_alignment_of_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    got = align_tokenizers(spark.createDataFrame(rows, SCHEMA), A, B, with_groups=True).drop("mark").collect()
    assert sorted(map(tuple, got)) == sorted(Plain().rows(rows))


def test_alignment_of_nothing(spark):
    assert align_tokenizers(spark.createDataFrame([], SCHEMA), A, B).collect() == []
    rows = align_tokenizers(spark.createDataFrame([(1, None), (2, "")], SCHEMA), A, B).collect()
    assert [tuple(r)[1:8] for r in rows] == [(0, 0, 0, 0, 0, 0, "")] * 2
