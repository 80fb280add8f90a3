"""Plain versions of the operators' results, for tests."""

from __future__ import annotations

import hashlib
from collections import defaultdict


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def spans_removed(documents, span):
    """[(doc_id, n_words, n_removed, kept)] of rows (doc_id, text)."""
    seen = defaultdict(int)
    lists = [(i, (t or "").encode().split()) for i, t in documents]
    for _, words in lists:
        for p in range(len(words) - span + 1):
            seen[tuple(words[p : p + span])] += 1
    out = []
    for i, words in lists:
        gone = [False] * len(words)
        for p in range(len(words) - span + 1):
            if seen[tuple(words[p : p + span])] > 1:
                gone[p : p + span] = [True] * span
        kept = b" ".join(w for w, x in zip(words, gone, strict=True) if not x)
        out.append((i, len(words), sum(gone), kept))
    return out


def copies_removed(documents, span):
    """[(doc_id, n_bytes, n_removed, n_spans, kept)]; equal rows are one document."""
    order = sorted({(-(2**63) if i is None else i, (t or "").encode()) for i, t in documents})
    starts = {}
    for i, text in order:
        for p in range(len(text) - span + 1):
            at = (i, p)
            piece = text[p : p + span]
            if piece not in starts or at < starts[piece]:
                starts[piece] = at
    out = []
    for i, t in documents:
        text, key = (t or "").encode(), -(2**63) if i is None else i
        gone = bytearray(len(text))
        for p in range(len(text) - span + 1):
            if starts[text[p : p + span]] < (key, p):
                gone[p : p + span] = b"\1" * span
        runs = sum(1 for p in range(len(gone)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(text), sum(gone), runs, bytes(b for b, x in zip(text, gone, strict=True) if not x)))
    return out


def shingles_of(text, shingle):
    words = (text or "").encode()
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in words).split()
    if len(words) < shingle:
        return {tuple(words)} if words else set()
    return {tuple(words[p : p + shingle]) for p in range(len(words) - shingle + 1)}


def near_components(documents, shingle=4, percent=80):
    """{(doc_id, n_shingles, component_id)} of rows (doc_id, text), all pairs compared."""
    sets = [shingles_of(t, shingle) for _, t in documents]
    group = list(range(len(sets)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            common = len(x & sets[j])
            if common and 100 * common >= percent * (len(x) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                group[b] = a
    low = {}
    for i, (d, _) in enumerate(documents):
        low[root(i)] = min(low.get(root(i), (2**63, None)), (-(2**63) if d is None else d, d), key=lambda v: v[0])
    return sorted(((d, len(sets[i]), low[root(i)][1]) for i, (d, _) in enumerate(documents)), key=repr)
