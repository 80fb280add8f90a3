"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from jobweave.llm import grams
from jobweave.llm.labelled import fit_logistic, logistic, training_sample
from jobweave.llm.store import keyed, returning_memory
from jobweave.llm.toxicity import held_out_key

#: Labelled documents to learn from, and the longest of them in characters.
SAMPLE_ROWS, SAMPLE_LONGEST = 4000, 30_000
ROUNDS = 150

#: Kinds of bytes counted in a line: capitals, digits, marks of punctuation, other signs, blanks, bytes beyond ASCII.
KINDS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'-()\"", b"!#$%&*+/<=>@[\\]^_`{|}~", b" \t\r\v\f", bytes(range(128, 256))]
KIND_OF = np.full(256, len(KINDS), np.int64)
for _i, _bytes in enumerate(KINDS):
    KIND_OF[list(_bytes)] = _i
FEATURES = len(KINDS) + 6


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and length in bytes of each line that is not blank, and the documents' offsets in lines."""
    breaks = data == 10
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[1:] |= breaks
    starts = np.flatnonzero(edge[:-1])
    ends = np.append(starts[1:], len(data))
    ends = ends - breaks[ends - 1] if len(starts) else ends
    word_start, word_end, (hashes,), _ = grams.words_of(data, np.unique(np.concatenate([offsets, starts])), hashes=1)
    first = np.searchsorted(word_start, starts)
    n_words = np.searchsorted(word_start, ends) - first
    keep = n_words > 0
    starts, ends, first, n_words = starts[keep], ends[keep], first[keep], n_words[keep]
    places = np.searchsorted(starts, offsets)
    n = len(starts)
    if not n:
        return np.zeros((0, FEATURES)), np.zeros(0), places
    out = np.empty((n, FEATURES))
    length = (ends - starts).astype(float)
    kinds = KIND_OF[data]
    line_of = np.cumsum(np.bincount(starts, minlength=len(data))[: len(data)]) - 1
    counted = np.bincount(line_of.clip(0) * (len(KINDS) + 1) + kinds, minlength=n * (len(KINDS) + 1))
    out[:, : len(KINDS)] = np.sqrt(counted.reshape(n, -1)[:, : len(KINDS)] / length[:, None]).clip(0, 1)
    line = np.repeat(np.arange(n), n_words)
    word = np.arange(len(line)) - np.repeat(np.cumsum(n_words) - n_words, n_words) + first[line]
    value = hashes[word]
    same = np.zeros(len(line))
    same[1:] = (value[1:] == value[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((value, line))
    new = np.ones(len(line), bool)
    new[1:] = (value[order][1:] != value[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order][new], minlength=n)
    sizes = (word_end - word_start)[word]
    base = len(KINDS)
    out[:, base] = np.log1p(length) / 8
    out[:, base + 1] = np.log1p(n_words) / 6
    out[:, base + 2] = np.bincount(line, same, minlength=n) / n_words
    out[:, base + 3] = 1 - distinct / n_words
    out[:, base + 4] = np.bincount(line, sizes, minlength=n) / n_words / 10
    out[:, base + 5] = np.bincount(line, sizes == 1, minlength=n) / n_words
    return out, length, places


def with_neighbours(features: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before and after it in its document (0 where there is none), and 1."""
    before, after = np.zeros_like(features), np.zeros_like(features)
    before[1:], after[:-1] = features[:-1], features[1:]
    inner = places[(places < len(features))]
    before[inner] = 0
    after[places[places > 0] - 1] = 0
    return np.column_stack([features, features**2, before, after, np.ones(len(features))])


@dataclass(frozen=True)
class Model:
    """Weights of a line's features for "good", of neighbours (rows: label of the first), and the calibration."""

    line: np.ndarray
    step: np.ndarray
    weights: np.ndarray


def marginals(energy: np.ndarray, places: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of "good" for each line, expected label pairs, and log of the partition sum, by forward-backward.

    ``energy`` is what a line's features add to "good" over "bad". All documents
    advance together, one line a round.
    """
    sizes = np.diff(places)
    order = np.argsort(-sizes, kind="stable")
    sizes, first = sizes[order], places[:-1][order]
    longest = int(sizes[0]) if len(sizes) else 0
    alpha = np.zeros((len(energy), 2))
    live = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(longest + 1)]  # documents with over t lines
    log_z = np.zeros(len(sizes))
    for t in range(longest):
        n = live[t]
        at = first[:n] + t
        if t == 0:
            a = np.zeros((n, 2))
        else:
            b = alpha[at - 1][:, :, None] + step[None]
            a = np.logaddexp(b[:, 0], b[:, 1])
        a[:, 1] += energy[at]
        alpha[at] = a
    ends = first + sizes - 1
    some = sizes > 0
    log_z[some] = np.logaddexp(alpha[ends[some], 0], alpha[ends[some], 1])
    total = np.zeros(len(sizes))
    total[order] = log_z
    beta = np.zeros((len(energy), 2))
    pairs = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        n = live[t + 1]
        at = first[:n] + t
        onward = beta[at + 1].copy()
        onward[:, 1] += energy[at + 1]
        b = step[None] + onward[:, None, :]
        pairs += np.exp(alpha[at][:, :, None] + b - log_z[:n, None, None]).sum(axis=0)
        beta[at] = np.logaddexp(b[:, :, 0], b[:, :, 1])
    both = alpha + beta
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -50, 50)))
    return good, pairs, total


def quality_of(good: np.ndarray, length: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the lines' marginals, as log odds; 0 without lines."""
    document = np.repeat(np.arange(len(places) - 1), np.diff(places))
    weight = np.bincount(document, length, minlength=len(places) - 1)
    mean = np.bincount(document, length * good, minlength=len(places) - 1)
    mean = np.divide(mean, weight, out=np.full(len(weight), 0.5), where=weight > 0).clip(1e-4, 1 - 1e-4)
    return np.log(mean / (1 - mean))


def blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    data, offsets = grams.text_bytes(column)
    for lo, hi in grams.groups_of(np.diff(offsets), 2 * grams.BLOCK):
        features, length, places = line_features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        yield with_neighbours(features, places), length, places, hi - lo


def train(sample: list[tuple[str, int]]) -> Model:
    """The field's weights by maximum likelihood, every line labelled as its document, then the calibration."""
    texts = pa.array([t for t, _ in sample], pa.string())
    labels = np.array([y for _, y in sample], float)
    parts = list(blocks(texts)) if len(sample) else []
    width = 4 * FEATURES + 1
    if not parts or not sum(len(p[0]) for p in parts) or labels.min() == labels.max():
        return Model(np.zeros(width), np.zeros((2, 2)), np.array([0.0, 4.0 * labels.mean() - 2.0 if len(labels) else 0.0]))
    x = np.concatenate([p[0] for p in parts])
    length = np.concatenate([p[1] for p in parts])
    sizes = np.concatenate([np.diff(p[2]) for p in parts])
    places = np.concatenate([[0], np.cumsum(sizes)])
    document = np.repeat(np.arange(len(sizes)), sizes)
    y = labels[document]
    inner = np.maximum(sizes - 1, 0)
    seen = np.array([[inner[labels == 0].sum(), 0.0], [0.0, inner[labels == 1].sum()]])
    line, step = np.zeros(width), np.zeros((2, 2))
    # lines of both kinds of documents weigh alike, or the rarer kind would be drowned
    share = {v: 0.5 / max(1, (labels == v).sum()) for v in (0.0, 1.0)}
    weight = np.array([share[v] for v in labels])
    moments = [np.zeros(width + 4), np.zeros(width + 4)]
    groups = [np.flatnonzero(labels == v) for v in (0.0, 1.0)]
    bounds = []
    for g in groups:
        rows = np.concatenate([np.arange(places[i], places[i + 1]) for i in g]) if len(g) else np.zeros(0, int)
        bounds.append((rows, np.concatenate([[0], np.cumsum(sizes[g])])))
    for k in range(1, ROUNDS + 1):
        by_line, by_pair = 1e-4 * line, 1e-4 * step
        for v, (rows, part) in enumerate(bounds):
            good, pairs, _ = marginals(x[rows] @ line, part, step)
            by_line = by_line + x[rows].T @ (good - y[rows]) * share[float(v)]
            target = np.zeros((2, 2))
            target[v, v] = seen[v, v]
            by_pair = by_pair + (pairs - target) * share[float(v)]
        gradient = np.concatenate([by_line, by_pair.ravel()])
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.99 * moments[1] + 0.01 * gradient**2
        move = 0.1 * (moments[0] / (1 - 0.9**k)) / (np.sqrt(moments[1] / (1 - 0.99**k)) + 1e-8)
        line, step = line - move[:width], step - move[width:].reshape(2, 2)
    good, _, _ = marginals(x @ line, places, step)
    weights = fit_logistic(quality_of(good, length, places)[:, None], labels, penalty=0.1)
    return Model(line, step, weights)


@returning_memory
def scores_of(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.zeros(0)]
        for x, length, places, _ in blocks(batch.column("text")):
            good, _, _ = marginals(x @ model.line, places, model.step)
            found.append(logistic(quality_of(good, length, places)[:, None], model.weights))
        others = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in others), pa.array(np.concatenate(found))], names=[*others, "score"]
        )


def quality(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, longest: int = SAMPLE_LONGEST) -> DataFrame:
    """key (doc_id, NO_ID for null), mark of the text, held_out and score of each document, one row per input row.

    Learnt from a bounded sample of ``labels.quality``; every whole text is
    scored. Blank lines don't count; a text without lines gets the score of even
    odds. Without labels of both kinds all documents get one score.
    """
    model = train(training_sample(documents, labels, "quality", rows, longest))
    out = keyed(documents).withColumn("held_out", held_out_key())
    return out.mapInArrow(lambda b: scores_of(b, model), "key long, mark long, held_out boolean, score double")
