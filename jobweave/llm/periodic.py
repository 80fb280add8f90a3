"""Periodic runs of words: suffix trees tell how far two places agree, Lyndon roots name the candidates.

A run is a stretch of words with a smallest period that repeats twice at least
and that no neighbouring word extends. Every run has a root that is the longest
Lyndon word at its place, for the words' order or its reverse; so two candidates
a place are enough. A candidate is extended to the right by the longest common
extension in the suffix tree of the words and to the left by that in the tree of
their reversal. Both are answered in constant time: the Euler tour of a tree,
kept as the lowest depth between neighbouring leaves, under a sparse table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm import grams
from jobweave.llm.store import id_of, keyed, returning_memory

SHORTEST = 12
RUN = "array<struct<start: long, length: long, period: long>>"


class SuffixTree:
    """Ukkonen's tree of a list of small numbers that ends with its only 0."""

    def __init__(self, text: list[int]):
        n, width = len(text), max(text) + 1
        first, stop, link, parent = [0], [0], [0], [0]
        edges: dict[int, int] = {}  # node * width + first symbol of the edge -> child
        node = edge = length = waiting = 0
        for i, symbol in enumerate(text):
            waiting += 1
            unlinked = 0
            while waiting:
                if not length:
                    edge = i
                child = edges.get(node * width + text[edge])
                if child is None:
                    edges[node * width + text[edge]] = len(first)
                    first.append(i)
                    stop.append(n)
                    link.append(0)
                    parent.append(node)
                    if unlinked:
                        link[unlinked] = node
                        unlinked = 0
                else:
                    begin = first[child]
                    whole = stop[child] - begin
                    if length >= whole:
                        edge += whole
                        length -= whole
                        node = child
                        continue
                    if text[begin + length] == symbol:
                        if unlinked and node:
                            link[unlinked] = node
                        length += 1
                        break
                    middle = len(first)
                    edges[node * width + text[edge]] = middle
                    edges[middle * width + symbol] = middle + 1
                    edges[middle * width + text[begin + length]] = child
                    first += (begin, i)
                    stop += (begin + length, n)
                    link += (0, 0)
                    parent += (node, middle)
                    first[child] = begin + length
                    parent[child] = middle
                    if unlinked:
                        link[unlinked] = middle
                    unlinked = middle
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        self.n = n
        self.size = np.array(stop) - np.array(first)
        self.parent = np.array(parent)
        self.symbol = np.array(text)[np.array(first)]
        self.leaf = np.array(stop) == n

    def leaves(self, reverse: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in the order of a tour, and the lowest depth between each and the one before.

        ``reverse`` turns the order of the symbols round, but for the 0 that stays first.
        """
        symbol = np.where(self.symbol > 0, self.symbol.max() + 1 - self.symbol, 0) if reverse else self.symbol
        by_parent = 1 + np.lexsort((-symbol[1:], self.parent[1:]))  # the last symbol first: a stack turns them round
        bounds = np.searchsorted(self.parent[by_parent], np.arange(len(self.parent) + 1)).tolist()
        eldest = np.ones(len(self.parent), bool)
        eldest[by_parent[:-1]] = self.parent[by_parent[1:]] != self.parent[by_parent[:-1]]
        children, eldest, size, parent, leaf = by_parent.tolist(), eldest.tolist(), self.size.tolist(), self.parent.tolist(), self.leaf.tolist()
        depth, low, order, lows = [0] * len(parent), 0, [], []
        stack = children[bounds[0] : bounds[1]]
        while stack:
            node = stack.pop()
            above = depth[parent[node]]
            depth[node] = above + size[node]
            if not eldest[node]:
                low = above
            if leaf[node]:
                order.append(self.n - depth[node])
                lows.append(low)
            else:
                stack += children[bounds[node] : bounds[node + 1]]
        return np.array(order), np.array(lows)


class CommonExtensions:
    """How many symbols the suffixes at two places share, for whole arrays of places."""

    def __init__(self, tree: SuffixTree):
        order, lows = tree.leaves()
        self.rank = np.empty(tree.n, np.int64)
        self.rank[order] = np.arange(tree.n)
        self.levels = [lows.astype(np.int32)]
        step = 1
        while 2 * step <= tree.n:
            below = self.levels[-1]
            self.levels.append(np.minimum(below[:-step], below[step:]))
            step *= 2

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.minimum(self.rank[a], self.rank[b]) + 1, np.maximum(self.rank[a], self.rank[b])
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.levels[k][low[at]], self.levels[k][high[at] + 1 - (1 << int(k))])
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller rank: the end of the longest Lyndon word there."""
    ranks, stack = rank.tolist(), []
    out = [0] * len(ranks)
    for i in range(len(ranks) - 1, -1, -1):
        mine = ranks[i]
        while stack and ranks[stack[-1]] > mine:
            stack.pop()
        out[i] = stack[-1] if stack else len(ranks)
        stack.append(i)
    return np.array(out)


def runs_in(text: list[int], shortest: int) -> np.ndarray:
    """Rows (start, length, period) of the runs in a list of numbers from 1, of ``shortest`` or more, by start and period."""
    n = len(text)
    if n < max(2, shortest):
        return np.zeros((0, 3), np.int64)
    tree = SuffixTree([*text, 0])
    ahead = CommonExtensions(tree)
    order, _ = tree.leaves(reverse=True)
    turned = np.empty(n + 1, np.int64)
    turned[order] = np.arange(n + 1)
    del tree
    behind = CommonExtensions(SuffixTree([*text[::-1], 0]))
    found = []
    for rank in (ahead.rank, turned):
        begin = np.arange(n)
        period = next_smaller(rank)[:n] - begin  # the 0 at place n is the smallest suffix
        right = ahead(begin, begin + period)
        left = behind(n - begin, n - begin - period)
        length = left + period + right
        keep = length >= np.maximum(shortest, 2 * period)
        found.append(np.stack([begin - left, length, period], axis=1)[keep])
    return np.unique(np.concatenate(found)[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def recurring(values: np.ndarray, places: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches [start, end) of words that can hold a run; every run lies within one of them.

    A run of ``shortest`` words or more has a word sequence of half that length
    at each of its places that recurs a period later or earlier, all within the run. So
    words under no sequence that recurs in the same stretch are in no run.
    """
    k = max(1, shortest // 2)
    n = len(values) - k + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none
    document = np.repeat(np.arange(len(places) - 1), np.diff(places))
    whole = np.flatnonzero(np.arange(n) + k <= places[document[:n] + 1])
    name = grams.gram_hashes(values, k, grams.MULTIPLIERS[2])[whole] + grams.mix(document[whole].astype(np.uint64))
    order = np.argsort(name, kind="stable")
    same = name[order[1:]] == name[order[:-1]]
    later, earlier = np.full(len(whole), -1), np.full(len(whole), -1)
    later[order[:-1][same]] = whole[order[1:][same]]
    earlier[order[1:][same]] = whole[order[:-1][same]]
    marked = (later >= 0) | (earlier >= 0)
    while True:
        edges = np.zeros(len(values) + 1, np.int32)
        np.add.at(edges, whole[marked], 1)
        np.add.at(edges, whole[marked] + k, -1)
        covered = np.cumsum(edges[:-1]) > 0
        head = covered.copy()
        head[1:] &= ~covered[:-1] | (document[1:] != document[:-1])
        stretch = np.where(covered, np.cumsum(head), 0)
        mine = stretch[whole]
        still = marked & (((later >= 0) & (stretch[later] == mine)) | ((earlier >= 0) & (stretch[earlier] == mine)))
        if still.sum() == marked.sum():
            break
        marked = still
    start = np.flatnonzero(head)
    tail = covered.copy()
    tail[:-1] &= ~covered[1:] | head[1:]
    end = np.flatnonzero(tail) + 1
    keep = end - start >= shortest
    return start[keep], end[keep]


def block_runs(data: np.ndarray, offsets: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of a block of documents as rows (start, length, period), the document of each, and the words' offsets.

    All stretches that can hold a run make up one text for the trees, with a
    symbol of its own between any two of them that no run can cross.
    """
    begin, end, (values,), places = grams.words_of(data, offsets, hashes=1)
    start, stop = recurring(values, places, shortest)
    numbers: dict[bytes, int] = {}
    text, first = [], []
    bytes_of = data.tobytes()
    for s, e in zip(start.tolist(), stop.tolist(), strict=True):
        first.append(len(text))
        for a, b in zip(begin[s:e].tolist(), end[s:e].tolist(), strict=True):
            text.append(numbers.setdefault(bytes_of[a:b], len(numbers) + 1))
        text.append(0)
    gaps = np.flatnonzero(np.array(text, np.int64) == 0)
    for i, gap in enumerate(gaps.tolist()):
        text[gap] = len(numbers) + 1 + i
    runs = runs_in(text, shortest)
    at = np.searchsorted(np.array(first, np.int64), runs[:, 0], side="right") - 1
    if len(runs):
        runs[:, 0] += start[at] - np.array(first)[at]
    document = np.searchsorted(places, runs[:, 0], side="right") - 1
    runs[:, 0] -= places[document]
    return runs, document, places


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """Words but for those that some run holds after its first period."""
    edges = np.zeros(len(words) + 1, np.int32)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return [w for w, x in zip(words, (np.cumsum(edges[:-1]) > 0).tolist(), strict=True) if not x]


@returning_memory
def runs_of_batches(batches: Iterator[pa.RecordBatch], shortest: int) -> Iterator[pa.RecordBatch]:
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    for batch in batches:
        data, offsets = grams.text_bytes(batch.column("text"))
        for lo, hi in grams.groups_of(np.diff(offsets), grams.BLOCK):
            part, local = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            runs, document, places = block_runs(part, local, shortest)
            ends = np.searchsorted(document, np.arange(hi - lo + 1))
            kept = []
            for i in range(hi - lo):
                words = part[local[i] : local[i + 1]].tobytes().split()
                if ends[i] < ends[i + 1]:
                    words = collapsed(words, runs[ends[i] : ends[i + 1]])
                kept.append(b" ".join(words))
            fields = pa.StructArray.from_arrays([pa.array(runs[:, j]) for j in range(3)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").slice(lo, hi - lo), batch.column("mark").slice(lo, hi - lo), pa.array(np.diff(places)),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields).cast(run_type),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=["key", "mark", "n_words", "runs", "collapsed"],
            )


def periodic_runs(documents: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed text and mark of the text, per input row.

    A run is a stretch of words with smallest period q and a length of
    ``shortest`` and 2 * q at least that no neighbouring word extends keeping q.
    The collapsed text has all words but those that some run holds after its
    first q words, joined by one space. Words are separated by ASCII white space
    and compared as bytes; words are numbered from 0.

    Documents don't meet, so there is no shuffle. A task holds ``grams.BLOCK``
    bytes of text at a time, or one longer document; of these only the stretches
    whose word sequences recur nearby go into the trees, which take some 1 KB for
    each of their words. Null and empty texts have no words, no runs and an empty
    collapsed text. Null ids and repeated rows count as any others. Other columns
    are not read.
    """
    schema = f"key long, mark long, n_words long, runs {RUN}, collapsed string"
    out = keyed(documents).mapInArrow(lambda b: runs_of_batches(b, shortest), schema)
    return out.select(id_of(F.col("key")).alias("doc_id"), "n_words", "runs", "collapsed", "mark")
