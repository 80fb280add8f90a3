"""Suffix-array dedup by deep-shallow sorting of the suffixes at sampled places."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm import grams
from jobweave.llm.repeats import FOUND, OPEN, SEEN, gathered, lists_of, repeated, settled
from jobweave.llm.store import id_of, keyed, returning_memory, stored

SPAN = 100
GRAM = 24
#: Bytes that multikey quicksort compares before blind tries take over.
SHALLOW = 40
#: Different passages under one gram that are sorted together; more are dealt to several sorts.
TOGETHER = 512
#: Rows that a task sorts at once.
ROWS = 20_000


def big_endian_words(rows: np.ndarray) -> np.ndarray:
    """Byte matrix as columns of 64-bit characters, compared as bytes are."""
    width = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), width), np.uint8)
    padded[:, : rows.shape[1]] = rows
    return padded.view(">u8").astype(np.uint64)


def multikey_quicksort(words: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by group, then by the first ``depth`` 64-bit characters; and which neighbours are still tied.

    Three-way partitioning around a pivot for each range; all ranges of a round
    are split together. A range equal to its pivot moves on to the next character.
    """
    order = np.argsort(group, kind="stable")
    head = np.diff(group[order], prepend=group[order][:1] - 1) != 0  # starts of ranges
    at = np.zeros(len(order), np.int64)  # character that a range stands at
    while True:
        number = np.cumsum(head) - 1
        size = np.bincount(number) if len(number) else np.zeros(0, int)
        live = np.flatnonzero((size[number] > 1) & (at < depth))
        if not len(live):
            return order, ~head
        first = np.flatnonzero(head)
        middle = first + size // 2
        value = words[order[live], at[live]]
        pivot = words[order[middle[number[live]]], at[live]]
        side = (value > pivot).astype(np.int64) - (value < pivot)
        moved = np.lexsort((side, number[live]))
        order[live], side, rank = order[live[moved]], side[moved], number[live][moved]
        new = np.ones(len(live), bool)
        new[1:] = (rank[1:] != rank[:-1]) | (side[1:] != side[:-1])
        head[live] = new
        at[live] += side == 0


class BlindTrie:
    """Patricia trie of byte strings of up to ``width`` bytes, padded: only branching bytes are looked at on the way down."""

    __slots__ = ("bits", "root", "texts")

    def __init__(self, texts: list[int], width: int):
        self.texts, self.bits, self.root = texts, 8 * width, None

    def insert(self, item: int) -> None:
        """Nodes are [depth in bytes, {byte: child}], leaves lists of equal strings' numbers."""
        if self.root is None:
            self.root = (None, [item])
            return
        text, node = self.texts[item], self.root
        while node[0] is not None:  # blind descent: any leaf below agrees on the bytes not looked at, or shows where not
            step = node[1].get(text >> (self.bits - 8 - 8 * node[0]) & 255)
            node = step if step is not None else next(iter(node[1].values()))
        other = self.texts[node[1][0]]
        if text == other:
            node[1].append(item)
            return
        common = (self.bits - (text ^ other).bit_length()) // 8
        parent, node = None, self.root
        while node[0] is not None and node[0] < common:
            parent, node = node, node[1][text >> (self.bits - 8 - 8 * node[0]) & 255]
        shift = self.bits - 8 - 8 * common
        if node[0] == common:
            node[1][text >> shift & 255] = (None, [item])
            return
        new = (common, {other >> shift & 255: node, text >> shift & 255: (None, [item])})
        if parent is None:
            self.root = new
        else:
            parent[1][text >> (self.bits - 8 - 8 * parent[0]) & 255] = new

    def in_order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            depth, below = stack.pop()
            if depth is None:
                out.extend(below)
            else:
                stack.extend(below[b] for b in sorted(below, reverse=True))
        return out


def deep_shallow(rows: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of padded byte strings within groups, and each one's common prefix with the one before.

    Multikey quicksort compares the first ``shallow`` bytes; the ranges that tie
    there have long common prefixes and are ordered by a blind trie each.
    """
    words = big_endian_words(rows)
    depth = min(words.shape[1], -(-shallow // 8))
    order, tied = multikey_quicksort(words, group, depth)
    if depth < words.shape[1] and tied.any():
        starts = np.flatnonzero(~tied)
        ends = np.append(starts[1:], len(order))
        for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
            members = order[a:b]
            if b - a > 2 or not (words[members[0], depth:] == words[members[1], depth:]).all():
                trie = BlindTrie([int.from_bytes(rows[i].tobytes(), "big") for i in members], rows.shape[1])
                for i in range(b - a):
                    trie.insert(i)
                order[a:b] = members[trie.in_order()]
    differs = rows[order[1:]] != rows[order[:-1]]
    common = np.zeros(len(order), np.int64)
    common[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    common[1:][group[order[1:]] != group[order[:-1]]] = -1
    return order, common


def later_windows(group: np.ndarray, data: np.ndarray, offsets: np.ndarray, anchor: np.ndarray, span: int):
    """Which windows of passages equal a window of an earlier passage of their group.

    Passages stand in the order of their places; each has an anchor, the place of
    the gram that its group shares. A passage's suffix from the anchor and its
    reversed prefix before it are sorted; two windows that start the same distance
    before the anchor are equal where both common prefixes reach far enough.
    Returns passage, window, and whether it repeats an earlier one, for all windows.
    """
    sizes = np.diff(offsets)
    windows = sizes - span + 1
    n = len(sizes)
    right = np.zeros((n, span), np.uint8)
    left = np.zeros((n, span), np.uint8)
    column = np.arange(span)
    for side, matrix in ((1, right), (-1, left)):
        at = (offsets[:-1] + anchor)[:, None] + (column if side == 1 else -1 - column)
        inside = (at >= offsets[:-1, None]) & (at < offsets[1:, None])
        matrix[inside] = data[at[inside]]
    order_r, common_r = deep_shallow(right, group)
    order_l, common_l = deep_shallow(left, group, SHALLOW // 2)
    passages, starts, later = [], [], []
    class_r, class_l = np.empty(n, np.int64), np.empty(n, np.int64)
    first, last = anchor - windows + 1, anchor  # distances of the anchor from the starts of a passage's windows
    for before in range(int(first.min(initial=0)), int(last.max(initial=-1)) + 1):
        have = np.flatnonzero((first <= before) & (before <= last))
        if not len(have):
            continue
        class_r[order_r] = np.cumsum(common_r < span - before)
        class_l[order_l] = np.cumsum(common_l < before)
        both = class_r[have] * (n + 1) + class_l[have]
        _, earliest = np.unique(both, return_index=True)
        again = np.ones(len(have), bool)
        again[earliest] = False
        passages.append(have)
        starts.append(anchor[have] - before)
        later.append(again)
    if not passages:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
    return np.concatenate(passages), np.concatenate(starts), np.concatenate(later)


def runs_of(passage: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring windows of a passage as passage, first window and count."""
    order = np.lexsort((start, passage))
    passage, start = passage[order], start[order]
    head = np.ones(len(passage), bool)
    head[1:] = (passage[1:] != passage[:-1]) | (start[1:] != start[:-1] + 1)
    heads = np.flatnonzero(head)
    return passage[heads], start[heads], np.diff(np.append(heads, len(passage)))


@returning_memory
def passages_of(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the bundles listed for each document."""
    for batch in batches:
        data, offsets = grams.text_bytes(batch.column("text"))
        places, ends = lists_of(batch.column("places"), np.int64)
        heads, _ = lists_of(batch.column("grams"), np.int64)
        parts, _ = lists_of(batch.column("parts"), np.int64)
        document = np.repeat(np.arange(len(batch)), np.diff(ends))
        key, mark = batch.column("key").to_numpy(), batch.column("mark").to_numpy()
        start, size = offsets[document] + (places >> 8), (places & 0xFF) + span - 1
        for lo, hi in grams.groups_of(size, 4 * grams.BLOCK):
            row = np.repeat(np.arange(lo, hi), size[lo:hi])
            begin = np.cumsum(size[lo:hi]) - size[lo:hi]
            index = np.arange(len(row)) - begin[row - lo] + start[row]
            bounds = pa.py_buffer(np.append(begin, len(row)).astype(np.int32).tobytes())
            body = pa.Array.from_buffers(pa.binary(), hi - lo, [None, bounds, pa.py_buffer(data[index].tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(heads[lo:hi]), pa.array(parts[lo:hi]), pa.array(key[document[lo:hi]]),
                 pa.array(mark[document[lo:hi]]), pa.array(places[lo:hi]), body],
                names=["gram", "parts", "key", "mark", "place", "body"],
            )


def whole_groups(batches: Iterator[pa.RecordBatch], columns: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows, cut only where ``columns`` change; input is sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(len(table) - 1, bool)
        for c in columns:
            values = table.column(c).to_numpy()
            change |= values[1:] != values[:-1]
        cuts = np.flatnonzero(change) + 1
        if not len(cuts):
            continue
        yield table.slice(0, int(cuts[-1])).combine_chunks()
        held = table.slice(int(cuts[-1])).combine_chunks().to_batches()
    if held and sum(map(len, held)):
        yield pa.Table.from_batches(held).combine_chunks()


@returning_memory
def sort_passages(batches: Iterator[pa.RecordBatch], span: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Windows that repeat an earlier one of their group; for groups dealt to several sorts also all others.

    The latter carry a 128-bit hash, by which the sorts' earliest windows meet.
    """
    names = ["key", "mark", "place", "hash", "check"]
    for table in whole_groups(batches, ["gram", "salt"], ROWS):
        table = table.sort_by([(c, "ascending") for c in ("gram", "key", "place", "mark")])
        new = np.ones(len(table), bool)  # equal rows of the input give the same passage twice
        new[1:] = np.any([np.diff(table.column(c).to_numpy()) != 0 for c in ("gram", "key", "place", "mark")], axis=0)
        table = table.filter(pa.array(new))
        body = table.column("body").combine_chunks().cast(pa.large_binary())
        _, bounds, raw = body.buffers()
        offsets = np.frombuffer(bounds, np.int64)[body.offset : body.offset + len(body) + 1]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        head, salt = table.column("gram").to_numpy(), table.column("salt").to_numpy()
        key, mark, place = (table.column(c).to_numpy() for c in ("key", "mark", "place"))
        _, group = np.unique(np.stack([head, salt]), axis=1, return_inverse=True)
        found = grams.gram_hashes(grams.BYTE_VALUES[0][data], gram, grams.MULTIPLIERS[2]).view(np.int64)
        row = np.repeat(np.arange(len(head)), np.diff(offsets))[: len(found)]
        hits = np.flatnonzero(found == head[row])
        anchor = np.full(len(head), -1)
        anchor[row[hits[::-1]]] = hits[::-1] - offsets[row[hits[::-1]]]
        passage, start, later = later_windows(group.reshape(-1), data, offsets, anchor, span)
        p, s, c = runs_of(passage[later], start[later])
        where = ((place[p] >> 8) + s) << 8 | c
        nothing = pa.nulls(len(p), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(key[p]), pa.array(mark[p]), pa.array(where), nothing, nothing], names=names)
        split = np.flatnonzero(~later & (table.column("parts").to_numpy()[passage] > 1))
        if len(split):
            p, s = passage[split], start[split]
            at = offsets[p] + s
            hashes = [
                grams.mix(grams.stretch(grams.prefix_sums(grams.BYTE_VALUES[j][data], m), m, at, at + span))
                for j, m in enumerate(grams.MULTIPLIERS[:2])
            ]
            where = ((place[p] >> 8) + s) << 8 | 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[p]), pa.array(mark[p]), pa.array(where), *(pa.array(h.view(np.int64)) for h in hashes)], names=names
            )


def repeated_passages(documents: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Places in ``keyed`` documents whose ``span`` bytes also start earlier: key, mark, place, kind.

    The suffix array is sparse: suffixes stand at the minimizers of the windows,
    one for some 40 bytes. Passages that recur whole are settled by the earliest
    of them; the different passages of one gram are sorted, see ``later_windows``.
    """
    found = repeated(documents, span, gram, words=False)
    firsts = stored(
        found.groupBy("gram", "body")
        .agg(F.min(F.struct("key", "place", "mark")).alias("at"), F.max("mixed").alias("mixed"))
        .select("gram", "mixed", "at.key", "at.mark", "at.place"),
        "firsts",
    )
    sizes = firsts.where("mixed").groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > TOGETHER)
    crowded = stored(sizes.select("gram", F.ceil(F.col("n") / TOGETHER).alias("parts")), "crowded")
    asked = (
        firsts.where("mixed").join(crowded, "gram", "left")
        .groupBy("key", "mark")
        .agg(
            F.collect_list("place").alias("places"), F.collect_list("gram").alias("grams"),
            F.collect_list(F.coalesce("parts", F.lit(1).cast("long"))).alias("parts"),
        )
    )
    bodies = documents.join(asked, ["key", "mark"]).mapInArrow(
        lambda b: passages_of(b, span), "gram long, parts long, key long, mark long, place long, body binary"
    )
    dealt = bodies.withColumn("salt", F.pmod(F.xxhash64("key", "mark", "place"), "parts"))
    sorts = stored(
        dealt.repartition("gram", "salt").sortWithinPartitions("gram", "salt").mapInArrow(
            lambda b: sort_passages(b, span, gram), "key long, mark long, place long, hash long, check long"
        ),
        "sorts",
    )
    split = sorts.where("hash is not null")
    earliest = stored(
        split.groupBy("hash", "check").agg(F.count("*").alias("n"), F.min(F.struct("key", "place", "mark")).alias("at"))
        .where("n > 1"),
        "earliest",
    )
    across = split.join(earliest, ["hash", "check"]).where("struct(key, place, mark) != at").select("key", "mark", "place")
    return (
        found.select("key", "mark", "place", F.lit(SEEN).alias("kind"))
        .union(firsts.select("key", "mark", "place", F.lit(OPEN)))
        .union(sorts.where("hash is null").select("key", "mark", "place", F.lit(FOUND)))
        .union(across.select("key", "mark", "place", F.lit(FOUND)))
    )


@returning_memory
def kept_bytes(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = grams.text_bytes(batch.column("text"))
        places, ends = lists_of(batch.column("places"), np.int64)
        kinds, _ = lists_of(batch.column("kinds"), np.int64)
        removed, spans, kept = [], [], []
        for row in range(len(batch)):
            text, mine = data[offsets[row] : offsets[row + 1]], slice(ends[row], ends[row + 1])
            found = []
            if ends[row] < ends[row + 1]:
                gone = settled(places[mine], kinds[mine], span, len(text))
                flips = np.flatnonzero(np.diff(gone, prepend=False, append=False))
                found = [{"first": int(a), "end": int(b)} for a, b in zip(flips[::2], flips[1::2], strict=True)]
                text = text[~gone]
            removed.append(sum(x["end"] - x["first"] for x in found))
            spans.append(found)
            kept.append(text.tobytes())
        span_type = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("key"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()),
                pa.array(spans, span_type), pa.array(kept, pa.binary()),
            ],
            names=["key", "n_bytes", "n_removed", "spans", "kept"],
        )


def remove_later_copies(documents: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Documents without the bytes of every ``span``-byte string that also starts earlier.

    Earlier is a smaller doc_id, or the same document and a smaller place. Texts
    are UTF-8 bytes; strings lie within one document and are judged on the input.
    Returns doc_id, n_bytes, n_removed, spans (first and end byte of each removed
    stretch) and kept (binary: a cut can fall inside a character).

    Null and empty texts have no bytes. A null doc_id comes before all others.
    Equal rows (same id and text) are the same document, so they don't remove each
    other; different texts with one id are ordered by the places of their strings.
    Other columns are not read. ``gram`` only steers the search.
    """
    documents = keyed(documents)
    rows = repeated_passages(documents, span, gram)
    schema = "key long, n_bytes long, n_removed long, spans array<struct<first: long, end: long>>, kept binary"
    out = gathered(documents, rows, lambda b: kept_bytes(b, span), schema)
    return out.select(id_of(F.col("key")).alias("doc_id"), "n_bytes", "n_removed", "spans", "kept")
