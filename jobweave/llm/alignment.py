"""Cross-tokenizer alignment: two tokenizations of a text, merged in lockstep over many documents at once.

A byte-level tokenizer (A, a vocabulary file of ``tokenizers``) and a piece
tokenizer (B, a ``sentencepiece`` model) cut the same bytes differently. Two
tokens are linked where their byte ranges overlap; where tokens of both end, a
group ends. One vector of pointers into A and one into B advance all documents
of a block together, a link each a step.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm import grams
from jobweave.llm.store import id_of, keyed, returning_memory, stored

#: Bytes of text aligned together; words of a document that advance as one lane.
BLOCK, LANE = 1 << 21, 256
#: Bytes that a task's remembered words may take, about.
REMEMBERED = 160 << 20
#: How the byte-level tokenizer cuts a text into stretches that it then merges (fixed by its vocabulary).
STRETCHES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space and the word after it. No token of A or B reaches over the end of such a word.
WORD = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Other white space, which may join with what follows: texts that hold it are tokenized whole.
OTHER_BLANK = re.compile(r"[^\S \n]")
SPACE = "▁"


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and the ids of words met before."""

    def __init__(self, byte_vocabulary: str, piece_model: str):
        import sentencepiece
        import tiktoken

        with open(byte_vocabulary, encoding="utf-8") as file:
            content = json.load(file)
        special = {t["content"] for t in content.get("added_tokens", ())}
        letters = byte_of_letter()
        ranks = {bytes(letters[c] for c in t): i for t, i in content["model"]["vocab"].items() if t not in special}
        # ids follow the order of the merges, so they serve as ranks
        self.a = tiktoken.Encoding("a", pat_str=STRETCHES, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)
        ]
        if max(len(self.a_bytes), len(pieces)) > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        self.lengths = [np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes)]
        self.by_word = not any(re.search(f"[^{SPACE}\n][{SPACE}\n]", p) for p in pieces)
        self.space = self.b.piece_to_id(SPACE)
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.uneven: set[str] = set()
        self.taken = 0

    def joined(self, a: bytes, b: bytes) -> tuple[bytes, bytes]:
        """The bytes of 16-bit ids of A and of B."""
        ids = np.frombuffer(a, np.uint16).tolist(), np.frombuffer(b, np.uint16).tolist()
        return b"".join(map(self.a_bytes.__getitem__, ids[0])), b"".join(map(self.b_bytes.__getitem__, ids[1]))

    def learn(self, words: set[str]) -> None:
        new = words - self.known.keys()
        if self.taken > REMEMBERED:
            self.known.clear()
            self.uneven.clear()
            self.taken, new = 0, words
        new = list(new)
        # B puts a space before what it gets: the word's own, or one that is taken off again
        pieces = self.b.encode([w[1:] if w[0] == " " else w for w in new], num_threads=1)
        for i, word in enumerate(new):
            if word[0] != " ":
                if pieces[i][:1] != [self.space]:
                    self.uneven.add(word)
                pieces[i] = pieces[i][1:]
        encode = self.a.encode_ordinary
        a = [array("H", encode(w)).tobytes() for w in new]
        b = [array("H", ids).tobytes() for ids in pieces]
        raw = [w.encode() for w in new]
        # all words at once; word by word only where the bytes differ somewhere
        sizes = np.array([len(r) for r in raw], np.int64)
        same = self.joined(b"".join(a), b"".join(b)) == (whole := b"".join(raw), whole)
        if not same or not all((self.widths(i, ids) == sizes).all() for i, ids in enumerate((a, b))):
            self.uneven.update(w for w, x, y, r in zip(new, a, b, raw, strict=True) if self.joined(x, y) != (r, r))
        self.known.update(zip(new, zip(a, b, strict=True), strict=True))
        self.taken += sum(map(len, a)) + sum(map(len, b)) + int(sizes.sum()) + 350 * len(new)

    def widths(self, which: int, ids: list[bytes]) -> np.ndarray:
        """The bytes that each run of 16-bit ids stands for, by A (0) or B (1)."""
        ends = np.concatenate([[0], np.cumsum(np.array([len(x) // 2 for x in ids], np.int64))])
        sums = np.concatenate([[0], np.cumsum(self.lengths[which][np.frombuffer(b"".join(ids), np.uint16)])])
        return sums[ends[1:]] - sums[ends[:-1]]

    def whole(self, text: str) -> list[tuple[bytes, bytes]]:
        """The ids of a text tokenized in one go; none where the bytes of its tokens aren't its own."""
        a = np.array(self.a.encode_ordinary(f" {text}"), np.uint16).tobytes()
        b = np.array(self.b.encode([text], num_threads=1)[0], np.uint16).tobytes()
        return [(a, b)] if self.joined(a, b) == (raw := f" {text}".encode(), raw) else []

    def lanes(self, texts: list[str | None]) -> list[list[tuple[bytes, bytes]]]:
        """16-bit ids by A and B of each text, in lanes that begin and end where tokens of both do."""
        words = [WORD.findall(f" {t}") if t and self.by_word and not OTHER_BLANK.search(t) else None for t in texts]
        self.learn(set().union(*(w for w in words if w)))
        out = []
        for text, mine in zip(texts, words, strict=True):
            if not text:
                out.append([])
            elif mine is None or not self.uneven.isdisjoint(mine):
                out.append(self.whole(text))
            else:
                ids = list(map(self.known.__getitem__, mine))
                parts = (ids[i : i + LANE] for i in range(0, len(ids), LANE))
                out.append([(b"".join([a for a, _ in p]), b"".join([b for _, b in p])) for p in parts])
        return out


def lockstep(a_end: np.ndarray, b_end: np.ndarray, a_first: np.ndarray, b_first: np.ndarray):
    """Links and cuts of lanes whose tokens of A and B cover the same bytes.

    ``a_end`` and ``b_end`` are the byte ends of all tokens, ``a_first`` and
    ``b_first`` the first token of each lane and, last, the number of tokens. All
    lanes take a step together: each links its two tokens, then leaves the one
    that ends first, or both at a cut. Finished lanes are compacted away. Returns
    the tokens of A and of B of all links, and whether a group ends with a token.
    """
    a, b, stop = a_first[:-1].copy(), b_first[:-1].copy(), a_first[1:]
    a_last, b_last = np.zeros(len(a_end), bool), np.zeros(len(b_end), bool)
    links_a, links_b = [], []
    open_lanes = a < stop
    while True:
        if not open_lanes.all():
            a, b, stop = a[open_lanes], b[open_lanes], stop[open_lanes]
        if not len(a):
            break
        links_a.append(a)
        links_b.append(b)
        x, y = a_end[a], b_end[b]
        leave_a, leave_b = x <= y, y <= x
        cut = leave_a & leave_b
        a_last[a[cut]] = True
        b_last[b[cut]] = True
        a, b = a + leave_a, b + leave_b
        open_lanes = a < stop
    none = np.zeros(0, np.int64)
    return np.concatenate([*links_a, none]), np.concatenate([*links_b, none]), a_last, b_last


class Writer:
    """Texts of groups, a1,a2|b1;a3|b2,b3, from codes: a token's id and which separator follows it."""

    def __init__(self, ids: int):
        self.ids = ids
        parts = [b"%d%s" % (i, sign) for sign in (b",", b"|", b";", b"") for i in range(ids)]
        self.rows = np.array(parts).view(np.uint8).reshape(len(parts), -1)  # filled up with zeros
        self.widths = (self.rows > 0).sum(axis=1)

    def codes(self, a_ids: np.ndarray, b_ids: np.ndarray, a_last: np.ndarray, b_last: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Codes of all tokens, group by group, A before B; ``ends``: number of B tokens up to the end of each document."""
        a_stop, b_stop = np.flatnonzero(a_last) + 1, np.flatnonzero(b_last) + 1
        group_a, group_b = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        out = np.empty(len(a_ids) + len(b_ids), np.int64)
        b_start = np.concatenate([[0], b_stop])
        out[np.arange(len(a_ids)) + b_start[group_a]] = a_ids + self.ids * a_last
        sign = 2 * b_last.astype(np.int64)
        sign[ends[ends > 0] - 1] = 3
        out[np.arange(len(b_ids)) + a_stop[group_b]] = b_ids + self.ids * sign
        return out

    def texts(self, codes: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The written codes, cut after each number of codes in ``ends``."""
        written = self.rows[codes].ravel()
        whole = written[written > 0].tobytes()
        at = np.concatenate([[0], np.cumsum(self.widths[codes])])[ends].tolist()
        return [whole[s:e] for s, e in zip([0, *at], at)]


LIST = pa.list_(pa.int32())
FIELDS = [
    ("block", pa.int64()), ("key", pa.int64()), ("mark", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.string()), ("codes", LIST), ("times", LIST),
    ("pairs", pa.list_(pa.int64())), ("held", LIST),
]
ALIGNED = (
    "block long, key long, mark long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, "
    "codes array<int>, times array<int>, pairs array<long>, held array<int>"
)


def align_block(known: Tokenizers, writer: Writer, texts: list[str | None], with_groups: bool) -> dict[str, list | pa.Array]:
    """Columns of a block's documents, and the block's distinct id pairs with the number of documents that hold each."""
    lanes = known.lanes(texts)
    per_document = np.array([len(x) for x in lanes])
    flat = [lane for x in lanes for lane in x]
    sizes = np.array([(len(a) // 2, len(b) // 2) for a, b in flat], np.int64).reshape(-1, 2)
    a_first, b_first = (np.concatenate([[0], np.cumsum(sizes[:, i])]) for i in (0, 1))
    a_ids, b_ids = (np.frombuffer(b"".join(lane[i] for lane in flat), np.uint16).astype(np.int64) for i in (0, 1))
    link_a, link_b, a_last, b_last = lockstep(np.cumsum(known.lengths[0][a_ids]), np.cumsum(known.lengths[1][b_ids]), a_first, b_first)
    lane_ends = np.concatenate([[0], np.cumsum(per_document)])
    a_ends, b_ends = a_first[lane_ends], b_first[lane_ends]  # of the documents
    codes = writer.codes(a_ids, b_ids, a_last, b_last, b_ends[1:])
    texts_of_groups = writer.texts(codes, (a_ends + b_ends)[1:])
    groups = np.concatenate([[0], np.cumsum(a_last)])
    document = np.searchsorted(a_ends, link_a, side="right") - 1
    pairs, times = np.unique(document.astype(np.uint64) << np.uint64(32) | (a_ids[link_a] << 16 | b_ids[link_b]).astype(np.uint64), return_counts=True)
    owner = (pairs >> np.uint64(32)).astype(np.int64)
    distinct, places, held = np.unique(pairs & np.uint64(0xFFFFFFFF), return_inverse=True, return_counts=True)
    offsets = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)), pa.int32())
    return {
        "n_a": np.diff(a_ends), "n_b": np.diff(b_ends), "n_groups": np.diff(groups[a_ends]),
        "n_links": np.bincount(document, minlength=len(texts)),
        "groups_sha256": [hashlib.sha256(t).hexdigest() if t else "" for t in texts_of_groups],
        "groups": [t.decode() if with_groups else None for t in texts_of_groups],
        "codes": pa.ListArray.from_arrays(offsets, pa.array(places, pa.int32())),
        "times": pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32())),
        "pairs": distinct.astype(np.int64), "held": held,
    }


@returning_memory
def align_batches(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], with_groups: bool) -> Iterator[pa.RecordBatch]:
    """A row per document, and after those of a block one row (no key) with the block's pairs."""
    known = Tokenizers(*paths)
    writer = Writer(max(len(known.a_bytes), len(known.b_bytes)))
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        column = batch.column("text")
        sizes = np.diff(grams.text_bytes(column)[1])
        for lo, hi in grams.groups_of(sizes, BLOCK):
            found = align_block(known, writer, column.slice(lo, hi - lo).to_pylist(), with_groups)
            pairs, held, n = found.pop("pairs"), found.pop("held"), hi - lo
            found |= {c: batch.column(c).slice(lo, n) for c in ("key", "mark")} | {"block": np.full(n, block), "pairs": [None] * n, "held": [None] * n}
            yield pa.RecordBatch.from_arrays(
                [x if isinstance(x := found[name], pa.Array) else pa.array(x, kind) for name, kind in FIELDS], names=[f[0] for f in FIELDS]
            )
            if len(pairs):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([{"block": block, "pairs": pairs, "held": held}.get(name)], kind) for name, kind in FIELDS], names=[f[0] for f in FIELDS]
                )
            block += 1


RESULT = "key long, mark long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


def count_links(documents: pa.Table, answers: pa.Table) -> pa.Table:
    """n_best and count_sum of a block's documents, from the corpus-wide counts of the block's pairs."""
    place = answers.column("place").to_numpy()
    count, best = np.zeros((2, int(place.max(initial=-1)) + 1), np.int64)
    count[place] = answers.column("n").to_numpy()
    best[place] = answers.column("best").to_numpy(zero_copy_only=False)
    codes, times = (documents.column(c).combine_chunks() for c in ("codes", "times"))
    sizes = np.nan_to_num(codes.value_lengths().to_numpy(zero_copy_only=False), nan=0).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    codes, times = codes.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    totals = {}
    for name, values in (("n_best", best), ("count_sum", count)):
        sums = np.concatenate([[0], np.cumsum(values[codes] * times)])
        totals[name] = pa.array(sums[ends[1:]] - sums[ends[:-1]], pa.int64())
    names = [c.split(" ")[0] for c in RESULT.split(", ")]
    return pa.table({c: totals.get(c, documents.column(c) if c not in totals else None) for c in names})


def align_tokenizers(documents: DataFrame, byte_vocabulary: str, piece_model: str, with_groups: bool = False) -> DataFrame:
    """How two tokenizers cut each document: one row per input row.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256,
    groups and mark of the text. A gets a space and the text, B the text, before
    which it puts a space itself; strings of special tokens are plain text.
    ``groups`` (null unless asked for) has each group's ids, ``a1,a2|b1;a3|b2,b3``.
    A pair of ids counts the documents (rows) that hold it linked; ``count_sum``
    adds that up over a document's links, and ``n_best`` says for how many of them
    the count is the highest of all pairs with that id of A, ties included.

    Null and empty texts, and texts whose tokens' bytes are not a space and the
    text by A and by B, have no tokens: zeros and an empty ``groups_sha256``. Null
    ids and repeated rows are documents like others; other columns are not read.

    Documents are aligned in blocks of BLOCK bytes (or one longer document). Only
    a block's distinct pairs are joined with the corpus-wide counts, and come back
    to the block's documents, so no pair meets in one task once a document, and
    no task holds more than a block. The one table sent to all tasks has a row for
    each id of A.
    """
    paths = byte_vocabulary, piece_model
    found = stored(keyed(documents).mapInArrow(lambda b: align_batches(b, paths, with_groups), ALIGNED), "aligned")
    pairs = found.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("place", "x"))
    counts = stored(pairs.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.held").alias("n")), "counts")
    highest = counts.groupBy(F.shiftright("pair", 16).alias("a")).agg(F.max("n").alias("highest"))
    ranked = counts.join(F.broadcast(highest), F.shiftright("pair", 16) == F.col("a")).select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))
    answers = pairs.select("block", "place", F.col("x.pairs").alias("pair")).join(ranked, "pair").select(F.col("block").alias("of"), "place", "n", "best")
    rows = found.where("pairs is null").select("block", *(c.split(" ")[0] for c in RESULT.split(", ") if c not in ("n_best long", "count_sum long")), "codes", "times")
    out = rows.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(count_links, RESULT)
    return out.select(
        id_of(F.col("key")).alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups", "mark"
    )
