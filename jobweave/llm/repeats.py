"""Where texts repeat: windows bundled by their minimizer, and the joins that find bundles seen elsewhere.

A window is ``span`` neighbouring values (words or bytes) of one document. All
windows of a document that share one occurrence of a minimizer form a bundle: a
row with the hash of the minimizer gram, the hash of everything the bundle
covers, and its place. Equal windows always fall under equal grams, so a gram
seen once rules out its whole bundle, and a whole bundle seen again settles all
its windows in one row. Only bundles that share a gram but not their content are
opened to single windows, by the operator that calls.

A place is packed in a long: first window << 8 | number of windows. The document
is named by key and mark, see ``keyed``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm import grams
from jobweave.llm.store import returning_memory, stored

RUNS = "gram long, body long, key long, mark long, place long"
#: What is known of a bundle in ``gathered``: seen elsewhere, not settled by whole bundles, or windows found equal.
SEEN, OPEN, FOUND = 0, 1, 2


def values_of(data: np.ndarray, offsets: np.ndarray, words: bool):
    """The two independent hash arrays of a block's words or bytes, and the documents' offsets in them."""
    if not words:
        return grams.BYTE_VALUES[0][data], grams.BYTE_VALUES[1][data], offsets
    _, _, (first, second), places = grams.words_of(data, offsets)
    return first, second, places


def pieces(data: np.ndarray, offsets: np.ndarray, span: int, words: bool):
    """Blocks of documents; a long document over bytes is cut into pieces that overlap by span - 1."""
    sizes = np.diff(offsets)
    for lo, hi in grams.groups_of(sizes, grams.BLOCK):
        if words or hi - lo > 1 or sizes[lo] <= 2 * grams.BLOCK:
            yield lo, 0, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            continue
        for start in range(0, int(sizes[lo]) - span + 1, grams.BLOCK):
            end = min(int(sizes[lo]), start + grams.BLOCK + span - 1)
            piece = data[offsets[lo] + start : offsets[lo] + end]
            yield lo, start, piece, np.array([0, len(piece)])


def bundles(documents: DataFrame, span: int, gram: int, words: bool) -> DataFrame:
    """One row per bundle of windows of ``keyed`` documents."""

    @returning_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = grams.text_bytes(batch.column("text"))
            key, mark = batch.column("key").to_numpy(), batch.column("mark").to_numpy()
            for lo, shift, part, places in pieces(data, offsets, span, words):
                first, second, places = values_of(part, places, words)
                document, start, count, head, body = grams.window_runs(first, second, places, span, gram)
                if len(document):
                    place = (start + shift) << 8 | count
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (head, body, key[lo + document], mark[lo + document], place)],
                        names=["gram", "body", "key", "mark", "place"],
                    )

    return documents.mapInArrow(run, RUNS)


def repeated(documents: DataFrame, span: int, gram: int, words: bool) -> DataFrame:
    """The bundles whose gram occurs more than once; ``mixed``: with different content.

    Counts and extremes of a gram are combined before the shuffle and joined back,
    so a gram that a third of all documents share meets in no task.
    """
    found = bundles(documents, span, gram, words)
    known = stored(
        found.groupBy("gram").agg(F.count("*").alias("n"), F.min("body").alias("low"), F.max("body").alias("high"))
        .where("n > 1").select("gram", (F.col("low") != F.col("high")).alias("mixed")),
        "grams",
    )
    return stored(found.join(known, "gram"), "bundles")


def gathered(documents: DataFrame, rows: DataFrame, per_document: Callable, schema: str) -> DataFrame:
    """``per_document(batch, places)`` over documents with what ``rows`` (key, mark, place, kind) says of each.

    Documents without rows come too. One shuffle of the texts; a document's list
    is bounded by its own length.
    """
    lists = rows.groupBy("key", "mark").agg(F.collect_list("place").alias("places"), F.collect_list("kind").alias("kinds"))
    return documents.join(lists, ["key", "mark"], "left").mapInArrow(per_document, schema)


def settled(places: np.ndarray, kinds: np.ndarray, covers: int, size: int) -> np.ndarray:
    """Which of a document's ``size`` values lie in windows known to occur elsewhere.

    Windows of SEEN bundles count unless the same bundle is OPEN; FOUND ones always.
    """
    seen = places[kinds == SEEN]
    seen = seen[~np.isin(seen, places[kinds == OPEN])]
    all_places = np.concatenate([seen, places[kinds == FOUND]])
    edges = np.zeros(size + 1, np.int32)
    start, count = all_places >> 8, all_places & 0xFF
    np.add.at(edges, start, 1)
    np.add.at(edges, start + count - 1 + covers, -1)
    return np.cumsum(edges[:-1]) > 0


def lists_of(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column; null counts as empty."""
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False), nan=0).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind), np.concatenate([[0], np.cumsum(lengths)])
