"""Substring dedup by de Bruijn compaction: k-word windows as edges, repeated paths compacted by joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm import grams
from jobweave.llm.repeats import FOUND, OPEN, SEEN, gathered, lists_of, repeated, settled
from jobweave.llm.store import id_of, keyed, returning_memory, stored

SPAN = 35
GRAM = 16


@returning_memory
def edges_of(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """The single edges (128-bit hashes of ``span`` words) of the bundles listed for each document."""
    for batch in batches:
        data, offsets = grams.text_bytes(batch.column("text"))
        key, mark = batch.column("key").to_numpy(), batch.column("mark").to_numpy()
        places, ends = lists_of(batch.column("places"), np.int64)
        weights, _ = lists_of(batch.column("weights"), np.int64)
        for lo, hi in grams.groups_of(np.diff(offsets), grams.BLOCK):
            part, local = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            _, _, (first, second), words = grams.words_of(part, local)
            mine, weight = places[ends[lo] : ends[hi]], weights[ends[lo] : ends[hi]]
            if not len(mine):
                continue
            document = np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))
            start, count = mine >> 8, mine & 0xFF
            row = np.repeat(np.arange(len(mine)), count)
            window = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + start[row]
            at = words[document[row]] + window
            found = [
                grams.mix(grams.stretch(grams.prefix_sums(v, m), m, at, at + span))
                for v, m in ((first, grams.MULTIPLIERS[1]), (second, grams.MULTIPLIERS[0]))
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found[0].view(np.int64)), pa.array(found[1].view(np.int64)),
                    pa.array(key[lo + document[row]]), pa.array(mark[lo + document[row]]),
                    pa.array(window << 8 | 1), pa.array(weight[row]),
                ],
                names=["edge", "check", "key", "mark", "place", "weight"],
            )


def repeated_paths(documents: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Stretches of repeated edges in the de Bruijn graph of ``keyed`` documents: key, mark, place, kind.

    Every window of ``span`` words is an edge. The edges that share a minimizer
    form one stretch of a path. Where all occurrences of the minimizer carry the
    same stretch, no edge branches off inside it: the stretch is compacted to a
    single row. Where stretches differ (a branching node, as at the ends of a
    copied passage), each different one is opened into its edges, which are
    counted and joined back to their source coordinates.
    """
    found = repeated(documents, span, gram, words=True)
    # each different stretch at a branch: how often it occurs, and one place of it
    stretches = stored(
        found.where("mixed").groupBy("gram", "body")
        .agg(F.count("*").alias("n"), F.min(F.struct("key", "place", "mark")).alias("at")).select("n", "at.key", "at.mark", "at.place"),
        "stretches",
    )
    asked = (
        stretches.select("key", "mark", "place", F.least("n", F.lit(2)).alias("weight"))
        .groupBy("key", "mark")
        .agg(F.collect_list("place").alias("places"), F.collect_list("weight").alias("weights"))
    )
    edges = stored(
        documents.join(asked, ["key", "mark"])
        .mapInArrow(lambda b: edges_of(b, span), "edge long, check long, key long, mark long, place long, weight long"),
        "edges",
    )
    twice = stored(
        edges.groupBy("edge", "check").agg(F.sum("weight").alias("n")).where("n > 1").select("edge", "check"), "twice"
    )
    matched = edges.where("weight = 1").join(twice, ["edge", "check"]).select("key", "mark", "place")
    return (
        found.select("key", "mark", "place", F.lit(SEEN).alias("kind"))
        .union(stretches.where("n = 1").select("key", "mark", "place", F.lit(OPEN)))
        .union(matched.select("key", "mark", "place", F.lit(FOUND)))
    )


@returning_memory
def kept_words(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places, ends = lists_of(batch.column("places"), np.int64)
        kinds, _ = lists_of(batch.column("kinds"), np.int64)
        n_words, n_removed, spans, kept = [], [], [], []
        for row, text in enumerate(batch.column("text")):
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            mine = slice(ends[row], ends[row + 1])
            gone = settled(places[mine], kinds[mine], span, len(words)) if ends[row] < ends[row + 1] else None
            n_words.append(len(words))
            if gone is None or not gone.any():
                n_removed.append(0)
                spans.append([])
            else:
                n_removed.append(int(gone.sum()))
                flips = np.flatnonzero(np.diff(gone, prepend=False, append=False))
                spans.append([{"first": int(a), "end": int(b)} for a, b in zip(flips[::2], flips[1::2], strict=True)])
                words = [w for w, x in zip(words, gone, strict=True) if not x]
            kept.append(b" ".join(words))
        span_type = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("key"), batch.column("mark"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                pa.array(spans, span_type), pa.array(kept, pa.binary()).cast(pa.string()),
            ],
            names=["key", "mark", "n_words", "n_removed", "spans", "kept"],
        )


def remove_repeated_spans(documents: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Documents without the words of every ``span``-word window that starts anywhere else too.

    Returns doc_id, n_words, n_removed, spans (first and end word of each removed
    stretch), kept (the other words, joined by one space) and the mark of the text
    (see ``keyed``), one row per input row. Words are separated by ASCII white space. Windows are judged on the
    input: of two copies both go.

    Null and empty texts have no words and an empty ``kept``. A null doc_id is an
    id like any other. A repeated row counts as another copy. Other columns are
    not read. ``gram`` (at most span) only steers the search: any value gives the
    same result.
    """
    documents = keyed(documents)
    rows = repeated_paths(documents, span, gram)
    schema = "key long, mark long, n_words long, n_removed long, spans array<struct<first: long, end: long>>, kept string"
    out = gathered(documents, rows, lambda b: kept_words(b, span), schema)
    return out.select(id_of(F.col("key")).alias("doc_id"), "n_words", "n_removed", "spans", "kept", "mark")
