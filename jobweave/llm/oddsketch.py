"""MinHash near-dedup with odd sketches: banded candidates, checked by XOR of parity bitmaps, confirmed on full sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.llm import grams
from jobweave.llm.graph import components
from jobweave.llm.store import id_of, keyed, returning_memory, stored

#: MinHash values for the bands, and for the sketches of texts that share a band with another.
BANDED, SAMPLES = 128, 2048
BITS = 4096
#: Rows of a bucket that one task compares: members not yet in the bucket's main component, and others.
LEFT, RIGHT = 256, 2048

_RNG = np.random.Generator(np.random.PCG64(77))
FACTORS = _RNG.integers(1, 2**63, 2 * SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def band_rows(similarity: float) -> int:
    """Most rows a band with which a pair at ``similarity`` is missed less than once in ten million."""
    fits = [r for r in (1, 2, 4, 8, 16) if (1 - similarity**r) ** (BANDED // r) < 1e-7]
    return max(fits)


def most_differing(similarity: float) -> int:
    """Differing bits that a pair at ``similarity`` does not exceed, by five standard deviations.

    With d of the samples differing, 2 d bits are toggled at random places of the
    bitmap, so about BITS / 2 * (1 - exp(-4 d / BITS)) end up odd.
    """
    d = SAMPLES * (1 - similarity) + 5 * math.sqrt(SAMPLES * similarity * (1 - similarity))
    return math.ceil(BITS / 2 * (1 - math.exp(-4 * min(d, SAMPLES) / BITS)) + 3 * math.sqrt(BITS) / 4)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a block's documents, sorted within each, and their offsets.

    A document of fewer words than a shingle has them all as one.
    """
    _, _, (words,), places = grams.words_of(LOWER[data], offsets, hashes=1)
    sizes = np.diff(places)
    count = np.where(sizes >= shingle, sizes - shingle + 1, np.minimum(sizes, 1))
    length = np.minimum(sizes, shingle)
    document = np.repeat(np.arange(len(sizes)), count)
    start = np.arange(len(document)) - np.repeat(np.cumsum(count) - count, count) + places[document]
    sums = grams.prefix_sums(words, grams.MULTIPLIERS[1])
    found = grams.mix(grams.stretch(sums, grams.MULTIPLIERS[1], start, start + length[document]) + length[document].astype(np.uint64))
    order = np.lexsort((found, document))
    found, document = found[order], document[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (document[1:] != document[:-1])
    found, document = found[new], document[new]
    return found, np.searchsorted(document, np.arange(len(sizes) + 1))


def samples_of(sets: np.ndarray, offsets: np.ndarray, count: int = SAMPLES) -> np.ndarray:
    """MinHash values, a row per sample and a column per (not empty) set."""
    out = np.empty((count, len(offsets) - 1), np.uint64)
    scratch = np.empty_like(sets)
    for j, factor in enumerate(FACTORS[:count]):
        np.multiply(sets, factor, out=scratch)
        np.minimum.reduceat(scratch, offsets[:-1], out=out[j])
    return out


def sketches_of(samples: np.ndarray) -> np.ndarray:
    """Odd sketches: sample j with value v toggles one bit, chosen by a hash of (j, v)."""
    chosen = grams.mix(samples + FACTORS[-len(samples) :, None]) % np.uint64(BITS)
    n = samples.shape[1]
    bits = np.zeros((n, BITS), np.uint8)
    for row in chosen.astype(np.int64):
        bits[np.arange(n), row] ^= 1
    return np.packbits(bits, axis=1).view(np.int64)


def sets_in(column: pa.Array, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [lo, hi) of a text column, their sets and the sets' offsets."""
    data, offsets = grams.text_bytes(column)
    for lo, hi in grams.groups_of(np.diff(offsets), grams.BLOCK):
        yield lo, hi, *shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], shingle)


@returning_memory
def signatures(batches: Iterator[pa.RecordBatch], shingle: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Per document: size and 128-bit identity of its set, and band keys (null for an empty set)."""
    for batch in batches:
        for lo, hi, sets, bounds in sets_in(batch.column("text"), shingle):
            size = np.diff(bounds)
            some = np.flatnonzero(size)
            identity, check = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
            bands: list = [None] * (hi - lo)
            if len(some):
                starts = np.append(bounds[some], len(sets))
                identity[some] = grams.mix(np.add.reduceat(grams.mix(sets), starts[:-1]) + size[some].astype(np.uint64))
                check[some] = np.add.reduceat(grams.mix(sets ^ np.uint64(0x5851F42D4C957F2D)), starts[:-1])
                samples = samples_of(sets, starts, BANDED)
                keys = []
                for band in range(BANDED // rows):
                    key = np.full(len(some), band, np.uint64)
                    for j in range(band * rows, (band + 1) * rows):
                        key = grams.mix(key * np.uint64(grams.MULTIPLIERS[0]) + samples[j])
                    keys.append(key.view(np.int64))
                for i, b in zip(some, np.stack(keys, axis=1), strict=True):
                    bands[i] = b
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key")[lo:hi], batch.column("mark")[lo:hi], pa.array(size.astype(np.int64)),
                    pa.array(identity.view(np.int64)), pa.array(check.view(np.int64)), pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["key", "mark", "size", "node", "check", "bands"],
            )


@returning_memory
def sketched(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """Size of the set, sketch and bands of each node, from its (not empty) text."""
    for batch in batches:
        for lo, hi, sets, bounds in sets_in(batch.column("text"), shingle):
            found = sketches_of(samples_of(sets, bounds))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node")[lo:hi], pa.array(np.diff(bounds)), pa.array(list(found), pa.list_(pa.int64())),
                    batch.column("bands")[lo:hi],
                ],
                names=["node", "size", "sketch", "bands"],
            )


def odd_bits(a: str, b: str) -> Column:
    """Bits in which two sketches differ."""
    words = (F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(BITS // 64))
    return sum(words, F.lit(0))


def close_enough(a: str, b: str, similarity: float) -> Column:
    """What a pair of that similarity satisfies: sizes, and odd bits of the XOR of the sketches."""
    sizes = F.least(f"{a}.size", f"{b}.size") >= F.lit(similarity) * F.greatest(f"{a}.size", f"{b}.size") - 1e-9
    return sizes & (odd_bits(a, b) <= most_differing(similarity))


@returning_memory
def cross_pairs(batches: Iterator[pa.RecordBatch], similarity: float, nearest: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of one cell (left rows first, sorted) from different components that the sketches don't rule out.

    ``nearest``: of each left row and each component only the closest, for a block
    of right rows. Otherwise a pair is given in the first bucket that it shares,
    not in the others.
    """
    most = most_differing(similarity)
    cell, left = None, []

    for batch in batches:
        cells = np.stack([batch.column(c).to_numpy() for c in ("bucket", "i", "j")], axis=1)
        side = batch.column("side").to_numpy()
        node, part, size = (batch.column(c).to_numpy() for c in ("node", "component", "size"))
        core = batch.column("core").to_numpy(zero_copy_only=False)
        sketch, bands = (batch.column(c).flatten().to_numpy().reshape(len(batch), -1) for c in ("sketch", "bands"))
        cuts = np.flatnonzero((np.diff(cells, axis=0) != 0).any(axis=1)) + 1
        out = []
        for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(batch)), strict=True):
            if cell is None or (cells[lo] != cell).any():
                cell, left = cells[lo].copy(), []
            middle = lo + int((side[lo:hi] == 0).sum())
            if middle > lo:
                left.append(tuple(x[lo:middle] for x in (node, part, size, sketch, bands)))
            if middle == hi or not left:
                continue
            l_node, l_part, l_size, l_sketch, l_bands = (np.concatenate(x) for x in zip(*left, strict=True))
            for start in range(middle, hi, RIGHT):
                r = slice(start, min(hi, start + RIGHT))
                fits = (l_part[:, None] != part[r]) & (core[r] | (l_node[:, None] < node[r]))
                small, large = np.minimum(l_size[:, None], size[r]), np.maximum(l_size[:, None], size[r])
                fits &= small >= similarity * large - 1e-9
                a, b = np.nonzero(fits)
                odd = np.bitwise_count((l_sketch[a] ^ sketch[r][b]).view(np.uint64)).sum(axis=1, dtype=np.int64)
                a, b, odd = a[odd <= most], b[odd <= most], odd[odd <= most]
                if not nearest:
                    shared = (l_bands[a] == bands[r][b]).argmax(axis=1)
                    here = l_bands[a, shared] == cells[lo, 0]
                    a, b, odd = a[here], b[here], odd[here]
                else:
                    other = part[r][b]
                    order = np.lexsort((b, odd, other, a))
                    a, b, odd, other = a[order], b[order], odd[order], other[order]
                    first = np.ones(len(a), bool)
                    first[1:] = (a[1:] != a[:-1]) | (other[1:] != other[:-1])
                    a, b, odd = a[first], b[first], odd[first]
                out.append((l_node[a], node[r][b], odd))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["a", "b", "odd"]
            )


@returning_memory
def confirm(batches: Iterator[pa.RecordBatch], shingle: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Exact similarity of the full shingle sets of text pairs."""
    percent = round(similarity * 10_000)
    for batch in batches:
        sets = []
        for column in ("text_a", "text_b"):
            sets.append([
                found[bounds[i] : bounds[i + 1]]
                for lo, hi, found, bounds in sets_in(batch.column(column), shingle)
                for i in range(hi - lo)
            ])
        linked = []
        for x, y in zip(*sets, strict=True):
            common = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(10_000 * common >= percent * (len(x) + len(y) - common) and common > 0)
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"]
        )


def near_duplicates(documents: DataFrame, shingle: int = 4, similarity: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document, by Jaccard similarity of its word shingles.

    Last comes the mark of the text (see ``keyed``), for joining back.

    Texts with equal sets are one node. Nodes that agree in a band meet in its
    bucket. First each bucket's members are compared with one random member only
    (a star): by sketch, then of any two components the closest pair on its full
    sets. That joins most of a large group of copies without its pairs. In buckets
    that still hold several components, what lies outside the main one is compared
    with the rest, in cells of bounded size: first the closest pairs, then, for
    what is still apart, all pairs that the sketches don't rule out. Every pair of
    a bucket is thus linked, ruled out or already in one component. Bands miss a
    pair at the threshold less than once in ten million.

    Documents without words have an empty set and are linked with nothing. A null
    doc_id comes before all others (component_id null). Rows that share a doc_id
    get rows of their own. Other columns are not read.
    """
    documents = keyed(documents)
    rows = band_rows(similarity)
    schema = "key long, mark long, size long, node long, check long, bands array<long>"
    signed = stored(documents.mapInArrow(lambda b: signatures(b, shingle, rows), schema), "signatures")
    nodes = stored(
        signed.where("size > 0").groupBy("node", "size", "check")
        .agg(F.min(F.struct("key", "mark")).alias("at"), F.first("bands").alias("bands"))
        .select("node", "size", "at.key", "at.mark", "bands"),
        "nodes",
    )
    banded = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    pivots = (
        banded.groupBy("bucket")
        .agg(F.min(F.struct(F.xxhash64("node", "bucket"), "node")).alias("pivot"), F.count("*").alias("n"))
        .where("n > 1").select("bucket", F.col("pivot.node").alias("pivot"))
    )
    shared = stored(banded.join(stored(pivots, "pivots"), "bucket"), "buckets")
    wanted = stored(
        nodes.select("node", "key", "mark", "bands").join(shared.select("node").distinct(), "node"), "wanted"
    )
    # equal rows of the input give a text twice; the same kind of join whatever the sizes
    texts = stored(
        documents.join(wanted.hint("merge"), ["key", "mark"]).groupBy("node")
        .agg(F.first("text").alias("text"), F.first("bands").alias("bands")),
        "texts",
    )
    light = stored(
        texts.mapInArrow(lambda b: sketched(b, shingle), "node long, size long, sketch array<long>, bands array<long>"), "sketches"
    )
    texts = texts.drop("bands")

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = (
            pairs.select("a", "b").join(texts.withColumnsRenamed({"node": "a", "text": "text_a"}), "a")
            .join(texts.withColumnsRenamed({"node": "b", "text": "text_b"}), "b")
        )
        checked = both.mapInArrow(lambda b: confirm(b, shingle, similarity), "a long, b long, linked boolean")
        return stored(checked.where("linked").select("a", "b"), "confirmed")

    # stars
    stars = shared.where("node <> pivot").select("node", "pivot").distinct()
    close = stored(
        stars.join(light.drop("bands").alias("x"), "node")
        .join(light.drop("bands").withColumnRenamed("node", "pivot").alias("y"), "pivot")
        .where(close_enough("x", "y", similarity))
        .select(F.col("node").alias("a"), F.col("pivot").alias("b"), odd_bits("x", "y").alias("odd")),
        "stars",
    )
    first = close.groupBy("a").agg(F.min(F.struct("odd", "b")).alias("best")).select("a", "best.b")
    links = confirmed(stored(first, "pairs"))
    labels = components(links)
    links = links.union(confirmed(closest(close, labels)))
    labels = components(links)

    # what the stars left open
    for nearest in (True, False):
        crossing = cross_component_pairs(shared, labels, light, similarity, nearest)
        links = links.union(confirmed(closest(crossing, labels) if nearest else crossing))
        labels = components(links)

    smallest = (
        nodes.select("node", "key", "mark").join(labels, "node", "left").groupBy(F.coalesce("component", "node").alias("component"))
        .agg(F.min(F.struct("key", "mark")).alias("smallest"))
    )
    member_of = stored(
        nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        .join(stored(smallest, "smallest"), "component").select("node", "smallest"),
        "member-of",
    )
    out = signed.select("key", "mark", "size", "node").join(member_of, "node", "left")
    first = F.when(F.col("size") > 0, F.col("smallest")).otherwise(F.struct("key", "mark"))
    return out.select(
        id_of(F.col("key")).alias("doc_id"), F.col("size").alias("n_shingles"), id_of(first["key"]).alias("component_id"),
        (F.struct("key", "mark") == first).alias("kept"), "mark",
    )


def closest(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Of any two components the pair (a, b) whose sketches differ least."""
    ends = [
        labels.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}")) for side in ("a", "b")
    ]
    of_a, of_b = F.coalesce("of_a", "a"), F.coalesce("of_b", "b")
    return stored(
        pairs.join(ends[0], "a", "left").join(ends[1], "b", "left").where(of_a != of_b)
        .groupBy(F.least(of_a, of_b), F.greatest(of_a, of_b)).agg(F.min(F.struct("odd", "a", "b")).alias("best"))
        .select("best.a", "best.b"),
        "pairs",
    )


def cross_component_pairs(
    shared: DataFrame, labels: DataFrame, light: DataFrame, similarity: float, nearest: bool
) -> DataFrame:
    """Pairs (a, b, odd) that meet in a bucket, lie in different components and are close by sketch."""
    labelled = shared.join(labels, "node", "left").select(
        "bucket", "node", F.coalesce("component", "node").alias("component")
    )
    parts = labelled.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    main = (
        parts.groupBy("bucket")
        .agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("rows"), F.count("*").alias("parts"))
        .where("parts > 1")
        .select(
            "bucket", F.col("main.component").alias("main"),
            F.ceil((F.col("rows") - F.col("main.n")) / LEFT).alias("lefts"), F.ceil(F.col("rows") / RIGHT).alias("rights"),
        )
    )
    members = stored(
        labelled.join(stored(main, "open"), "bucket")
        .withColumn("core", F.col("component") == F.col("main")).join(light, "node"),
        "members",
    )
    spot = F.xxhash64("node")
    columns = ["bucket", "node", "component", "core", "size", "sketch", "bands"]
    lefts = members.where("not core").select(
        *columns, F.lit(0).alias("side"), F.pmod(spot, "lefts").alias("i"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("rights") - 1)).alias("j"),
    )
    rights = members.select(
        *columns, F.lit(1).alias("side"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("lefts") - 1)).alias("i"), F.pmod(spot, "rights").alias("j"),
    )
    order = ["bucket", "i", "j"]
    found = (
        lefts.unionByName(rights).repartition(*order).sortWithinPartitions(*order, "side")
        .mapInArrow(lambda b: cross_pairs(b, similarity, nearest), "a long, b long, odd long")
    )
    return stored(found.groupBy("a", "b").agg(F.min("odd").alias("odd")), "crossing")
