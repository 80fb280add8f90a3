"""Sharding by a k-d tree with distributed weighted medians, with built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.llm.store import id_of, keyed, stored

#: Buckets of a histogram round, for each node.
BUCKETS = 1024
#: A cut is fine once the bucket around it holds this part of its node's bytes.
FINE = 0.0005
#: Part of a shard that copies of one text may fill before they are dealt to several places.
LARGEST_GROUP = 0.05
#: Rows that are numbered in one group.
NUMBERED = 4096
#: Dimensions of a document: log2 of its bytes, characters beyond ASCII and lines, in thousandths.
DIMENSIONS = ["bytes", "wide", "lines"]
HASH_BITS = 44


@dataclass
class Node:
    """Shards [first, end) still in one piece, and where it is to be cut."""

    first: int
    end: int
    weight: int = 0
    dimension: str = ""
    low: int = 0
    high: int = 0
    below: int = 0

    def goal(self) -> float:
        return self.weight * ((self.first + self.end) // 2 - self.first) / (self.end - self.first)


def scaled(value: Column) -> Column:
    return F.floor(1000 * F.log2(value + 1)).cast("long")


def place(dimension: str) -> Column:
    """Order along a dimension; ties by the text's hash and part, so that equal texts stay together."""
    return F.shiftleft(F.col(dimension), HASH_BITS) + F.col("spot")


def by_node(nodes: list[Node], value) -> Column:
    out = F.lit(None).cast("long")
    for n in nodes:
        out = F.when(F.col("node") == n.first, value(n)).otherwise(out)
    return out


def histogram(texts: DataFrame, nodes: list[Node]) -> dict[int, dict[int, int]]:
    """Bytes in each bucket of the nodes' open ranges; at most BUCKETS numbers a node come to the driver."""
    here = by_node(nodes, lambda n: place(n.dimension))
    low, step = (by_node(nodes, f) for f in (lambda n: F.lit(n.low), lambda n: F.lit(step_of(n))))
    rows = (
        texts.where(F.col("node").isin([n.first for n in nodes])).withColumn("here", here)
        .where((F.col("here") >= by_node(nodes, lambda n: F.lit(n.low))) & (F.col("here") < by_node(nodes, lambda n: F.lit(n.high))))
        .groupBy("node", F.floor((F.col("here") - low) / step).cast("long").alias("bucket")).agg(F.sum("weight").alias("weight"))
    )
    out: dict[int, dict[int, int]] = {n.first: {} for n in nodes}
    for r in rows.collect():
        out[r.node][r.bucket] = r.weight
    return out


def step_of(n: Node) -> int:
    # a power of two: the division below is then exact
    return 1 << max(0, -(-(n.high - n.low) // BUCKETS) - 1).bit_length()


def cuts(texts: DataFrame, nodes: list[Node]) -> dict[int, int]:
    """Weighted median (by the nodes' goals) of all nodes of a level, by ever finer histograms."""
    open_nodes, out = list(nodes), {}
    while open_nodes:
        bars = histogram(texts, open_nodes)
        following = []
        for n in open_nodes:
            step, below, chosen = step_of(n), n.below, None
            for bucket, weight in sorted(bars[n.first].items()):
                chosen = (bucket, weight)
                if below + weight >= n.goal():
                    break
                below += weight
            if chosen is None:
                out[n.first] = n.high
                continue
            bucket, weight = chosen
            low, high = n.low + bucket * step, n.low + (bucket + 1) * step
            if step == 1 or weight <= FINE * n.weight:
                out[n.first] = high if n.goal() - below > weight / 2 else low
            else:
                n.low, n.high, n.below = low, high, below
                following.append(n)
        open_nodes = following
    return out


def kd_shards(documents: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, shard and slot of each document.

    The tree's items are distinct texts with the bytes of all their copies. From
    the root on, a node is cut along the dimension in which it is widest, at the
    median by bytes, until each leaf is one shard; all nodes of a level are cut
    together, from histograms (at most BUCKETS numbers a node and round reach the
    driver, whatever the input). Equal texts share a shard, but for a text whose
    copies fill over LARGEST_GROUP of a shard: these are dealt by doc_id into
    parts below that (there can be no more than shards / LARGEST_GROUP such texts).

    Null and empty texts have size 1. A null doc_id and repeated rows are
    documents like others, each with a slot. Other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = stored(
        keyed(documents).select(
            "key", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("hash"), scaled(F.octet_length(text)).alias("bytes"),
            scaled(F.octet_length(text) - F.char_length(text)).alias("wide"),
            scaled(F.size(F.split(text, "\n")) - 1).alias("lines"),
        ),
        "rows",
    )
    copies = rows.groupBy("hash", "text_crc32").agg(F.sum("size").alias("weight"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    most = max(1.0, LARGEST_GROUP * total / shards)
    large = copies.where(F.col("weight") > most).select("hash", "text_crc32", F.ceil(F.col("weight") / most).alias("parts"))
    # at most shards / LARGEST_GROUP rows, as all weights add up to the total
    parted = rows.join(F.broadcast(large), ["hash", "text_crc32"], "left").withColumn(
        "part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("key"), "parts")).otherwise(F.lit(0))
    )
    mask = (1 << HASH_BITS) - 1
    spotted = parted.withColumn("spot", F.xxhash64("hash", "text_crc32", "part").bitwiseAND(mask))
    texts = stored(
        spotted.groupBy("hash", "text_crc32", "part", "spot", *DIMENSIONS).agg(F.sum("size").alias("weight")), "texts"
    )
    shard = F.lit(0).cast("int")
    level = [Node(0, shards)] if shards > 1 else []
    while level:
        here = texts.withColumn("node", shard)
        limits = {
            r.node: r
            for r in here.groupBy("node").agg(
                F.sum("weight").alias("weight"), *(f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("min", F.min), ("max", F.max)))
            ).collect()  # a row a node
        }
        level = [n for n in level if n.first in limits]
        for n in level:
            r = limits[n.first]
            n.weight = r.weight
            n.dimension = max(DIMENSIONS, key=lambda d: (r[f"max_{d}"] - r[f"min_{d}"], -DIMENSIONS.index(d)))
            n.low, n.high = r[f"min_{n.dimension}"] << HASH_BITS, (r[f"max_{n.dimension}"] + 1) << HASH_BITS
        found = cuts(here, level)
        following = []
        deeper = shard
        for n in level:
            middle = (n.first + n.end) // 2
            deeper = F.when((shard == n.first) & (place(n.dimension) >= found[n.first]), F.lit(middle)).otherwise(deeper)
            following += [Node(a, b) for a, b in ((n.first, middle), (middle, n.end)) if b - a > 1]
        shard, level = deeper, following
    dealt = spotted.select("key", "size", "text_crc32", shard.cast("int").alias("shard"))
    groups = max(1, -(-rows.count() // NUMBERED))
    numbered = stored(
        dealt.withColumn("group", F.pmod(F.xxhash64("key", "text_crc32"), F.lit(groups)))
        .withColumn("nth", F.row_number().over(Window.partitionBy("shard", "group").orderBy("key", "text_crc32"))),
        "numbered",
    )
    counts = numbered.groupBy("shard", "group").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return numbered.join(offsets, ["shard", "group"]).select(
        id_of(F.col("key")).alias("doc_id"), "size", "text_crc32", "shard", (F.col("offset") + F.col("nth") - 1).cast("long").alias("slot")
    )
