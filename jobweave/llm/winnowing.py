"""Benchmark decontamination by winnowing, with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.llm.store import id_of, keyed, stored

WINDOW = 13
GRAM = 7
#: Fingerprints of the benchmark that are sent to every task (8 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words once A-Z are lower case: ASCII but for digits and a-z.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, also where ``use`` has loops."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, GAPS), lambda w: w != "")


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def window_minima(hashes: Column, window: int, gram: int) -> Column:
    """Of each ``window`` neighbouring words the smallest ``gram``-word hash; empty for fewer words.

    Equal windows have equal minima, so whoever shares a window shares a minimum.
    """
    return F.when(
        F.size(hashes) >= window,
        let(
            F.transform(F.sequence(F.lit(1), F.size(hashes) - (gram - 1)), lambda i: F.xxhash64(F.slice(hashes, i, gram))),
            lambda grams: F.transform(
                F.sequence(F.lit(1), F.size(hashes) - (window - 1)),
                lambda i: F.array_min(F.slice(grams, i, window - gram + 1)),
            ),
        ),
    ).otherwise(F.array().cast("array<long>"))


def short_grams(hashes: Column, length: int) -> Column:
    """Hashes of all runs of ``length`` words."""
    return F.when(
        F.size(hashes) >= length,
        F.transform(
            F.sequence(F.lit(1), F.size(hashes) - (length - 1)), lambda i: F.xxhash64(F.lit(length), F.slice(hashes, i, length))
        ),
    ).otherwise(F.array().cast("array<long>"))


def benchmark_windows(benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """item_id, words of each window, its length and its fingerprint.

    The windows of an item are built in one go and only then become rows, so no
    row carries a whole item.
    """
    items = benchmark.select("item_id", words_of(F.col("text").cast("string")).alias("words")).where(F.size("words") > 0)
    full = let(
        F.col("words"),
        lambda words: let(
            let(hashed(words), lambda hashes: window_minima(hashes, window, gram)),
            lambda minima: F.transform(
                minima, lambda x, i: F.struct(F.lit(window).alias("length"), F.slice(words, i + 1, window).alias("sequence"), x.alias("print"))
            ),
        ),
    )
    short = F.array(
        F.struct(F.size("words").alias("length"), F.col("words").alias("sequence"), F.xxhash64(F.size("words"), hashed(F.col("words"))).alias("print"))
    )
    return items.select("item_id", F.explode(F.when(F.size("words") >= window, full).otherwise(short)).alias("w")).select("item_id", "w.*")


def prints_of(hashes: Column, length: int, window: int, gram: int) -> Column:
    """Fingerprint of the window at each word, for windows of ``length`` words."""
    return window_minima(hashes, window, gram) if length == window else short_grams(hashes, length)


def distinct_prints(text: Column, length: int, window: int, gram: int) -> Column:
    return let(hashed(words_of(text)), lambda h: F.array_distinct(prints_of(h, length, window, gram)))


def placed_prints(text: Column, length: int, window: int, gram: int) -> Column:
    """Place (from 1) and fingerprint of every window of ``length`` words."""
    return let(
        hashed(words_of(text)),
        lambda h: F.transform(prints_of(h, length, window, gram), lambda x, i: F.struct((i + 1).alias("at"), x.alias("print"))),
    )


def windows_at(text: Column, length: int) -> Column:
    """The windows of ``length`` words at ``places``, with place and fingerprint."""
    return let(
        words_of(text),
        lambda words: F.transform(
            "places", lambda p: F.struct(p["at"].alias("at"), p["print"].alias("print"), F.slice(words, p["at"], length).alias("sequence"))
        ),
    )


def hit_windows(documents: DataFrame, windows: DataFrame, window: int, gram: int) -> DataFrame:
    """key, mark, first word, length and words of each window of ``keyed`` documents that is among ``windows``.

    First the documents that share a fingerprint are found, from each document's
    distinct ones; then the places of shared fingerprints in these documents; then
    the windows there, compared word by word. Rows carry a place and a hash, or
    one window, and never a whole text.
    """
    lengths = sorted(r.length for r in windows.select("length").distinct().collect())  # at most ``window`` numbers
    prints = windows.select("print").distinct()
    if prints.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        prints = F.broadcast(prints)
    everything = [distinct_prints(F.col("text"), n, window, gram) for n in lengths] or [F.array().cast("array<long>")]
    candidates = (
        documents.select("key", "mark", F.explode(F.array_distinct(F.concat(*everything))).alias("print"))
        .join(prints, "print").select("key", "mark").distinct()
    )
    chosen = stored(documents.join(stored(candidates, "candidates"), ["key", "mark"]).dropDuplicates(["key", "mark"]), "chosen")
    rows = []
    for n in lengths or [window]:
        placed = chosen.select("key", "mark", F.explode(placed_prints(F.col("text"), n, window, gram)).alias("p")).select("key", "mark", "p.*")
        places = placed.join(prints, "print").groupBy("key", "mark").agg(F.collect_list(F.struct("at", "print")).alias("places"))
        rows.append(
            chosen.join(places, ["key", "mark"]).select("key", "mark", F.explode(windows_at(F.col("text"), n)).alias("w"), F.lit(n).alias("length"))
            .select("key", "mark", "w.*", "length")
        )
    merged = rows[0]
    for other in rows[1:]:
        merged = merged.unionByName(other)
    sequences = windows.select("print", "length", "sequence").distinct()
    return stored(merged.join(sequences, ["print", "length", "sequence"]).select("key", "mark", "at", "length", "sequence"), "hits")


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids of the items found, sorted as strings), the mark of the text and contaminated, per document.

    A window is ``window`` neighbouring words of an item; an item of fewer words
    is one window. Of each window the smallest hash of ``gram`` words is kept, for
    items and documents alike, and joined; documents that share one are compared
    word by word and the windows that are really equal extend to the words they
    cover. A shared window is never missed. Items of fewer words than a window are
    looked for by the hash of all their words.

    Contaminated: some word is hit, and 20 hit words make up the number of words
    at least. Null and empty texts have no words. Items without words and null
    item_ids don't count as items. Rows with a repeated id and text get equal
    rows. Other columns are not read.
    """
    documents = keyed(documents)
    benchmark = benchmark.where("item_id is not null")
    windows = stored(benchmark_windows(benchmark, window, gram), "windows")
    hits = hit_windows(documents, windows, window, gram)
    covered = F.aggregate(
        F.sort_array(F.collect_set(F.struct("at", (F.col("at") + F.col("length")).alias("end")))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda seen, x: F.struct(
            (seen["n"] + F.greatest(x["end"] - F.greatest(x["at"], seen["to"]), F.lit(0))).cast("long").alias("n"),
            F.greatest(seen["to"], x["end"]).alias("to"),
        ),
        lambda seen: seen["n"],
    )
    words_hit = hits.groupBy("key", "mark").agg(covered.alias("n_hit"))
    items = (
        hits.select("key", "mark", "sequence").distinct()
        .join(windows.select("item_id", "sequence").distinct(), "sequence")
        .groupBy("key", "mark").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    found = stored(words_hit.join(items, ["key", "mark"]), "found")
    sizes = documents.select("key", "mark", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    out = sizes.join(found, ["key", "mark"], "left").select(
        id_of(F.col("key")).alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), "mark",
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
