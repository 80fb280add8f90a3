"""FLT2, JN10: texts joined with a table of values that they contain.

A value is looked for only in the texts that hold its rarest gram, a stretch of
as many characters as the value's length allows: texts and values meet by an
equi-join on that gram, and what meets is compared. No pair of a text and a
value is formed otherwise.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobweave.session import bounded_batches, materialize_once

GRAM = 3
#: A value's grams are the longest of these multiples of the shortest gram that fit into it; long ones tell alike values apart.
GRAM_STEPS = (1, 2, 4)
#: Up to so many values go to every task; more are shuffled, as are the grams of the texts.
BROADCAST_VALUES = 100_000
#: So few values of like length are compared with every text.
PLAIN_VALUES = 64
#: Parts that the texts of one gram are dealt over where the values are too many to broadcast.
SALTS = 16


def grams_of(text: Column, size: int) -> Column:
    """The distinct stretches of ``size`` characters of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def normal_values(values: DataFrame, value: str) -> DataFrame:
    """Distinct values in lower case without outer blanks; empty ones and nulls go."""
    low = F.lower(F.trim(F.col(value)))
    return values.select(low.alias("value")).where("value <> ''").distinct()


def contains_join(texts: DataFrame, key: str, column: str, values: DataFrame, value: str = "value", gram: int = GRAM) -> DataFrame:
    """(key, value): which values each text contains, in any case; a row for each row of ``texts``.

    ``value`` comes back trimmed and in lower case. Up to BROADCAST_VALUES values
    go to every task, which looks for them text by text: nothing is shuffled.
    More are joined by a shuffle. For each value the gram that the fewest texts
    hold is chosen; a value with a gram that no text holds is dropped at once.
    Rows that are shuffled carry a key and a gram, dealt over SALTS parts in the
    join, so no task gathers a gram that many texts hold; the texts follow once,
    to be compared. Values shorter than a gram are joined by themselves, on the
    texts' stretches of their length. Null texts contain nothing.
    """
    wanted = materialize_once(normal_values(values, value), "values")
    low = texts.select(F.col(key).alias("_key"), F.lower(F.col(column)).alias("_low"))
    few = [r[0] for r in wanted.limit(BROADCAST_VALUES + 1).collect()]
    if len(few) <= BROADCAST_VALUES:
        return _found_in_tasks(low, few, gram).select(F.col("_key").alias(key), "value")
    size = F.char_length("value")
    sizes = [gram * step for step in reversed(GRAM_STEPS)]
    held = low.select("_key", F.explode(F.flatten(F.array(*[grams_of(F.col("_low"), n) for n in sizes]))).alias("gram"))
    each = F.coalesce(*[F.when(size >= n, grams_of(F.col("value"), n)) for n in sizes])
    parts = wanted.where(size >= gram).select("value", F.explode(each).alias("gram"))
    counts = held.join(parts.select("gram").distinct().hint("merge"), "gram").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = materialize_once(
        parts.join(counts, "gram", "left").groupBy("value")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest"))
        .where("rarest.n > 0").select("value", "rarest.gram"),
        "rarest",
    )
    # by the size of their file, before they are dealt out, the values would seem small enough for every task
    salted = rarest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    dealt = held.withColumn("salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int"))
    near = dealt.join(salted, ["gram", "salt"]).select(F.col("_key").alias("_near"), "value").distinct()
    found = near.join(low, F.col("_near").eqNullSafe(F.col("_key"))).where(F.contains("_low", "value")).select("_key", "value")
    short = wanted.where(size < gram)
    stretches = F.concat(*[grams_of(F.col("_low"), n) for n in range(1, gram)]) if gram > 1 else F.array().cast("array<string>")
    brief = low.select("_key", F.explode(stretches).alias("value")).join(short, "value").select("_key", "value")
    return found.unionByName(brief).select(F.col("_key").alias(key), "value")


def _found_in_tasks(low: DataFrame, values: list[str], gram: int) -> DataFrame:
    """(_key, value): the values that each text holds, by the text's grams and then by comparison."""
    if not values:
        return low.select("_key", F.lit("").alias("value")).limit(0)
    if len(values) <= PLAIN_VALUES:
        each = F.filter(F.array(*[F.lit(v) for v in values]), lambda v: F.contains(F.col("_low"), v))
        return low.where("_low is not null").select("_key", F.explode(each).alias("value"))
    bounded_batches(low.sparkSession)
    sizes = [*(gram * step for step in reversed(GRAM_STEPS)), *range(gram - 1, 0, -1)]
    by_size: dict[int, list[str]] = {}
    for v in values:
        by_size.setdefault(next(n for n in sizes if n <= len(v)), []).append(v)
    plain, by_gram = [], {}
    for n, alike in by_size.items():
        if len(alike) <= PLAIN_VALUES:
            plain += alike
            continue
        # a value is filed under the gram that it shares with the fewest others
        common = Counter(v[i : i + n] for v in alike for i in range(len(v) - n + 1))
        filed = by_gram.setdefault(n, {})
        for v in alike:
            filed.setdefault(min((v[i : i + n] for i in range(len(v) - n + 1)), key=lambda g: (common[g], g)), []).append(v)
    held = low.sparkSession.sparkContext.broadcast((plain, by_gram))
    schema = T.StructType([T.StructField("_key", low.schema["_key"].dataType), T.StructField("value", T.StringType())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, by_gram = held.value
        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(batch.column("_low").to_pylist()):
                near = plain
                for n, filed in by_gram.items():
                    grams = {text[i : i + n] for i in range(len(text) - n + 1)} & filed.keys()
                    near = near + [v for g in grams for v in filed[g]]
                hits = [v for v in near if v in text]
                rows += [row] * len(hits)
                found += hits
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key").take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], names=["_key", "value"]
            )

    return low.where("_low is not null").mapInArrow(look, schema)


def containing(df: DataFrame, key: str, column: str, values: DataFrame, value: str = "value") -> DataFrame:
    """The rows whose text contains any of the values."""
    return df.join(contains_join(df, key, column, values, value).select(key).distinct(), key, "left_semi")
