"""FLT14, VEC9 for a table of stored searches: an index of their conditions.

A search has levels, exact to broad; a level has groups, one for each field that
it restricts; a group has terms, of which one must match. As a table: a row for
(search, level, field, term).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.operators.staging import top_per_key
from jobweave.operators.textjoin import contains_join
from jobweave.session import materialize_once


@dataclass(frozen=True)
class Field:
    """A column that searches restrict: a term must be contained in it, or equal it."""

    column: str
    exact: bool = False


def text_hits(jobs: DataFrame, name: str, field: Field, conditions: DataFrame) -> DataFrame:
    """(ask, text): for each group on a field the distinct texts of the column that it accepts."""
    asked = conditions.where(F.col("field") == name)
    if field.exact:
        return asked.select("ask", F.col("term").alias("text")).distinct()
    texts = jobs.select(F.col(field.column).alias("text")).where("text is not null").distinct().withColumn("text_id", F.xxhash64("text"))
    texts = materialize_once(texts.groupBy("text").agg(F.first("text_id").alias("text_id")), "texts")
    found = contains_join(texts.select("text", F.struct("text_id", "text").alias("id")), "id", "text", asked, "term")
    low = F.lower(F.trim("term"))
    return (
        asked.select("ask", low.alias("value")).distinct().join(found, "value")
        .select("ask", F.col("id.text").alias("text")).distinct()
    )


def match_searches(
    jobs: DataFrame, conditions: DataFrame, fields: dict[str, Field], order: list[Column], key: str, n: int
) -> DataFrame:
    """search, level and the columns of ``jobs``: for each search its first ``n`` rows at the first level that finds any.

    ``conditions`` has search, level, field (a name in ``fields``) and term; blank
    terms are left out, and a group without terms restricts nothing. ``order``
    ends in a unique column; ``key`` is unique.

    Levels with the same conditions, of whatever searches, are one: its rows are
    found once, and each search takes those of its lowest level that has any.
    Rows that agree in all searched fields match the same searches, so only the
    first ``n`` of each such class are looked at: a combination that a third of
    all rows share becomes ``n`` rows. For levels that restrict only some of the
    fields, only the first ``n`` rows that agree in these are. Terms meet a
    column's distinct texts by ``contains_join``. Each level starts from its
    group that the fewest classes satisfy and is narrowed by its other groups, all
    by equi-joins; its rows are cut to ``n`` before their shuffle.
    """
    columns = {name: f.column for name, f in fields.items()}
    classes = materialize_once(top_per_key(jobs, list(columns.values()), order, n), "classes")
    kept = conditions.select("search", "level", "field", "term").where(F.col("field").isin(list(fields)) & (F.trim("term") != ""))
    asked = kept.groupBy("search", "level").agg(F.sort_array(F.collect_set(F.struct("field", "term"))).alias("groups"))
    asked = asked.where("search is not null and level is not null").withColumn("ask", F.sha2(F.to_json("groups"), 256))
    asked = materialize_once(asked, "conditions")
    asks = materialize_once(asked.groupBy("ask").agg(F.first("groups").alias("groups")), "asks")
    terms = asks.select("ask", F.explode("groups").alias("x")).select("ask", "x.*")
    hits = {name: materialize_once(text_hits(classes, name, f, terms), "hits") for name, f in fields.items()}
    # how many classes each group accepts; groups that accept none have no row
    sizes = None
    for name, column in columns.items():
        per_text = classes.groupBy(F.col(column).alias("text")).agg(F.count(F.lit(1)).alias("n"))
        size = hits[name].join(per_text, "text").groupBy("ask").agg(F.sum("n").alias("n")).withColumn("field", F.lit(name))
        sizes = size if sizes is None else sizes.unionByName(size)
    needs = asks.select("ask", F.array_distinct("groups.field").alias("needs"))
    starts = sizes.groupBy("ask").agg(F.min(F.struct("n", "field")).alias("start"), F.count(F.lit(1)).alias("found"))
    plan = materialize_once(
        needs.join(starts, "ask").where(F.size("needs") == F.col("found"))
        .select("ask", "needs", F.concat_ws(",", "needs").alias("kind"), F.col("start.field").alias("start")),
        "plan",
    )
    slim = [key, *[F.col(c).alias(f"_{name}") for name, c in columns.items()]]
    # one row for each set of restricted fields that occurs
    kinds = sorted(tuple(r[0]) for r in plan.select("needs").distinct().collect())
    pools = None
    for kind in kinds:
        pool = top_per_key(classes, [columns[name] for name in kind], order, n).select(F.lit(",".join(kind)).alias("kind"), *slim)
        pools = pool if pools is None else pools.unionByName(pool)
    if pools is None:
        pools = classes.select(F.lit("").alias("kind"), *slim).limit(0)
    pools = materialize_once(pools, "pools")
    near = None
    for name in fields:
        driven = plan.where(F.col("start") == name).join(hits[name], "ask").withColumnRenamed("text", f"_{name}")
        rows = driven.join(pools, ["kind", f"_{name}"]).select("ask", "needs", "start", *pools.drop("kind").columns)
        near = rows if near is None else near.unionByName(rows)
    for name in fields:
        accepted = hits[name].select("ask", F.col("text").alias(f"_{name}"), F.lit(True).alias("_ok"))
        open_to = ~F.array_contains("needs", name) | (F.col("start") == name) | F.col("_ok")
        near = near.join(accepted, ["ask", f"_{name}"], "left").where(open_to).drop("_ok")
    matched = near.select("ask", key).join(classes, key)
    best = materialize_once(top_per_key(matched, ["ask"], order, n), "best")
    lowest = asked.select("search", "level", "ask").join(best.select("ask").distinct(), "ask").groupBy("search").agg(F.min_by("ask", "level").alias("ask"), F.min("level").alias("level"))
    return lowest.join(best, "ask").drop("ask")
