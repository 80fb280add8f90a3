"""VEC4 for a table of profiles: postings by how many of a profile's terms they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.operators.search import SKILL_COLUMNS
from jobweave.operators.staging import top_per_key
from jobweave.operators.textjoin import SALTS, contains_join
from jobweave.session import materialize_once

#: Stands between the columns of a posting, so that no term is found across two of them.
BREAK = "\x01"


def named_terms(jobs: DataFrame, key: str, terms: DataFrame, columns: list[str] = SKILL_COLUMNS) -> DataFrame:
    """(key, terms): for each posting that names any, the sorted terms of the table ``terms(term)`` that it names."""
    texts = jobs.select(key, F.concat_ws(BREAK, *columns).alias("_text"))
    found = contains_join(texts, key, "_text", terms, "term")
    return found.groupBy(key).agg(F.sort_array(F.collect_set("value")).alias("terms"))


def pairs_by_rare_terms(asked: DataFrame, classes: DataFrame, rarity: DataFrame, reach: Column) -> DataFrame:
    """(query, class, score) of the pairs that share one of the query's ``reach`` rarest terms and a visa category.

    A pair comes out once, at its rarest shared term. Equi-join on term and visa
    category, the classes of one such key dealt over SALTS parts.
    """
    ranked = (
        asked.select("query", F.explode("terms").alias("term")).join(rarity, "term", "left")
        .groupBy("query")
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("ranked"))
        .select("query", F.col("ranked.term").alias("ranked"))
    )
    wide = asked.join(ranked, "query").withColumn("first", F.slice("ranked", F.lit(1), F.greatest(reach, F.lit(1))))
    left = (
        wide.select("query", "ranked", "visas", F.explode("first").alias("term"))
        .select("query", "ranked", "term", F.explode("visas").alias("visa"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    right = classes.select(
        "class", "visa", F.col("terms").alias("named"), F.explode("terms").alias("term"),
        F.pmod(F.xxhash64("class"), F.lit(SALTS)).cast("int").alias("salt"),
    )
    shared = F.array_intersect("ranked", "named")
    met = left.join(right, ["term", "visa", "salt"]).where(F.element_at(shared, 1) == F.col("term"))
    return met.select("query", "class", F.size(shared).alias("score"))


def search_by_profiles(
    jobs: DataFrame, profiles: DataFrame, days_back: int, limit: int, profile: str = "profile", tie_break: str = "url"
) -> DataFrame:
    """(profile, key, relevance_score): for each profile the best ``limit`` recent postings that it may apply to.

    ``profiles`` has the profile's id, ``terms`` and ``visas`` (arrays); ``tie_break``
    is unique in ``jobs``. The score is the number of distinct terms that title,
    description or qualifications name, in any case; ties go to the newer posting.
    As in ``search_by_terms``, a profile without terms gets the newest postings,
    with score 0, and postings that name no term are left out otherwise. Terms
    are trimmed; blank and null terms and null visa categories don't count.
    A profile without visa categories gets nothing.

    Exact, without a pair of each profile and posting. Equal profiles are one
    query, and postings of one visa category that name the same terms are one
    class, of which only the newest ``limit`` can be needed. A query first meets
    the classes that name its rarest term. If these hold ``limit`` postings with a score
    of s or more, a better class misses at most m - s of the query's m terms, so it
    names one of the m - s + 1 rarest: the commoner terms are not looked up.
    """
    newest = [F.col("days_since_posted").asc_nulls_last(), F.col(tie_break)]
    clean = F.filter(F.transform("terms", lambda t: F.lower(F.trim(t))), lambda t: t != "")
    asked = profiles.select(
        F.col(profile).alias("profile"),
        F.sort_array(F.array_distinct(F.coalesce(clean, F.array().cast("array<string>")))).alias("terms"),
        F.sort_array(F.array_distinct(F.array_compact(F.coalesce("visas", F.array().cast("array<string>"))))).alias("visas"),
    ).withColumn("query", F.sha2(F.to_json(F.struct("terms", "visas")), 256))
    asked = materialize_once(asked, "profiles")
    queries = materialize_once(asked.groupBy("query").agg(F.first("terms").alias("terms"), F.first("visas").alias("visas")), "queries")
    with_terms, without = queries.where(F.size("terms") > 0), queries.where(F.size("terms") == 0)

    open_rows = jobs.where(F.col("days_since_posted") <= days_back).select(
        tie_break, "days_since_posted", F.col("visa_category").alias("visa"), *SKILL_COLUMNS
    )
    wanted = queries.select(F.explode("visas").alias("visa")).distinct()
    open_rows = open_rows.join(wanted, "visa", "left_semi")
    named = named_terms(open_rows, tie_break, with_terms.select(F.explode("terms").alias("term")).distinct())
    rows = open_rows.drop(*SKILL_COLUMNS)
    # the newest postings of each class, and those of each category for profiles without terms
    members = materialize_once(
        top_per_key(rows.join(named, tie_break), ["visa", "terms"], newest, limit)
        .withColumn("class", F.sha2(F.to_json(F.struct("visa", "terms")), 256)),
        "members",
    )
    first = F.min(F.struct(F.col("days_since_posted").alias("days"), F.col(tie_break).alias("id")))
    classes = materialize_once(
        members.groupBy("class").agg(
            F.first("visa").alias("visa"), F.first("terms").alias("terms"), F.count(F.lit(1)).alias("n"), first.alias("newest")
        ),
        "classes",
    )
    rarity = classes.select("n", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("n").alias("n"))

    # the score that the limit-th posting reaches among those of the rarest term; 1 where they are too few
    some = pairs_by_rare_terms(with_terms, classes, rarity, F.lit(1)).join(classes.select("class", "n"), "class")
    per_score = some.groupBy("query", "score").agg(F.sum("n").alias("n"))
    above = F.aggregate(
        F.sort_array(F.collect_list(F.struct("score", "n")), asc=False),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reached")),
        lambda state, x: F.struct(
            (state["n"] + x["n"]).alias("n"),
            F.when((state["reached"] == 0) & (state["n"] + x["n"] >= limit), x["score"]).otherwise(state["reached"]).alias("reached"),
        ),
    )
    reached = per_score.groupBy("query").agg(above["reached"].alias("reached"))
    bounded = with_terms.join(reached, "query", "left").withColumn("reached", F.greatest(F.coalesce("reached", F.lit(1)), F.lit(1)))
    pairs = pairs_by_rare_terms(bounded, classes, rarity, F.size("ranked") - F.col("reached") + 1)
    # a class beyond the first ``limit`` by its newest posting has that many better postings before it
    best = top_per_key(
        pairs.join(classes.select("class", "newest"), "class"), ["query"], [F.col("score").desc(), F.col("newest"), F.col("class")], limit
    ).select("query", "class", "score")
    hits = best.join(members.select("class", tie_break, "days_since_posted"), "class").drop("class")
    recent = top_per_key(rows, ["visa"], newest, limit)
    plain = without.select("query", F.explode("visas").alias("visa")).join(recent, "visa").select("query", F.lit(0).alias("score"), tie_break, "days_since_posted")
    # written, so that its size is known: many profiles may share few queries, and each makes ``limit`` rows in its own task
    ranked = materialize_once(top_per_key(hits.unionByName(plain), ["query"], [F.col("score").desc(), *newest], limit), "ranked")
    return asked.select("profile", "query").join(ranked, "query").select("profile", tie_break, F.col("score").alias("relevance_score"))
