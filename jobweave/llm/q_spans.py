"""Queries of the operators on runs, tokenizers and licenses."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.llm.alignment import align_tokenizers
from jobweave.llm.licenses import scan_licenses
from jobweave.llm.periodic import periodic_runs
from jobweave.llm.winnowing import let
from jobweave.plans.registry import query

WORD_GAPS = r"[\x20\x09-\x0D]+"


def with_planted_runs(doc_id: str, text: str) -> Column:
    """The text; of ids whose crc32 ends in 0 its words, from some word on made periodic."""
    crc = F.crc32(F.col(doc_id).cast("string"))
    g = F.floor(crc / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        return let(
            F.pmod(g, n),
            lambda a: let(
                1 + F.floor((n - a) / (3 + g % 8)),
                lambda p: F.array_join(
                    F.transform(F.sequence(F.lit(0).cast("long"), n - F.lit(1).cast("long")), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))),
                    " ",
                ),
            ),
        )

    words = F.filter(F.split(F.col(text), WORD_GAPS), lambda w: w != "")
    return F.when(crc % 10 == 0, let(words, lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(F.lit("")))).otherwise(F.col(text))


#: The crc32 of a document's id: a table by byte, then one step a character.
CRC_SQL = """
    crc_table AS (
        SELECT list(x8 ORDER BY x) AS t FROM (
            SELECT x, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END AS x1,
                {steps}
            FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS x)
        )
    ),
    crc AS (
        SELECT doc_id, any_value(xor(list_reduce(
            list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
            lambda a, c: xor(a // 256, t[(xor(a, c) % 256) + 1])
        ), 4294967295)) AS h
        FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), crc_table GROUP BY doc_id
    )
""".format(steps=", ".join(f"CASE WHEN x{i} % 2 = 1 THEN xor(x{i} // 2, 3988292384) ELSE x{i} // 2 END AS x{i + 1}" for i in range(1, 8)))


@query(
    "op11_suffix_tree_runs",
    f"""
    WITH {CRC_SQL},
    d AS (
        SELECT row_number() OVER () AS r, doc_id, h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
        FROM documents LEFT JOIN crc USING (doc_id)
    ),
    n AS (SELECT r, doc_id, h, w, len(w) AS n, (h // 10) % nullif(len(w), 0) AS a FROM d),
    p AS (
        SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN
            list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) ELSE w END AS w
        FROM n
    ),
    g AS (SELECT r, i, array_to_string(w[i + 1:i + 6], ' ') AS s FROM (SELECT r, w, unnest(range(n - 5)) AS i FROM p WHERE n >= 12)),
    pairs AS (SELECT a.r, a.i, b.i - a.i AS q FROM g a JOIN g b ON a.r = b.r AND a.s = b.s AND a.i < b.i),
    islands AS (
        SELECT r, q, min(i) AS start, count(*) + q + 5 AS length
        FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs) GROUP BY r, q, island
    ),
    runs AS (SELECT r, start, length, min(q) AS period FROM islands WHERE length >= greatest(12, 2 * q) GROUP BY ALL),
    top AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length DESC, start, period) = 1),
    lists AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s FROM runs GROUP BY r),
    gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
    kept AS (
        SELECT r, string_agg(x, ' ' ORDER BY i) AS s FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM p) ANTI JOIN gone USING (r, i) GROUP BY r
    )
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
        sha256(coalesce(lists.s, '')) AS runs_sha256, sha256(coalesce(kept.s, '')) AS collapsed_sha256
    FROM p LEFT JOIN top USING (r) LEFT JOIN lists USING (r) LEFT JOIN kept USING (r)
    """,
)
def op11_suffix_tree_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = periodic_runs(documents.select("doc_id", with_planted_runs("doc_id", "text").alias("text")), shortest=12)
    longest = F.array_max(F.transform("runs", lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("start"), (-x["period"]).alias("period"))))
    written = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n")))
    return out.withColumn("top", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), "top.length",
        (-F.col("top.period")).alias("period"), F.expr("1000 * top.length div -top.period").alias("exponent_milli"),
        F.sha2(F.array_join(written, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op12_lockstep_alignment")
def op12_lockstep_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a, b = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align_tokenizers(documents, a, b).drop("groups", "mark")


@query("op13_license_signatures")
def op13_license_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("found", lambda x: x["base"])
    return out.withColumn("base", base).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.first").alias("first_word"), F.array_max("base.first").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base.label")), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score",
    )
