"""TXT7-TXT11: entities, intent and running state of conversations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.functions.text import strip
from jobweave.operators.staging import top_per_key
from jobweave.session import materialize_once

# ---------------------------------------------------------------- fixed values
COMPANIES = [
    "amazon", "google", "microsoft", "meta", "facebook", "apple", "netflix", "uber", "airbnb", "stripe",
    "salesforce", "oracle", "ibm", "intel", "nvidia", "adobe", "cisco", "dell", "hp", "snowflake", "databricks",
    "openai", "tesla", "twitter", "linkedin", "dropbox", "spotify", "servicenow", "amgen", "gilead", "hdr",
]
LOCATIONS = [
    "boston", "seattle", "san francisco", "new york", "nyc", "bay area", "austin", "chicago", "denver",
    "los angeles", "la", "california", "massachusetts", "texas", "washington", "remote", "portland", "atlanta",
    "miami", "silicon valley", "palo alto", "mountain view", "sunnyvale",
]
JOB_TITLES = [
    "software engineer", "data scientist", "data analyst", "machine learning", "ml engineer", "product manager",
    "devops", "frontend", "backend", "full stack", "data engineer", "senior engineer", "principal engineer",
    "staff engineer", "engineering manager",
]
COMPANY_SUFFIX = r"(?:,?\s*(?:inc\.?|corp\.?|llc|ltd\.?))?"
INTENTS = [
    ("comparison", "compare|vs|versus|difference|better|which|or"),
    ("contact", "contact|email|phone|attorney|lawyer|reach|law firm"),
    ("salary", "salary|pay|wage|compensation|how much|earn"),
    ("h1b_sponsorship", "sponsor|h-?1b|h1b|visa|approval rate|safe"),
    ("job_search", "job|jobs|position|opening|role|find|search|looking|show me|list"),
    ("resume", "resume|cv|analyze|review|feedback|match"),
    ("career", "career|advice|should i|transition|path|growth"),
    ("follow_up", "what about|and|also|more|tell me more|what else"),
]
COMPANY_REFERENCES = "they|it|them|that company"
LOCATION_REFERENCES = "there|that place|that city"
LISTED_COMPANY = r"(?m)^[\d\-\*]+\s*(.+?)(?:,|\n|$)"
AT_COMPANY = r"\bat\s+([A-Z][a-zA-Z\s&,\.]+?)(?:\s+in|\s+for|\n|\||$)"
NAME_NOISE = ["**", "Inc.", "LLC", "d/b/a"]
# ------------------------------------------------------------ end fixed values

ENTITY_TYPES = ["companies", "locations", "job_titles"]
KEEP = 5
MAX_TURNS = 10


def _words(alternatives: str) -> str:
    # U: word boundaries follow Unicode letters, so "la" is not found inside "éla"
    return rf"(?iU)\b({alternatives})\b"


def mentions(text: Column, vocabulary: list[str], suffix: str = "") -> Column:
    """Names of the vocabulary found in ``text``, lower-cased, each once, in order."""
    pattern = rf"(?iU)\b({'|'.join(vocabulary)}){suffix}\b"
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))
    return F.array_distinct(F.transform(found, F.lower))


def entities(
    text: Column,
    companies: list[str] = COMPANIES,
    locations: list[str] = LOCATIONS,
    job_titles: list[str] = JOB_TITLES,
) -> dict[str, Column]:
    """TXT7"""
    return {
        "companies": mentions(text, companies, COMPANY_SUFFIX),
        "locations": mentions(text, locations),
        "job_titles": mentions(text, job_titles),
    }


def intent(text: Column, ladder: list[tuple[str, str]] = INTENTS) -> Column:
    """TXT8: the first intent whose words occur."""
    label = F.lit("general")
    for name, words in reversed(ladder):
        label = F.when(text.rlike(_words(words)), name).otherwise(label)
    return label


def remember(known: list[str], new: list[str], keep: int = KEEP) -> list[str]:
    """Queue of the last ``keep`` distinct names; a known name keeps its place."""
    for name in new:
        if name not in known:
            known = (known + [name])[-keep:]
    return known


def _fold(keep: int):
    """Running state over rows sorted by conversation and turn; memory is one state."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, seen = None, [], 0
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.conv_id != current:
                    current = row.conv_id
                    state = [list(getattr(row, f"start_{t}")) for t in ENTITY_TYPES]
                    seen = row.start_seen
                before = state
                state = [remember(s, list(getattr(row, t)), keep) for s, t in zip(state, ENTITY_TYPES)]
                seen += 1
                out.append(
                    (row.conv_id, row.turn, row.intent, *state, min(seen, MAX_TURNS), seen,
                     before[0][-1] if before[0] else None, before[1][-1] if before[1] else None)
                )
            yield pd.DataFrame(
                out,
                columns=["conv_id", "turn", "last_intent", *ENTITY_TYPES, "turns_kept", "_seen", "prior_company",
                         "prior_location"],
            )

    return run


def conversation_state(turns: DataFrame, keep: int = KEEP, chunk_turns: int | None = None) -> DataFrame:
    """TXT9: state after each user turn, and the last company and place before it.

    Entities and intents are extracted row by row, in parallel; only these few
    names are shuffled and sorted. The fold is sequential by nature, so it
    streams over sorted rows and holds one state, whatever the length. With
    ``chunk_turns`` all conversations are folded in pieces of that many user
    turns, by their rank: each piece starts from the written end state of the
    piece before, so that a lost task repeats a piece only. Turns without a number
    come first.
    """
    text = F.col("text")
    compact = turns.filter(F.col("role") == "user").select(
        "conv_id", "turn", intent(text).alias("intent"), *[c.alias(n) for n, c in entities(text).items()]
    )
    types = dict(compact.dtypes)
    schema = (
        f"conv_id {types['conv_id']}, turn {types['turn']}, last_intent string, "
        + ", ".join(f"{t} array<string>" for t in ENTITY_TYPES)
        + ", turns_kept int, _seen long, prior_company string, prior_location string"
    )
    starts = {f"start_{t}": F.array().cast("array<string>") for t in ENTITY_TYPES} | {"start_seen": F.lit(0).cast("long")}

    def fold(rows: DataFrame) -> DataFrame:
        return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn").mapInPandas(_fold(keep), schema)

    if chunk_turns is None:
        return fold(compact.withColumns(starts)).drop("_seen")

    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    compact = materialize_once(compact.withColumn("_chunk", F.floor((rank - 1) / chunk_turns)), "conversation-mentions")
    last = compact.agg(F.max("_chunk")).first()[0] or 0
    pieces, carry = [], None
    for chunk in range(int(last) + 1):
        rows = compact.filter(F.col("_chunk") == chunk).drop("_chunk")
        if carry is None:
            rows = rows.withColumns(starts)
        else:
            rows = rows.join(carry, "conv_id", "left").withColumns({n: F.coalesce(n, c) for n, c in starts.items()})
        done = materialize_once(fold(rows), "conversation-state")
        pieces.append(done)
        ends = top_per_key(done, ["conv_id"], [F.col("turn").desc()]).select(
            "conv_id", *[F.col(t).alias(f"start_{t}") for t in ENTITY_TYPES], F.col("_seen").alias("start_seen")
        )
        # a conversation without rows in this piece keeps its earlier end state
        carry = ends if carry is None else ends.unionByName(carry.join(ends, "conv_id", "left_anti"))
        carry = materialize_once(carry, "conversation-carry")
    result = pieces[0]
    for piece in pieces[1:]:
        result = result.unionByName(piece)
    return result.drop("_seen")


def resolve_references(text: Column, last_company: Column, last_location: Column) -> Column:
    """TXT10: pronouns replaced by the last company and place, where known."""
    named = F.when(last_company.isNotNull(), F.regexp_replace(text, F.lit(_words(COMPANY_REFERENCES)), last_company)).otherwise(text)
    return F.when(
        last_location.isNotNull() & text.rlike(_words(LOCATION_REFERENCES)),
        F.regexp_replace(named, F.lit(_words(LOCATION_REFERENCES)), last_location),
    ).otherwise(named)


def resolved_turns(turns: DataFrame, state: DataFrame) -> DataFrame:
    """TXT10 over a table: each user turn with its references resolved."""
    return turns.join(state.select("conv_id", "turn", "prior_company", "prior_location"), ["conv_id", "turn"]).withColumn(
        "resolved", resolve_references(F.col("text"), F.col("prior_company"), F.col("prior_location"))
    )


def companies_in_reply(text: Column) -> Column:
    """TXT11: company names in list lines, then after "at", in order."""

    def clean(name: Column) -> Column:
        name = strip(name)
        for noise in NAME_NOISE:
            name = F.replace(name, F.lit(noise), F.lit(""))
        return strip(name)

    body = F.coalesce(text, F.lit(""))
    listed = F.transform(F.regexp_extract_all(body, F.lit(LISTED_COMPANY), F.lit(1)), clean)
    listed = F.filter(listed, lambda n: (F.length(n) > 3) & (F.length(n) < 80))
    at = F.transform(F.regexp_extract_all(body, F.lit(AT_COMPANY), F.lit(1)), strip)
    return F.concat(listed, F.filter(at, lambda n: F.length(n) > 3))


def companies_from_history(turns: DataFrame, last: int = 3, n: int = 10) -> DataFrame:
    """TXT11: the first ten distinct companies of a conversation's last three replies.

    Three replies per conversation survive the rank below the shuffle, and the
    first ``n`` distinct names per reply are all that can matter, so what meets
    in one task is bounded.
    """
    replies = top_per_key(turns.filter(F.col("role") == "assistant"), ["conv_id"], [F.col("turn").desc()], last)
    names = replies.select("conv_id", "turn", F.posexplode(companies_in_reply(F.col("text"))).alias("pos", "name"))
    first = names.groupBy("conv_id", F.lower("name").alias("key")).agg(
        F.min(F.struct("turn", "pos", "name")).alias("at")
    )
    kept = top_per_key(first, ["conv_id"], [F.col("at.turn"), F.col("at.pos")], n)
    return kept.groupBy("conv_id").agg(
        F.transform(F.sort_array(F.collect_list("at")), lambda a: a["name"]).alias("companies")
    )
