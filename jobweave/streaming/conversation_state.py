"""TXT9 as a stream: state per conversation across micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from jobweave.operators import conversations as cv


def conversation_state_stream(turns: DataFrame, keep: int = cv.KEEP, idle_minutes: int | None = None) -> DataFrame:
    """State after the newest user turn of each conversation in a micro-batch.

    The stored state is a few names. With ``idle_minutes`` it is dropped when a
    conversation has been idle that long; the query then wakes up for time-outs
    and needs a running trigger, as it never counts as done.
    """
    text = F.col("text")
    compact = turns.filter(F.col("role") == "user").select(
        "conv_id", "turn", cv.intent(text).alias("intent"), *[c.alias(n) for n, c in cv.entities(text).items()]
    )
    output = (
        "conv_id long, turn long, last_intent string, companies array<string>, locations array<string>, "
        "job_titles array<string>, turns_kept int"
    )
    stored = "companies array<string>, locations array<string>, job_titles array<string>, seen long"

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = state.get if state.exists else ([], [], [], 0)
        names, seen = [list(k) for k in known[:3]], int(known[3])
        # the rows of one conversation in one micro-batch, limited by the trigger
        rows = sorted(
            (row for batch in batches for row in batch.itertuples(index=False)), key=lambda row: row.turn
        )
        for row in rows:
            names = [cv.remember(n, list(getattr(row, t)), keep) for n, t in zip(names, cv.ENTITY_TYPES)]
            seen += 1
        state.update((*names, seen))
        if idle_minutes:
            state.setTimeoutDuration(idle_minutes * 60 * 1000)
        if rows:
            yield pd.DataFrame(
                [(key[0], rows[-1].turn, rows[-1].intent, *names, min(seen, cv.MAX_TURNS))],
                columns=["conv_id", "turn", "last_intent", *cv.ENTITY_TYPES, "turns_kept"],
            )

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_minutes else GroupStateTimeout.NoTimeout
    return compact.groupBy("conv_id").applyInPandasWithState(update, output, stored, "update", timeout)
