"""Streaming variants, an extension: the batch operators over growing inputs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.events import can_transition, quality_findings


def stream_findings(events: DataFrame) -> DataFrame:
    """Quality findings of a stream: row by row, so append mode needs no state."""
    return quality_findings(events)


def windowed_counts(events: DataFrame, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events per type and window; the watermark bounds the state."""
    timed = events.withColumn("event_time", F.col("event_time").cast("timestamp")).withWatermark("event_time", delay)
    return timed.groupBy(F.window("event_time", width), "event_type").agg(F.count("*").alias("n"))


def stream_transitions(events: DataFrame) -> DataFrame:
    """Changes of state per request as events arrive, in order within a batch; the state kept per request is its last state."""

    def step(key, batches, state):
        last = state.get[0] if state.exists else None
        out = []
        for batch in batches:
            for row in batch.sort_values(["event_time", "seq"]).itertuples():
                if last is not None and row.lifecycle_state_after != last:
                    out.append((key[0], row.event_id, last, row.lifecycle_state_after))
                last = row.lifecycle_state_after
        state.update((last,))
        yield pd.DataFrame(out, columns=["request_id", "event_id", "from_state", "to_state"])

    stated = events.filter("lifecycle_state_after IS NOT NULL").select("request_id", "event_id", "event_time", "seq", "lifecycle_state_after")
    moves = stated.groupBy("request_id").applyInPandasWithState(step, "request_id string, event_id string, from_state string, to_state string", "last string", "append", "NoTimeout")
    return moves.withColumn("allowed", can_transition(F.col("from_state"), F.col("to_state")))
