"""Live views of running sessions (an extension: the batch operators are the reference for results).

A stream of observations becomes totals of each run by event-time window, with late lines bounded by a
watermark, or the latest state of each run kept by key.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_totals(obs: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Tokens, calls and errors of each run and window of event time."""
    return (
        obs.withWatermark("event_time", late)
        .groupBy(F.window("event_time", window), "run_id")
        .agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.count_if(F.col("kind") == "assistant_tool_use").alias("calls"), F.count_if(F.col("status") == "error").alias("errors"))
    )


def latest_status(obs: DataFrame, idle_ms: int = 3_600_000) -> DataFrame:
    """The latest line and the worst status of each run, kept as state until the run has been idle."""

    def update(key: tuple, batches: Iterator, state) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        seq, failed = state.get if state.exists else (0, False)
        for pdf in batches:
            seq, failed = max(seq, int(pdf["seq"].max())), failed or bool((pdf["status"] == "error").any())
        state.update((seq, failed))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"run_id": [key[0]], "last_seq": [seq], "status": ["error" if failed else "running"]})

    return obs.groupBy("run_id").applyInPandasWithState(update, "run_id string, last_seq long, status string", "last_seq long, failed boolean", "update", "ProcessingTimeTimeout")
