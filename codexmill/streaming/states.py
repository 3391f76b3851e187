"""Profiles kept up to date by a stream of arriving rows.

Each micro-batch becomes the mergeable state of its rows and is appended under its batch's number, so
a batch that is run again after a failure overwrites itself. Late rows are just another state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from codexmill.operators.profile import Check, merge_states, summarise, value_states


def profile_stream(rows: DataFrame, load: str, checks: tuple[Check, ...], states: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start writing the states of a streaming table of rows below the folder ``states``."""

    def store(batch: DataFrame, number: int) -> None:
        value_states(batch, load, checks).write.mode("overwrite").parquet(f"{states}/batch={number}")

    writer = rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def compact_states(stored: DataFrame, to: str) -> None:
    """One state for all batches so far."""
    merge_states(stored.drop("batch")).write.mode("overwrite").parquet(to)


def current_summary(stored: DataFrame, checks: tuple[Check, ...]) -> DataFrame:
    return summarise(merge_states(stored.drop("batch")), checks)
