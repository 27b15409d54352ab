"""Snapshots as a stream: each micro-batch of captured rows is merged into the state, and counts by event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from riverbed.sources.state import read_snapshot, write_snapshot


def merge_stream(stream: DataFrame, path: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame], checkpoint: str) -> DataStreamWriter:
    """Writes ``merge(previous state, batch)`` as the snapshot of each batch.

    The previous state is that of the batch before, so a batch that is run again after a failure gives the same snapshot.
    """

    def one(batch: DataFrame, number: int) -> None:
        run = f"{number:012d}"
        previous = read_snapshot(batch.sparkSession, path, before=run) if number else None
        write_snapshot(merge(previous, batch), path, run)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)


def windowed_counts(stream: DataFrame, time: str, keys: list[str], length: str, late: str) -> DataFrame:
    """Counts in tumbling windows; rows later than ``late`` are left out by the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length), *keys).agg(F.count("*").alias("n"))
