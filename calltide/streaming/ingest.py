"""An extension: alerts from a stream of new rows, each key once, as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(stream: DataFrame, key: list[str], time: str, late: str = "1 day") -> DataFrame:
    """The first row of each key that comes within ``late`` of the watermark; state older than that is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def windowed_counts(stream: DataFrame, time: str, by: list[str], width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows per window and group, late rows within ``late`` counted."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def append_batches(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]):
    """Run what there is through ``write``, batch by batch, exactly once by the checkpoint folder."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
