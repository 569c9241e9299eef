"""Rollups that hold for batch and for streams; a stream needs a watermark first."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, at: str, width: str, *keys: str) -> DataFrame:
    """window_start and keys with n and total value of each tumbling window."""
    rows = events.groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def unfinished(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to do: keys without a finished record. Running it again after a stop repeats nothing."""
    return work.join(done.select(key), key, "left_anti")
