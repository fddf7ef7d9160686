"""Cell counts over a stream. An extension: the batch operators are the same expressions over bounded tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import records


def streamed_cells(events: DataFrame, time: str, key: list[str], positive: Column, width: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """support and gold_positive of each key in tumbling windows; rows later than lateness are left out of windows already closed. The state is a row a key and open window."""
    windows = events.withWatermark(time, lateness).groupBy(F.window(time, width), *key)
    out = windows.agg(F.count(F.lit(1)).alias("support"), F.count_if(positive).alias("gold_positive"))
    return out.select(F.col("window.start").alias("start"), *key, "support", "gold_positive")


def drain(stream: DataFrame, path: str, key: list[str]) -> DataFrame:
    """Runs a streamed aggregation over what its source has: each batch writes the rows that it changed, and of each key the last one counts."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    records.start(stream, path, {"cells": lambda batch: batch}, mode="update").awaitTermination()
    return records.latest(records.read(stream.sparkSession, path, "cells", schema), key)
