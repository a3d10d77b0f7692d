"""Structured Streaming forms: gap sessions, mergeable histograms, first of each name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gap_sessions(stream: DataFrame, keys: Sequence[str], at: str, gap: str, late: str, **aggregates: Column) -> DataFrame:
    """Sessions of a key that a pause of `gap` ends; rows later than `late` behind the watermark are left out."""
    window = F.session_window(at, gap)
    grouped = stream.withWatermark(at, late).groupBy(*keys, window.alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), *[c.alias(n) for n, c in aggregates.items()]).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", *aggregates)


def histogram(stream: DataFrame, keys: Sequence[str], at: str, bucket: Column, every: str, late: str) -> DataFrame:
    """Counts of a bucket in tumbling windows; partial counts add up, so windows can be merged afterwards."""
    rows = stream.withWatermark(at, late).withColumn("bucket", bucket)
    return rows.groupBy(*keys, F.window(at, every).alias("w"), "bucket").agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), "bucket", "n")


def first_seen(stream: DataFrame, keys: Sequence[str], at: str, late: str) -> DataFrame:
    """The first row of each key inside the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))
