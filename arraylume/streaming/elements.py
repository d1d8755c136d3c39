"""Stateless array operators and running histograms on streams.

Maps, thresholds and bin expressions are Columns, so they hold on streams as they
do on tables; results of aggregations are kept by Spark's state store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arraylume.functions import expression
from arraylume.operators.elementwise import threshold
from arraylume.operators.reduce import bin_of


def map_stream(stream: DataFrame, value: str, f: Callable, kind: str = "double", into: str | None = None) -> DataFrame:
    return stream.withColumn(into or value, expression.build(f, kind, [F.col(value)]))


def threshold_stream(stream: DataFrame, value: str, t: float, into: str = "above") -> DataFrame:
    return stream.withColumn(into, threshold(F.col(value).cast("float"), t))


def windowed_histogram(stream: DataFrame, value: str, time: str, width: str, late: str, bins: int, low: float, high: float, mode: str = "clamp") -> DataFrame:
    """Counts by event-time window and bin; rows later than ``late`` are dropped by
    the watermark, as everywhere in Spark."""
    binned = stream.withWatermark(time, late).withColumn("bin", bin_of(F.col(value), bins, low, high, mode)).where("bin IS NOT NULL")
    return binned.groupBy(F.window(time, width).alias("w"), "bin").count().select(F.col("w.start").alias("start"), "bin", "count")
