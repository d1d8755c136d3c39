"""Reductions and histograms, one result per series.

Partial sums are taken on the map side; a series never has to fit a task. Empty
series have no rows and so no result; of an empty table ``scalar`` gives 0 for sum
and raises for the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arraylume.functions import ieee

NAMES = ("sum", "min", "max", "average")


def aggregate(name: str, value: Column, kind: str) -> Column:
    """The aggregate Column of a reduction over elements of a kind."""
    if name == "sum":
        return ieee.wrap32(F.coalesce(F.sum(value.cast("bigint")), F.lit(0))) if kind == "int" else F.coalesce(F.sum(value.cast("double")), F.lit(0.0)).cast(kind)
    if name == "min":
        return F.min(value) if kind == "int" else F.when(F.max(F.isnan(value)), F.lit(ieee.NAN)).otherwise(F.min(value)).cast(kind)
    if name == "max":
        return F.max(value)
    if name == "average":
        return F.call_function("div", ieee.wrap32(F.sum(value.cast("bigint"))).cast("bigint"), F.count(value)).cast("int") if kind == "int" else F.avg(value.cast("double")).cast(kind)
    raise ValueError(f"reduction {name!r} is none of {', '.join(NAMES)}")


def reduce(df: DataFrame, name: str, kind: str) -> DataFrame:
    return df.groupBy("series_id").agg(aggregate(name, F.col("value"), kind).alias("value"))


def scalar(df: DataFrame, name: str, kind: str):
    row = df.agg(aggregate(name, F.col("value"), kind).alias("value"), F.count("*").alias("n")).first()
    if not row["n"] and name != "sum":
        raise ValueError(f"{name} of an empty array")
    return row["value"]


def min_max(df: DataFrame, kind: str = "float") -> DataFrame:
    return df.groupBy("series_id").agg(aggregate("min", F.col("value"), kind).alias("minimum"), aggregate("max", F.col("value"), kind).alias("maximum"))


def bin_of(value: Column, bins: int, low: float, high: float, mode: str = "clamp") -> Column:
    """Bin of a float value; null where it counts nowhere (NaN; beyond the range
    with mode ``ignore``). The maximum is in the last bin. Steps are in float32."""
    if bins <= 0 or not low < high:
        raise ValueError("a histogram needs bins > 0 and low < high")
    if mode not in ("clamp", "ignore"):
        raise ValueError(f"mode {mode!r} is neither clamp nor ignore")
    v, lo, hi = value.cast("float"), F.lit(low).cast("float"), F.lit(high).cast("float")
    scale = (F.lit(bins).cast("float") / (hi - lo)).cast("float")
    outside = F.lit(None).cast("int")
    inner = ((v - lo).cast("float") * scale).cast("float").cast("int")
    return (
        F.when(F.isnan(v), outside)
        .when(v < lo, F.lit(0) if mode == "clamp" else outside)
        .when(v > hi, F.lit(bins - 1) if mode == "clamp" else outside)
        .when(v == hi, F.lit(bins - 1))
        .otherwise(F.when(inner.between(0, bins - 1), inner))
    )


def histogram(df: DataFrame, bins: int, low: float, high: float, mode: str = "clamp") -> DataFrame:
    """(series_id, bin, count) with a row for each bin of each series."""
    counted = df.select("series_id", bin_of(F.col("value"), bins, low, high, mode).alias("bin")).groupBy("series_id", "bin").count()
    spine = counted.select("series_id").distinct().select("series_id", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return spine.join(counted, ["series_id", "bin"], "left").select("series_id", "bin", F.coalesce("count", F.lit(0)).cast("int").alias("count"))
