"""Element-wise utilities on the long layout."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arraylume.functions import ieee
from arraylume.operators import reduce as reductions
from arraylume.operators.series import attach, last_block, neighbours

TINY = 1e-30


def threshold(value: Column, t: float, kind: str = "float") -> Column:
    """1 where value >= t, else 0; NaN gives 0."""
    if not math.isfinite(t):
        raise ValueError("a threshold must be finite")
    return F.when(ieee.at_least(value, F.lit(t).cast(kind)), F.lit(1.0)).otherwise(F.lit(0.0)).cast(kind)


def normalize(df: DataFrame, kind: str = "float") -> DataFrame:
    """(value - min) / (max - min) of the series; 0 for a range of 1e-30 or less,
    all NaN where a NaN occurs. The extremes come to each block of a series, so one
    long series stays spread."""
    ends = [reductions.aggregate(f, F.col("value"), kind).alias(n) for f, n in (("min", "minimum"), ("max", "maximum"))]
    box = df.groupBy("series_id").agg(*ends, last_block()).withColumn("spread", F.col("maximum") - F.col("minimum"))
    joined = attach(df, box)
    value = F.when(F.isnan("spread"), F.lit(ieee.NAN)).when(F.col("spread") <= TINY, F.lit(0.0)).otherwise(ieee.divide(F.col("value") - F.col("minimum"), F.col("spread"), kind))
    return joined.select("series_id", "idx", value.cast(kind).alias("value"))


def safe_divide(a: Column, b: Column, zero: float = 0.0, epsilon: float = TINY, kind: str = "float") -> Column:
    """a / b, or ``zero`` where |b| < epsilon. With epsilon 0, plain IEEE division.
    Values that aren't finite leak NaN where they are replaced."""
    if not math.isfinite(epsilon) or epsilon < 0:
        raise ValueError("epsilon must be finite and not negative")
    if epsilon == 0:
        return ieee.divide(a, b, kind)
    a, b = a.cast(kind), b.cast(kind)
    safe = ieee.at_least(F.abs(b), F.lit(epsilon).cast(kind))
    unsafe = F.when(F.isnan(a) | F.isnan(b) | (F.abs(a) == ieee.INF), F.lit(ieee.NAN)).otherwise(F.lit(float(zero)))
    return F.when(safe, ieee.divide(a, b, kind)).otherwise(unsafe).cast(kind)


def mean_absolute_difference(df: DataFrame, block: int | None = None) -> DataFrame:
    """Mean |x[i + 1] - x[i]|; 0 for fewer than two elements."""
    pairs = neighbours(df, {"later": 1}, block) if block else neighbours(df, {"later": 1})
    return pairs.groupBy("series_id").agg(F.coalesce(F.avg(F.abs(F.col("later").cast("double") - F.col("value").cast("double"))), F.lit(0.0)).alias("value"))
