"""Windows, peaks, one-dimensional convolution and spectra on the long layout."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arraylume.functions import ieee
from arraylume.operators import statistics
from arraylume.operators.series import attach, last_block, neighbours

#: Taper -> cosine terms: a0 - a1 cos t + a2 cos 2t.
TAPERS = {"hann": (0.5, 0.5, 0.0), "hamming": (0.54, 0.46, 0.0), "blackman": (0.42, 0.5, 0.08)}


def taper(idx: Column, length: Column, window: str) -> Column:
    """Weight of an element; 1 for series of one element."""
    a0, a1, a2 = TAPERS[window]
    t = idx.cast("double") * (2 * math.pi) / F.when(length > 1, (length - 1).cast("double"))
    return F.when(length > 1, F.lit(a0) - F.lit(a1) * F.cos(t) + F.lit(a2) * F.cos(2 * t)).otherwise(F.lit(1.0))


def apply_window(df: DataFrame, window: str, kind: str = "double") -> DataFrame:
    if window not in TAPERS:
        raise ValueError(f"window {window!r} is none of {', '.join(TAPERS)}")
    lengths = df.groupBy("series_id").agg(F.count("*").alias("length"), last_block())
    return attach(df, lengths).select("series_id", "idx", (F.col("value").cast("double") * taper(F.col("idx"), F.col("length"), window)).cast(kind).alias("value"))


def find_peaks(df: DataFrame, minimum: float = -math.inf, distance: int = 1) -> DataFrame:
    """(series_id, idx, value) of the local maxima (above the element before, not
    below the one after) of at least ``minimum``. With a distance, larger peaks go
    first and those nearer to a taken one are dropped; ties go to the smaller idx."""
    if distance <= 0:
        raise ValueError("distance must be positive")
    near = neighbours(df, {"before": -1, "after": 1})
    v = F.col("value")
    # Comparisons with NaN are false here; in Spark NaN is the largest value.
    rule = ieee.at_least(v, minimum) & ~F.isnan("before") & ~F.isnan("after") & (v > F.col("before")) & (v >= F.col("after"))
    peaks = near.where("before IS NOT NULL AND after IS NOT NULL").where(rule).select("series_id", "idx", "value")
    if distance == 1:
        return peaks

    def suppress(table: pa.Table) -> pa.Table:
        place, value = table.column("idx").to_pylist(), table.column("value").to_pylist()
        taken: list[int] = []
        cells: dict[int, list[int]] = {}  # taken places by place // distance
        for row in sorted(range(len(place)), key=lambda i: (-value[i], place[i])):
            cell = place[row] // distance
            if all(abs(place[row] - other) >= distance for c in (cell - 1, cell, cell + 1) for other in cells.get(c, ())):
                taken.append(row)
                cells.setdefault(cell, []).append(place[row])
        return table.take(pa.array(sorted(taken, key=place.__getitem__), pa.int64()))

    return peaks.groupBy("series_id").applyInArrow(suppress, peaks.schema)


def peak_to_median(df: DataFrame) -> DataFrame:
    """Largest peak over the median; 0 without peaks or for a median <= 1e-30."""
    top = find_peaks(df).groupBy("series_id").agg(F.max("value").alias("top"))
    middle = df.groupBy("series_id").agg(statistics.median(F.col("value")).alias("middle"))
    return middle.join(top, "series_id", "left").select("series_id", F.when(F.col("top").isNotNull() & (F.col("middle") > 1e-30), F.col("top") / F.when(F.col("middle") > 1e-30, F.col("middle"))).otherwise(F.lit(0.0)).alias("value"))


def convolve1d(df: DataFrame, kernel: list[float], boundary: str = "clamp", kind: str = "double") -> DataFrame:
    """Sum of kernel[k] * x[i + k - r] (the kernel is not flipped); beyond the ends
    the series goes on with its end values (clamp) or zeros (zero)."""
    if len(kernel) % 2 == 0:
        raise ValueError("a kernel has an odd number of weights")
    if boundary not in ("clamp", "zero"):
        raise ValueError(f"boundary {boundary!r} is neither clamp nor zero")
    r = len(kernel) // 2
    near = neighbours(df, {f"n{k}": k - r for k in range(len(kernel)) if k != r}) if r else df
    if boundary == "clamp" and r:
        ends = df.groupBy("series_id").agg(F.min_by("value", "idx").alias("first"), F.max_by("value", "idx").alias("last"), last_block())
        near = attach(near, ends)
    fill = lambda k: F.lit(0.0) if boundary == "zero" else F.col("first" if k < r else "last")
    terms = [F.lit(w) * (F.col("value") if k == r else F.coalesce(F.col(f"n{k}"), fill(k))).cast("double") for k, w in enumerate(kernel)]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return near.select("series_id", "idx", total.cast(kind).alias("value"))


def power_spectrum(re: Column, im: Column) -> Column:
    return re * re + im * im


def magnitude_spectrum(re: Column, im: Column) -> Column:
    return F.sqrt(power_spectrum(re, im))


def phase_spectrum(re: Column, im: Column, kind: str = "double") -> Column:
    return ieee.atan2(im, re, kind)
