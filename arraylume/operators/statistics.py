"""Statistics per series, in one aggregation with partial sums each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arraylume.operators.series import BLOCK, neighbours

TINY = 1e-30


def _variance(x: Column) -> Column:
    """Population variance; exactly 0 for equal values, where merged partial means
    would leave rounding noise."""
    return F.when(F.max(x) == F.min(x), F.lit(0.0)).otherwise(F.var_pop(x))


def moments(value: Column) -> dict[str, Column]:
    """Population moments; skewness and excess kurtosis are 0 for variance <= 1e-30."""
    x = value.cast("double")
    variance = F.coalesce(_variance(x), F.lit(0.0))
    flat = variance <= TINY
    return {
        "mean": F.coalesce(F.avg(x), F.lit(0.0)),
        "variance": variance,
        "stddev": F.sqrt(variance),
        "skewness": F.when(flat, F.lit(0.0)).otherwise(F.skewness(x)),
        "kurtosis": F.when(flat, F.lit(0.0)).otherwise(F.kurtosis(x)),
    }


def calculate_statistics(df: DataFrame) -> DataFrame:
    return df.groupBy("series_id").agg(*[c.alias(n) for n, c in moments(F.col("value")).items()])


def sum_of_squares(value: Column) -> Column:
    return F.coalesce(F.sum(value.cast("double") * value.cast("double")), F.lit(0.0))


def covariance(x: Column, y: Column) -> Column:
    """Population covariance of pairs; 0 for none."""
    return F.coalesce(F.covar_pop(x.cast("double"), y.cast("double")), F.lit(0.0))


def _both(x: Column, y: Column) -> tuple[Column, Column]:
    known = x.isNotNull() & y.isNotNull()
    return F.when(known, x.cast("double")), F.when(known, y.cast("double"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's, in [-1, 1]; 0 where the denominator is 1e-30 or less."""
    x, y = _both(x, y)
    n = F.count(x).cast("double")
    denominator = F.sqrt(F.greatest(F.lit(0.0), _variance(x) * n * _variance(y) * n))
    value = F.covar_pop(x, y) * n / F.when(denominator > TINY, denominator)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0))))


def linear_regression(x: Column, y: Column) -> dict[str, Column]:
    """Least squares of y on x: slope, intercept and R squared in [0, 1]; all 0 for
    fewer than two pairs."""
    x, y = _both(x, y)
    vx, vy, c = _variance(x), _variance(y), F.covar_pop(x, y)
    few = F.count(x) < 2
    slope = F.when(vx > TINY, c / F.when(vx > TINY, vx)).otherwise(F.lit(0.0))
    total = vy * F.count(x)
    r2 = F.when(total > TINY, F.lit(1.0) - (vy - 2 * slope * c + slope * slope * vx) / F.when(total > TINY, vy)).otherwise(F.lit(0.0))
    zero = lambda v: F.when(few, F.lit(0.0)).otherwise(v)
    return {"slope": zero(slope), "intercept": zero(F.avg(y) - slope * F.avg(x)), "r_squared": zero(F.greatest(F.lit(0.0), F.least(F.lit(1.0), r2)))}


def accumulated_correlation(x: Column, y: Column) -> Column:
    """Correlation as a single-pass accumulator gives it: 0 for fewer than two pairs."""
    return F.when(F.count(F.when(x.isNotNull() & y.isNotNull(), F.lit(1))) < 2, F.lit(0.0)).otherwise(correlation(x, y))


def autocorrelation(df: DataFrame, lag: int) -> DataFrame:
    """Correlation of each series with itself ``lag`` elements on. Beyond the size of
    a block the series is joined with itself on (series_id, idx)."""
    if lag < 0:
        raise ValueError("lag must not be negative")
    if lag == 0:
        pairs = df.withColumn("later", F.col("value"))
    elif lag < BLOCK:
        pairs = neighbours(df, {"later": lag})
    else:
        pairs = df.join(df.select("series_id", (F.col("idx") - lag).alias("idx"), F.col("value").alias("later")), ["series_id", "idx"], "left")
    checked = F.when(F.count("*") > lag, correlation(F.col("value"), F.col("later"))).otherwise(F.raise_error(F.lit("lag exceeds the series")).cast("double"))
    return pairs.groupBy("series_id").agg(checked.alias("value"))


def shannon_entropy(counts: DataFrame) -> DataFrame:
    """Bits of the distribution in (series_id, count); negative counts fail."""
    c = F.col("count").cast("double")
    safe = F.when(c < 0, F.raise_error(F.lit("negative count")).cast("double")).otherwise(c)
    total, plogp = F.sum(safe), F.sum(F.when(c > 0, c * F.log2(F.when(c > 0, c))).otherwise(F.lit(0.0)))
    # -sum(p log p) with p = c / total is log(total) - sum(c log c) / total.
    bits = F.when(total > 0, F.log2(F.when(total > 0, total)) - plogp / F.when(total > 0, total)).otherwise(F.lit(0.0))
    return counts.groupBy("series_id").agg(bits.alias("entropy"))


def percentile(value: Column, p: float) -> Column:
    """Linear interpolation at p / 100 * (n - 1)."""
    if not 0 <= p <= 100:
        raise ValueError("a percentile lies in 0..100")
    return F.percentile(value.cast("double"), F.lit(p / 100))


def quantile(value: Column, q: float) -> Column:
    return percentile(value, q * 100)


def median(value: Column) -> Column:
    return percentile(value, 50)
