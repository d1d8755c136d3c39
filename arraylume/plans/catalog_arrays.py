"""Queries of the array operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from arraylume.functions import expression as e
from arraylume.functions import ieee
from arraylume.operators import composite, elementwise, fourier, signal, statistics
from arraylume.operators import reduce as reductions
from arraylume.operators.series import indexed, pack, series, unpack
from arraylume.plans.catalog_base import Catalog, plain, plain_sql, table
from arraylume.plans.pipeline import ArrayPipeline, PreparedMap, map_packed, zip_packed, zip_rows
from arraylume.sources import arrays

CATALOG = Catalog()
add = CATALOG.add


def _events(spark, sf, kind="double") -> ArrayPipeline:
    return arrays.from_table(table(spark, sf, "events"), "value", "event_id", None, kind)


def _out(p: ArrayPipeline, digits: int = 6):
    return p.to_df().select(F.col("idx").alias("event_id"), plain("value", digits).alias("value"))


def _map(name: str, f, sql: str, kind: str = "double", digits: int = 6) -> None:
    """A map of events.value; ``sql`` is over x."""
    add(name, f"SELECT event_id, {plain_sql(sql, digits)} AS value FROM (SELECT event_id, value{'::FLOAT' if kind == 'float' else ''} AS x FROM events)")(lambda spark, sf: _out(_events(spark, sf, kind).select(f), digits))


@add("flagship_revenue", "SELECT l_returnflag, round(sum(l_extendedprice * 1.0 * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_returnflag")
def flagship(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("price", e.build(lambda x: x * 1.0, "double", [F.col("l_extendedprice")]))
    return zip_rows(df, "price", "l_discount", lambda a, b: a * (1 - b), "double", "l_returnflag").sum().select(F.col("series_id").alias("l_returnflag"), F.round("value", 2).alias("revenue"))


# -- maps -----------------------------------------------------------------------
_map("map_affine", lambda x: x * 2 + 1, "x * 2 + 1")
_map("map_affine_float32", lambda x: x * 2 + 1, "((x * 2::FLOAT)::FLOAT + 1::FLOAT)::FLOAT", "float", 3)
_map("map_transcendental", lambda x: e.sin(x) * e.exp(-x / 100), "sin(x) * exp(-x / 100)")
_map("map_trigonometric", lambda x: e.cos(x) + e.tan(x / 1000), "cos(x) + tan(x / 1000)")
_map("map_clamp", lambda x: e.clamp(x, 10, 100), "greatest(10, least(x, 100))")
_map("map_min_max", lambda x: e.maximum(e.minimum(x, 50), 20), "greatest(least(x, 50), 20)")
_map("map_min_nan", lambda x: e.minimum(e.log(x - 50), x), "CASE WHEN x < 50 THEN 'NaN'::DOUBLE WHEN x = 50 THEN '-Infinity'::DOUBLE ELSE least(ln(CASE WHEN x > 50 THEN x - 50 ELSE 1 END), x) END")
_map("map_round_half_even", lambda x: e.round_even(x * 50) / 50 + e.round_even(x / 2 + 0.25), "round_even(x * 50, 0) / 50 + round_even(x / 2 + 0.25, 0)")
_map("map_floor_ceiling", lambda x: e.floor(x) * 1000 + e.ceiling(x), "floor(x) * 1000 + ceil(x)")
_map("map_sqrt_pow", lambda x: e.sqrt(x) + e.power(x, 1.5), "sqrt(x) + pow(x, 1.5)")
_map("map_abs_negate", lambda x: e.absolute(-x + 30) - (-(-x)), "abs(30 - x) - x")
_map("map_log_ieee", lambda x: e.log(x - 25) + e.log10(x), "CASE WHEN x < 25 THEN 'NaN'::DOUBLE WHEN x = 25 THEN '-Infinity'::DOUBLE ELSE ln(CASE WHEN x > 25 THEN x - 25 ELSE 1 END) + log10(x) END")
_map("map_captured_constant", lambda x, scale=3.5, high=True: x * scale if high else x, "x * 3.5")
_map("map_strict_identities", lambda x: (-(-x) * 1 - 0.0) / 1 + x * 0, "x + x * 0")


@add("map_div_ieee", f"""
SELECT event_id, {plain_sql("CASE WHEN d <> 0 THEN n / (CASE WHEN d <> 0 THEN d ELSE 1 END) WHEN n = 0 THEN 'NaN'::DOUBLE WHEN n > 0 THEN 'Infinity'::DOUBLE ELSE '-Infinity'::DOUBLE END")} AS value
FROM (SELECT event_id, (event_id % 5 - 2)::DOUBLE AS n, (event_id % 3 - 1)::DOUBLE AS d FROM events)""")
def map_div(spark, sf):
    df = table(spark, sf, "events").select("event_id", (F.col("event_id") % 5 - 2).cast("double").alias("n"), (F.col("event_id") % 3 - 1).cast("double").alias("d"))
    return df.select("event_id", plain(e.build(lambda a, b: a / b, "double", [F.col("n"), F.col("d")])).alias("value"))


_WRAP = "((({}) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648"


@add("map_int_wrap", f"SELECT p_partkey, ({_WRAP.format('(' + _WRAP.format('p_size::BIGINT * 123456789') + ') + 2000000000')})::INTEGER AS value FROM part")
def map_int_wrap(spark, sf):
    return table(spark, sf, "part").select("p_partkey", e.build(lambda x: x * 123456789 + 2000000000, "int", [F.col("p_size")]).alias("value"))


@add("map_int_divide", "SELECT p_partkey, (trunc((20 - p_size) / 7.0) + abs(20 - p_size) - least(p_size, 25) + greatest(p_size, 10))::INTEGER AS value FROM part")
def map_int_divide(spark, sf):
    f = lambda x: (20 - x) / 7 + e.absolute(20 - x) - e.minimum(x, 25) + e.maximum(x, 10)
    return table(spark, sf, "part").select("p_partkey", e.build(f, "int", [F.col("p_size")]).alias("value"))


@add("map_packed", "SELECT vec_id, (i - 1)::INTEGER AS idx, round((embedding[i]::DOUBLE * 2 + 1), 6) AS value FROM embeddings, range(1, 65) AS r(i)")
def map_packed_query(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", map_packed("embedding", lambda x: x * 2 + 1, "double").alias("v"))
    return df.select("vec_id", F.posexplode("v").alias("idx", "value")).select("vec_id", "idx", F.round("value", 6).alias("value"))


@add("map_prepared", "SELECT event_id, round(value * 0.5 - 3, 6) AS value FROM events")
def map_prepared(spark, sf):
    rows = PreparedMap(lambda x: x * 0.5 - 3, "double").run(_events(spark, sf).to_df())
    return rows.select(F.col("idx").alias("event_id"), F.round("value", 6).alias("value"))


@add("map_explicit_backend", "SELECT event_id, round(value + 1, 6) AS value FROM events")
def map_explicit(spark, sf):
    return _out(_events(spark, sf).explicit(lambda x: x + 1, "simd"))


@add("pipeline_fused_map", "SELECT event_id, round(sqrt((value + 1) * 2) - 1, 6) AS value FROM events")
def pipeline_fused(spark, sf):
    return _out(_events(spark, sf).select(lambda x: x + 1).select(lambda x: x * 2).select_in_place(lambda x: e.sqrt(x) - 1))


@add("run_delegate", "SELECT event_id, round(CASE WHEN v > 100 THEN v / 2 ELSE v * 2 END::FLOAT::DOUBLE, 2) AS value FROM (SELECT event_id, value::FLOAT AS v FROM events)")
def run_delegate(spark, sf):
    import pandas as pd

    def branch(v: pd.Series) -> pd.Series:
        return v.where(v <= 100, v / 4) * 2

    return _out(_events(spark, sf, "float").delegate(branch), 2)


# -- zip ------------------------------------------------------------------------
@add("zip_join", "SELECT event_id, round(value * 2 - user_id, 6) AS value FROM events")
def zip_join(spark, sf):
    other = arrays.from_table(table(spark, sf, "events"), "user_id", "event_id", None, "double")
    return _out(_events(spark, sf).zip(other, lambda a, b: a * 2 - b))


@add("zip_pipeline", "SELECT event_id, round(sqrt(value + user_id), 6) AS value FROM events")
def zip_pipeline(spark, sf):
    other = arrays.from_table(table(spark, sf, "events"), "user_id", "event_id", None, "double")
    return _out(_events(spark, sf).select(lambda x: x * 1).zip_in_place(other, lambda a, b: a + b).select(e.sqrt))


@add("zip_same_row", "SELECT l_linestatus, round(sum(l_quantity * l_tax), 4) AS value FROM lineitem GROUP BY l_linestatus")
def zip_same_row(spark, sf):
    return zip_rows(table(spark, sf, "lineitem"), "l_quantity", "l_tax", lambda a, b: a * b, "double", "l_linestatus").sum().select(F.col("series_id").alias("l_linestatus"), F.round("value", 4).alias("value"))


@add("zip_packed", "SELECT vec_id, (i - 1)::INTEGER AS idx, round(embedding[i]::DOUBLE * embedding[65 - i]::DOUBLE, 6) AS value FROM embeddings, range(1, 65) AS r(i)")
def zip_packed_query(spark, sf):
    df = table(spark, sf, "embeddings").withColumn("other", F.reverse("embedding"))
    df = df.select("vec_id", zip_packed(df, "embedding", "other", lambda a, b: a * b, "double").alias("v"))
    return df.select("vec_id", F.posexplode("v").alias("idx", "value")).select("vec_id", "idx", F.round("value", 6).alias("value"))


@add("zip_int", "SELECT p_partkey, (p_size * (p_partkey % 7)::INTEGER + 1)::INTEGER AS value FROM part")
def zip_int(spark, sf):
    df = table(spark, sf, "part")
    a = arrays.from_table(df, "p_size", "p_partkey", None, "int")
    b = arrays.from_table(df, F.col("p_partkey") % 7, "p_partkey", None, "int")
    return a.zip(b, lambda x, y: x * y + 1).to_df().select(F.col("idx").alias("p_partkey"), "value")


# -- reductions -----------------------------------------------------------------
def _lineitem(spark, sf) -> ArrayPipeline:
    return arrays.from_table(table(spark, sf, "lineitem"), "l_extendedprice", None, "l_returnflag", "double")


for _name, _sql in (("sum", "sum"), ("min", "min"), ("max", "max"), ("average", "avg")):
    add(f"reduce_{_name}", f"SELECT l_returnflag, round({_sql}(l_extendedprice), 2) AS value FROM lineitem GROUP BY l_returnflag")(
        lambda spark, sf, n=_name: getattr(_lineitem(spark, sf), n)().select(F.col("series_id").alias("l_returnflag"), F.round("value", 2).alias("value"))
    )
    _int = {"sum": _WRAP.format("sum(p_size::BIGINT * 1000000)"), "min": "min(p_size) * 1000000", "max": "max(p_size) * 1000000", "average": f"trunc(({_WRAP.format('sum(p_size::BIGINT * 1000000)')}) / count(*))"}[_name]
    add(f"reduce_int_{_name}", f"SELECT p_brand, ({_int})::INTEGER AS value FROM part GROUP BY p_brand")(
        lambda spark, sf, n=_name: getattr(arrays.from_table(table(spark, sf, "part"), "p_size", None, "p_brand", "int").select(lambda x: x * 1000000), n)().select(F.col("series_id").alias("p_brand"), "value")
    )


@add("reduce_min_nan", f"SELECT event_type, {plain_sql('CASE WHEN max(isnan(v)::INT) = 1 THEN 9999 ELSE min(v) END', 4)} AS lo FROM (SELECT event_type, CASE WHEN value < 1 AND event_type = 'click' THEN 'NaN'::DOUBLE ELSE value END AS v FROM events) GROUP BY event_type")
def reduce_min_nan(spark, sf):
    df = table(spark, sf, "events").withColumn("v", F.when((F.col("value") < 1) & (F.col("event_type") == "click"), F.lit(float("nan"))).otherwise(F.col("value")))
    lo = F.col("value")
    return arrays.from_table(df, "v", None, "event_type", "double").min().select(F.col("series_id").alias("event_type"), plain(F.when(F.isnan(lo), 9999.0).otherwise(lo), 4).alias("lo"))


@add("reduce_fused_map_sum", "SELECT l_returnflag, round(sum(l_extendedprice * l_extendedprice / 1000), 1) AS value FROM lineitem GROUP BY l_returnflag")
def reduce_fused_map(spark, sf):
    return _lineitem(spark, sf).select(lambda x: x * x / 1000).sum().select(F.col("series_id").alias("l_returnflag"), F.round("value", 1).alias("value"))


@add("reduce_fused_zip_sum", "SELECT round(sum(value * user_id), 2) AS value FROM events")
def reduce_fused_zip(spark, sf):
    other = arrays.from_table(table(spark, sf, "events"), "user_id", "event_id", None, "double")
    return _events(spark, sf).zip(other, lambda a, b: a * b).sum().select(F.round("value", 2).alias("value"))


@add("min_max", "SELECT event_type, min(value) AS minimum, max(value) AS maximum FROM events GROUP BY event_type")
def min_max(spark, sf):
    return reductions.min_max(series(table(spark, sf, "events"), "value", None, "event_type"), "double").withColumnRenamed("series_id", "event_type")


def _histogram(mode: str) -> None:
    bound = ("0", "31") if mode == "clamp" else ("NULL", "NULL")
    sql = f"""
WITH v AS (SELECT event_type, value::FLOAT AS v FROM events),
 b AS (SELECT event_type, CASE WHEN v < 5 THEN {bound[0]} WHEN v > 105 THEN {bound[1]} WHEN v = 105 THEN 31 ELSE trunc(((v - 5::FLOAT)::FLOAT * (32::FLOAT / 100::FLOAT))::FLOAT)::INTEGER END AS bin FROM v),
 spine AS (SELECT event_type, i::INTEGER AS bin FROM (SELECT DISTINCT event_type FROM events), range(32) AS r(i))
SELECT event_type, bin, count(b.bin)::INTEGER AS n FROM spine LEFT JOIN b USING (event_type, bin) GROUP BY event_type, bin"""
    add(f"histogram_{mode}", sql)(lambda spark, sf: reductions.histogram(series(table(spark, sf, "events"), "value", None, "event_type", "float"), 32, 5.0, 105.0, mode).select(F.col("series_id").alias("event_type"), "bin", F.col("count").alias("n")))


_histogram("clamp")
_histogram("ignore")


# -- statistics -----------------------------------------------------------------
_CENTRED = "(SELECT event_type, value, avg(value) OVER (PARTITION BY event_type) AS m FROM events)"


@add("stats_moments", f"""
SELECT event_type, round(m1, 6) AS mean, round(v, 6) AS variance, round(sqrt(v), 6) AS stddev, round(m3 / pow(v, 1.5), 6) AS skewness, round(m4 / (v * v) - 3, 6) AS kurtosis
FROM (SELECT event_type, avg(value) AS m1, avg(pow(value - m, 2)) AS v, avg(pow(value - m, 3)) AS m3, avg(pow(value - m, 4)) AS m4 FROM {_CENTRED} GROUP BY event_type)""")
def stats_moments(spark, sf):
    out = statistics.calculate_statistics(series(table(spark, sf, "events"), "value", None, "event_type"))
    return out.select(F.col("series_id").alias("event_type"), *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@add("stats_constant_series", "SELECT event_type, 7.0::DOUBLE AS mean, 0.0::DOUBLE AS variance, 0.0::DOUBLE AS skewness, 0.0::DOUBLE AS kurtosis FROM events GROUP BY event_type")
def stats_constant(spark, sf):
    return statistics.calculate_statistics(series(table(spark, sf, "events"), F.lit(7.0), None, "event_type")).select(F.col("series_id").alias("event_type"), "mean", "variance", "skewness", "kurtosis")


def _statistic(name: str, make, sql: str, digits: int = 6) -> None:
    add(name, f"SELECT event_type, round({sql}, {digits}) AS value FROM events GROUP BY event_type")(lambda spark, sf: table(spark, sf, "events").groupBy("event_type").agg(F.round(make(F.col("value"), F.col("user_id")), digits).alias("value")))


_statistic("stats_mean", lambda x, _: statistics.moments(x)["mean"], "avg(value)")
_statistic("stats_variance", lambda x, _: statistics.moments(x)["variance"], "var_pop(value)")
_statistic("stats_stddev", lambda x, _: statistics.moments(x)["stddev"], "stddev_pop(value)")
_statistic("stats_kurtosis", lambda x, _: statistics.moments(x)["kurtosis"], "kurtosis_pop(value)")
_statistic("sum_of_squares", lambda x, _: statistics.sum_of_squares(x), "sum(value * value)", 2)
_statistic("covariance", statistics.covariance, "covar_pop(value, user_id)")
_statistic("correlation", statistics.correlation, "corr(value, user_id)")
_statistic("correlation_accumulator", statistics.accumulated_correlation, "corr(value, user_id)")
_statistic("percentile_90", lambda x, _: statistics.percentile(x, 90), "quantile_cont(value, 0.9)")
_statistic("quantile_25", lambda x, _: statistics.quantile(x, 0.25), "quantile_cont(value, 0.25)")
_statistic("median", lambda x, _: statistics.median(x), "quantile_cont(value, 0.5)")


@add("stats_skewness", f"SELECT event_type, round(avg(pow(value - m, 3)) / pow(avg(pow(value - m, 2)), 1.5), 6) AS value FROM {_CENTRED} GROUP BY event_type")
def stats_skewness(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(statistics.moments(F.col("value"))["skewness"], 6).alias("value"))


@add("correlation_constant", "SELECT event_type, 0.0::DOUBLE AS value FROM events GROUP BY event_type")
def correlation_constant(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(statistics.correlation(F.col("value"), F.lit(3.0)).alias("value"))


@add("linear_regression", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r_squared FROM lineitem GROUP BY l_returnflag")
def linear_regression(spark, sf):
    fit = statistics.linear_regression(F.col("l_quantity"), F.col("l_extendedprice"))
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(*[F.round(c, d).alias(n) for (n, c), d in zip(fit.items(), (4, 3, 6))])


@add("autocorrelation_lag3", "SELECT round(corr(value, later), 6) AS value FROM (SELECT value, lead(value, 3) OVER (ORDER BY event_id) AS later FROM events) WHERE later IS NOT NULL")
def autocorrelation(spark, sf):
    return statistics.autocorrelation(_events(spark, sf).to_df(), 3).select(F.round("value", 6).alias("value"))


@add("shannon_entropy", "SELECT user_id, round(-sum(p * log2(p)), 6) AS entropy FROM (SELECT user_id, c / sum(c) OVER (PARTITION BY user_id) AS p FROM (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL)) GROUP BY user_id")
def shannon_entropy(spark, sf):
    counts = table(spark, sf, "events").groupBy(F.col("user_id").alias("series_id"), "event_type").count()
    return statistics.shannon_entropy(counts).select(F.col("series_id").alias("user_id"), F.round("entropy", 6).alias("entropy"))


# -- element-wise -----------------------------------------------------------------
@add("threshold", "SELECT event_id, (CASE WHEN isnan(v) THEN 0 WHEN v >= 3.5 THEN 1 ELSE 0 END)::INTEGER AS value FROM (SELECT event_id, CASE WHEN value < 30 THEN 'NaN'::DOUBLE ELSE ln(value) END AS v FROM events)")
def threshold(spark, sf):
    df = table(spark, sf, "events").withColumn("v", F.when(F.col("value") < 30, F.lit(float("nan"))).otherwise(F.ln("value")))
    return df.select("event_id", elementwise.threshold(F.col("v"), 3.5, "double").cast("int").alias("value"))


@add("normalize", "SELECT event_id, round((value - lo) / (hi - lo), 6) AS value FROM (SELECT *, min(value) OVER (PARTITION BY event_type) AS lo, max(value) OVER (PARTITION BY event_type) AS hi FROM events)")
def normalize(spark, sf):
    return elementwise.normalize(series(table(spark, sf, "events"), "value", "event_id", "event_type"), "double").select(F.col("idx").alias("event_id"), F.round("value", 6).alias("value"))


@add("safe_divide", "SELECT event_id, round(CASE WHEN event_id % 4 = 0 THEN -1 ELSE value / (event_id % 4) END, 6) AS value FROM events")
def safe_divide(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(elementwise.safe_divide(F.col("value"), F.col("event_id") % 4, -1.0, kind="double"), 6).alias("value"))


def _per_user(spark, sf):
    df = indexed(table(spark, sf, "events"), "user_id", ["event_id"])
    return series(df, "value", "idx", "user_id")


_USER = "(SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
_NEAR = f"(SELECT *, lag(value) OVER w AS b, lead(value) OVER w AS a FROM {_USER} WINDOW w AS (PARTITION BY user_id ORDER BY idx))"


@add("mean_absolute_difference", "SELECT round(avg(abs(later - value)), 6) AS value FROM (SELECT value, lead(value) OVER (ORDER BY event_id) AS later FROM events)")
def mean_absolute_difference(spark, sf):
    return elementwise.mean_absolute_difference(_events(spark, sf).to_df(), 4096).select(F.round("value", 6).alias("value"))


# -- signals ----------------------------------------------------------------------
for _w, (_a, _b, _c) in signal.TAPERS.items():
    add(f"window_{_w}", f"SELECT user_id, idx, round(value * ({_a} - {_b} * cos(2 * pi() * idx / (n - 1)) + {_c} * cos(4 * pi() * idx / (n - 1))), 6) AS value FROM {_USER} WHERE n > 1 UNION ALL SELECT user_id, idx, round(value, 6) FROM {_USER} WHERE n = 1")(
        lambda spark, sf, w=_w: signal.apply_window(_per_user(spark, sf), w).select(F.col("series_id").alias("user_id"), "idx", F.round("value", 6).alias("value"))
    )


@add("find_peaks", f"SELECT user_id, idx, value FROM {_NEAR} WHERE value >= 20 AND value > b AND value >= a")
def find_peaks(spark, sf):
    return signal.find_peaks(_per_user(spark, sf), 20.0).withColumnRenamed("series_id", "user_id")


@add("find_peaks_distance", f"""
WITH RECURSIVE p AS MATERIALIZED (SELECT user_id, idx, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, idx) AS r FROM {_NEAR} WHERE value > b AND value >= a),
 go(user_id, r, taken) AS (SELECT DISTINCT user_id, 0::BIGINT, []::BIGINT[] FROM p
  UNION ALL SELECT p.user_id, p.r, CASE WHEN len([t FOR t IN taken IF abs(t - p.idx) < 5]) > 0 THEN taken ELSE list_append(taken, p.idx) END FROM go JOIN p ON p.user_id = go.user_id AND p.r = go.r + 1),
 kept AS (SELECT user_id, unnest(arg_max(taken, r)) AS idx FROM go GROUP BY user_id)
SELECT user_id, idx, value FROM kept JOIN p USING (user_id, idx)""")
def find_peaks_distance(spark, sf):
    return signal.find_peaks(_per_user(spark, sf), distance=5).withColumnRenamed("series_id", "user_id")


@add("peak_to_median", f"SELECT m.user_id, round(coalesce(p.top, 0) / m.med, 6) AS value FROM (SELECT user_id, quantile_cont(value, 0.5) AS med FROM events GROUP BY user_id) m LEFT JOIN (SELECT user_id, max(value) AS top FROM {_NEAR} WHERE value > b AND value >= a GROUP BY user_id) p USING (user_id)")
def peak_to_median(spark, sf):
    return signal.peak_to_median(_per_user(spark, sf)).select(F.col("series_id").alias("user_id"), F.round("value", 6).alias("value"))


for _mode, _lo, _hi in (("clamp", "first_value(value) OVER f", "last_value(value) OVER f"), ("zero", "0", "0")):
    add(f"convolve1d_{_mode}", f"""
SELECT user_id, idx, round(0.1 * coalesce(lag(value, 2) OVER w, {_lo}) + 0.2 * coalesce(lag(value) OVER w, {_lo}) + 0.4 * value + 0.2 * coalesce(lead(value) OVER w, {_hi}) + 0.3 * coalesce(lead(value, 2) OVER w, {_hi}), 6) AS value
FROM {_USER} WINDOW w AS (PARTITION BY user_id ORDER BY idx), f AS (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")(
        lambda spark, sf, m=_mode: signal.convolve1d(_per_user(spark, sf), [0.1, 0.2, 0.4, 0.2, 0.3], m).select(F.col("series_id").alias("user_id"), "idx", F.round("value", 6).alias("value"))
    )


def _complex(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("re"), F.transform("embedding", lambda _: F.lit(0.0)).alias("im"))


def _spread(df, *columns):
    return df.select("vec_id", F.posexplode(F.arrays_zip(*columns)).alias("k", "z"))


_DFT = """
WITH x AS (SELECT vec_id, i - 1 AS n, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) AS r(i)),
 t AS (SELECT m, cos(2 * pi() * m / 64) AS c, sin(2 * pi() * m / 64) AS s FROM range(64) AS r(m)),
 f AS (SELECT vec_id, k, sum(v * c) AS re, -sum(v * s) AS im FROM x, range(64) AS q(k) JOIN t ON m = (k * n) % 64 GROUP BY vec_id, k)
"""


@add("fft", _DFT + "SELECT vec_id, k::INTEGER AS k, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im FROM f")
def fft(spark, sf):
    z = F.col("z")
    return _spread(fourier.fft(_complex(spark, sf), ["vec_id"]), "re", "im").select("vec_id", "k", (F.round(z["re"], 5) + 0.0).alias("re"), (F.round(z["im"], 5) + 0.0).alias("im"))


@add("fft_power_magnitude", _DFT + "SELECT vec_id, k::INTEGER AS k, round(re * re + im * im, 5) AS power, round(sqrt(re * re + im * im), 5) AS magnitude FROM f")
def fft_power(spark, sf):
    z = F.col("z")
    return _spread(fourier.fft(_complex(spark, sf), ["vec_id"]), "re", "im").select("vec_id", "k", F.round(signal.power_spectrum(z["re"], z["im"]), 5).alias("power"), F.round(signal.magnitude_spectrum(z["re"], z["im"]), 5).alias("magnitude"))


@add("fft_phase", _DFT + "SELECT vec_id, k::INTEGER AS k, CASE WHEN k % 32 = 0 THEN abs(round(atan2(im, re), 4)) ELSE round(atan2(im, re), 4) END AS phase FROM f")
def fft_phase(spark, sf):
    z = F.col("z")
    phase = F.round(signal.phase_spectrum(z["re"], z["im"]), 4)
    # Bins 0 and 32 of real input are real; the sign of a zero tells pi from -pi there.
    return _spread(fourier.fft(_complex(spark, sf), ["vec_id"]), "re", "im").select("vec_id", "k", F.when(F.col("k") % 32 == 0, F.abs(phase)).otherwise(phase).alias("phase"))


@add("inverse_fft", "SELECT vec_id, (i - 1)::INTEGER AS k, round(embedding[i]::DOUBLE, 6) AS re FROM embeddings, range(1, 65) AS r(i)")
def inverse_fft(spark, sf):
    back = fourier.fft(fourier.fft(_complex(spark, sf), ["vec_id"]), ["vec_id"], inverse=True)
    return _spread(back, "re", "im").select("vec_id", "k", F.round(F.col("z")["re"], 6).alias("re"))


@add("fft2d_power", """
WITH x AS (SELECT vec_id, (i - 1) % 8 AS x, (i - 1) // 8 AS y, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) AS r(i)),
 t AS (SELECT m, cos(2 * pi() * m / 8) AS c, sin(2 * pi() * m / 8) AS s FROM range(8) AS r(m)),
 f AS (SELECT vec_id, u, w, sum(v * c) AS re, -sum(v * s) AS im FROM x, range(8) AS a(u), range(8) AS b(w) JOIN t ON m = (u * x + w * y) % 8 GROUP BY vec_id, u, w)
SELECT vec_id, (w * 8 + u)::INTEGER AS k, round(re * re + im * im, 5) AS power FROM f""")
def fft2d(spark, sf):
    z = F.col("z")
    return _spread(fourier.fft2d(_complex(spark, sf), ["vec_id"], 8, 8), "re", "im").select("vec_id", "k", F.round(signal.power_spectrum(z["re"], z["im"]), 5).alias("power"))


@add("inverse_fft2d", "SELECT vec_id, (i - 1)::INTEGER AS k, round(embedding[i]::DOUBLE, 6) AS re FROM embeddings, range(1, 65) AS r(i)")
def inverse_fft2d(spark, sf):
    back = fourier.fft2d(fourier.fft2d(_complex(spark, sf), ["vec_id"], 8, 8), ["vec_id"], 8, 8, inverse=True)
    return _spread(back, "re", "im").select("vec_id", "k", F.round(F.col("z")["re"], 6).alias("re"))


# -- layouts and composite values ---------------------------------------------------
@add("pack_unpack", "SELECT vec_id, (i - 1)::BIGINT AS idx, embedding[i]::DOUBLE AS value FROM embeddings, range(1, 65) AS r(i)")
def pack_unpack(spark, sf):
    packed = pack(unpack(table(spark, sf, "embeddings"), "embedding", "vec_id"))
    return unpack(packed, "values", "series_id").select(F.col("series_id").alias("vec_id"), "idx", F.col("value").cast("double").alias("value"))


def _pairs(spark, sf):
    return table(spark, sf, "events").select("event_id", F.struct(F.col("value").cast("float").alias("re"), (F.col("user_id") / 10).cast("float").alias("im")).alias("value"))


_PAIR = "(SELECT event_id, value::FLOAT AS re, (user_id / 10.0)::FLOAT AS im FROM events)"


@add("composite_map", f"SELECT event_id, round((re * 2::FLOAT)::FLOAT::DOUBLE, 3) AS re, round((im + re)::FLOAT::DOUBLE, 3) AS im FROM {_PAIR}")
def composite_map(spark, sf):
    out = composite.CompositePipeline(_pairs(spark, sf)).select(lambda v: {"re": v.re * 2, "im": v.im + v.re}).to_df()
    return out.select("event_id", F.round(F.col("value.re").cast("double"), 3).alias("re"), F.round(F.col("value.im").cast("double"), 3).alias("im"))


@add("composite_project", f"SELECT event_id, round((re - im)::FLOAT::DOUBLE, 3) AS value FROM {_PAIR}")
def composite_project(spark, sf):
    return composite.CompositePipeline(_pairs(spark, sf)).project(lambda v: v.re - v.im).select("event_id", F.round(F.col("value").cast("double"), 3).alias("value"))


@add("composite_convert_bytes", f"SELECT event_id, (trunc(re)::BIGINT % 256)::SMALLINT AS lo, (((trunc(re)::BIGINT % 256) * 3 + 100) // 2 % 256)::SMALLINT AS hi FROM {_PAIR}")
def composite_convert(spark, sf):
    narrow = composite.CompositePipeline(_pairs(spark, sf)).select(lambda v: {"lo": composite.to_byte(v.re), "hi": composite.to_byte(v.re)}, byte=True)
    return narrow.select(lambda v: {"lo": v.lo, "hi": composite.to_byte((v.hi * 3 + 100) / 2)}).to_df().select("event_id", "value.lo", "value.hi")


@add("complex_arithmetic", f"SELECT event_id, round((re * re - im * im)::DOUBLE, 1) AS re, round((re * im * 2)::DOUBLE, 1) AS im, round(sqrt(re::DOUBLE * re + im::DOUBLE * im), 2) AS magnitude FROM (SELECT event_id, re::DOUBLE AS re, im::DOUBLE AS im FROM {_PAIR})")
def complex_arithmetic(spark, sf):
    v = F.col("value")
    wide = F.struct(v["re"].cast("double").alias("re"), v["im"].cast("double").alias("im"))
    square = wide["re"] * wide["re"] - wide["im"] * wide["im"], 2 * wide["re"] * wide["im"]
    return _pairs(spark, sf).select("event_id", F.round(square[0], 1).alias("re"), F.round(square[1], 1).alias("im"), F.round(F.sqrt(wide["re"] * wide["re"] + wide["im"] * wide["im"]), 2).alias("magnitude"))


@add("atan2_ieee", "SELECT event_id, round(atan2(event_id % 3 - 1, event_id % 5 - 2), 6) AS value FROM events")
def atan2_ieee(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(ieee.atan2(F.col("event_id") % 3 - 1, F.col("event_id") % 5 - 2, "double"), 6).alias("value"))
