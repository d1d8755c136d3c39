"""Pipelines, reductions, statistics and signals against literal values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arraylume.functions import expression as e
from arraylume.functions.errors import BackendNotSupportedError, BackendUnavailableError, BufferMismatchError, MemoryBudgetExceededError
from arraylume.operators import elementwise, fourier, signal, statistics
from arraylume.operators import reduce as reductions
from arraylume.operators import series
from arraylume.operators.series import neighbours
from arraylume.plans.pipeline import PreparedMap
from arraylume.plans.runtime import Context, Options
from arraylume.sources.arrays import from_packed, from_values, write_parquet


def values(df):
    return [r["value"] for r in df.orderBy("series_id", "idx").collect()]


def test_reductions(spark):
    p = from_values(spark, [-5, 2, 7, -1, 4, 3, 8, -2, 6, 1, 9])
    assert [p.scalar(n) for n in ("sum", "min", "max")] == [32, -5, 9]
    assert p.scalar("average") == pytest.approx(32 / 11)
    assert p.sum().first()["value"] == 32


def test_empty_reductions(spark):
    p = from_values(spark, [])
    assert p.scalar("sum") == 0
    for name in ("min", "max", "average"):
        with pytest.raises(ValueError):
            p.scalar(name)


def test_nan_spreads_through_extremes(spark):
    p = from_values(spark, [1.0, 2.0, float("nan"), 3.0])
    assert math.isnan(p.scalar("min")) and math.isnan(p.scalar("max"))


def test_int_average_wraps_and_truncates(spark):
    assert from_values(spark, [2147483647, 2147483647, 4], "int").scalar("average") == 0
    assert from_values(spark, [-1, -2], "int").scalar("average") == -1


def test_pipeline_is_lazy_fused_and_branches(spark):
    p = from_values(spark, [1.0, 2.0, 3.0], "double").select(lambda x: x + 1)
    a, b = p.select(lambda x: x * 10), p.select(e.sqrt)
    assert a.to_array() == [20, 30, 40] and b.to_array() == pytest.approx([2**0.5, 3**0.5, 2])
    assert a.operation_count == 2 and a.length == 3
    assert a.df._jdf.queryExecution().optimizedPlan().toString().count("Project") <= 1


def test_zip_checks_length_when_it_runs(spark):
    a, b = from_values(spark, [1, 2, 3], "int"), from_values(spark, [3, 2, 1], "int")
    assert a.zip(b, lambda x, y: x * y + 1).to_array() == [4, 5, 4]
    short = a.zip(from_values(spark, [1, 2], "int"), lambda x, y: x + y)
    with pytest.raises(Exception, match="arrays differ in length"):
        short.to_array()
    with pytest.raises(BufferMismatchError):
        a.zip(from_values(spark, [1.0]), lambda x, y: x)


def test_delegate_errors_propagate(spark):
    def wrong(v):
        raise RuntimeError("stop here")

    with pytest.raises(Exception, match="stop here"):
        from_values(spark, [1.0]).delegate(wrong).to_array()
    with pytest.raises(BackendNotSupportedError):
        from_values(spark, [1], "int").delegate(lambda v: v)


def test_explicit_backends_do_not_fall_back(spark):
    p = from_values(spark, [1.0, 2.0])
    assert p.explicit(lambda x: x + 1, "simd").to_array() == [2, 3]
    with pytest.raises(BackendUnavailableError):
        p.explicit(lambda x: x, "gpu")
    with pytest.raises(BackendNotSupportedError):
        p.explicit(lambda x: x, "auto")


def test_prepared_map_and_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [5.0])], "id int, v array<double>")
    p = from_packed(df, "v", "id", "double")
    assert values(PreparedMap(lambda x: x * 2, "double").run(p.to_df())) == [2, 4, 10]
    write_parquet(p, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 3


def test_histograms(spark):
    v = [-0.1, 0, 0.1, 0.249, 0.25, 0.5, 0.75, 0.999, 1, 1.1, float("nan")]
    counts = lambda p, *a: [r["count"] for r in reductions.histogram(p.df, *a).orderBy("bin").collect()]
    assert counts(from_values(spark, v), 4, 0.0, 1.0, "ignore") == [3, 1, 1, 3]
    assert counts(from_values(spark, [-2, -0.1, 0.25, 0.75, 1.1, 2, float("nan")]), 2, 0.0, 1.0) == [3, 3]


def test_statistics(spark):
    row = statistics.calculate_statistics(from_values(spark, [1, 2, 3, 4], "double").df).first()
    assert [row[c] for c in ("mean", "variance", "skewness", "kurtosis")] == pytest.approx([2.5, 1.25, 0, -1.36], abs=1e-10)
    df = spark.createDataFrame([(float(x), 2.0 * x + 1) for x in range(1, 6)], "x double, y double")
    fit = statistics.linear_regression(F.col("x"), F.col("y"))
    row = df.select(statistics.correlation(F.col("x"), F.col("y")).alias("r"), *[c.alias(n) for n, c in fit.items()]).first()
    assert tuple(row) == pytest.approx((1, 2, 1, 1), abs=1e-10)
    assert statistics.autocorrelation(from_values(spark, [1, 2, 3, 4], "double").df, 0).first()["value"] == pytest.approx(1)


def test_autocorrelation_beyond_a_block(spark):
    df = spark.range(70_200).select(F.lit(1).alias("series_id"), F.col("id").alias("idx"), F.sin(F.col("id") * F.col("id") % 977).alias("value"))
    v = np.array([r[0] for r in df.orderBy("idx").select("value").collect()])
    assert statistics.autocorrelation(df, 70_000).first()["value"] == pytest.approx(np.corrcoef(v[:-70_000], v[70_000:])[0, 1], abs=1e-9)
    with pytest.raises(Exception, match="lag exceeds the series"):
        statistics.autocorrelation(df, 70_200).collect()


def test_neighbours_go_by_idx(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in (0, 1, 3, 4)], "series_id int, idx long, value double")
    got = [(r["b"], r["a"]) for r in neighbours(df, {"b": -1, "a": 1}).orderBy("idx").collect()]
    assert got == [(None, 1.0), (0.0, None), (None, 4.0), (3.0, None)]


@pytest.mark.parametrize("block", [1, 3, 100])
def test_attach_meets_every_block(spark, block):
    df = spark.createDataFrame([(s, i, float(i)) for s in (1, 2) for i in range(5 * s)], "series_id int, idx long, value double")
    rows = df.groupBy("series_id").agg(F.count("*").alias("n"), series.last_block(block))
    got = sorted(tuple(r) for r in series.attach(df, rows, block).select("series_id", "idx", "value", "n").collect())
    assert got == [(s, i, float(i), 5 * s) for s in (1, 2) for i in range(5 * s)]


def test_entropy_percentiles_and_median(spark):
    df = spark.createDataFrame([("a", 1)] * 4 + [("b", 0)] * 4, "series_id string, count int")
    assert {r[0]: r[1] for r in statistics.shannon_entropy(df).collect()} == {"a": 2, "b": 0}
    x = from_values(spark, [4, 1, 3, 2], "double").df
    assert x.select(statistics.median(F.col("value")), statistics.percentile(F.col("value"), 90)).first() == (2.5, 3.7)


def test_peaks(spark):
    df = from_values(spark, [1, 5, 1, 4, 1], "double").df
    assert [r["idx"] for r in signal.find_peaks(df).orderBy("idx").collect()] == [1, 3]
    assert [r["idx"] for r in signal.find_peaks(df, distance=3).collect()] == [1]
    assert signal.peak_to_median(df).first()["value"] == 5


def test_windows_normalize_and_safe_divide(spark):
    assert values(signal.apply_window(from_values(spark, [1] * 5, "double").df, "hann")) == pytest.approx([0, 0.5, 1, 0.5, 0])
    assert values(elementwise.normalize(from_values(spark, [2, 4, 6]).df)) == [0, 0.5, 1]
    assert values(elementwise.normalize(from_values(spark, [3, 3]).df)) == [0, 0]
    df = spark.createDataFrame([(4.0, 2.0), (5.0, 0.0), (6.0, -3.0)], "a double, b double")
    assert [r[0] for r in df.select(elementwise.safe_divide(F.col("a"), F.col("b"), -1.0, kind="double")).collect()] == [2, -1, -2]


@pytest.mark.parametrize("block", [4, 7, 64])
def test_one_long_series_over_many_blocks(spark, block):
    v = [(17 * i % 31) / 30 for i in range(37)]
    df = neighbours(from_values(spark, v, "double").df, {"b": -2, "a": 1}, block)
    got = [(r["b"], r["a"]) for r in df.orderBy("idx").collect()]
    assert got == [(v[i - 2] if i > 1 else None, v[i + 1] if i < 36 else None) for i in range(37)]


@pytest.mark.parametrize("boundary", ["clamp", "zero"])
def test_convolution(spark, boundary):
    v = np.array([(17 * i % 31) / 30 for i in range(37)])
    got = values(signal.convolve1d(from_values(spark, v.tolist(), "double").df, [0.25, 0.5, 0.1], boundary))
    padded = np.pad(v, 1, mode="edge" if boundary == "clamp" else "constant")
    assert got == pytest.approx(0.25 * padded[:-2] + 0.5 * padded[1:-1] + 0.1 * padded[2:])


def test_fourier_round_trip(spark):
    re, im = [math.sin(0.37 * i) for i in range(16)], [0.25 * math.cos(0.19 * i) for i in range(16)]
    df = spark.createDataFrame([(1, re, im)], "id int, re array<double>, im array<double>")
    out = fourier.fft(df, ["id"])
    row = out.first()
    assert np.array(row["re"]) + 1j * np.array(row["im"]) == pytest.approx(np.fft.fft(np.array(re) + 1j * np.array(im)))
    assert fourier.fft(out, ["id"], inverse=True).first()["re"] == pytest.approx(re)
    with pytest.raises(Exception, match="power of two"):
        fourier.fft(spark.createDataFrame([(1, [1.0] * 3, [0.0] * 3)], df.schema), ["id"]).collect()


def test_context(spark):
    df = from_values(spark, list(range(100))).df
    rows, report = Context(spark).diagnose(df)
    assert len(rows) == 100 and report.elements == 100 and report.plan
    rows, report = Context(spark).diagnose(df, fetch=False)
    assert rows is None and report.elements == 100
    assert Context(spark, Options(chunk_elements=10)).arrange(df).rdd.getNumPartitions() == 10
    with pytest.raises(MemoryBudgetExceededError):
        Context(spark, Options(memory_budget=16, allow_chunks=False)).arrange(df)
    with pytest.raises(ValueError):
        Options(mode="fast")
    kept = Context(spark).upload(df)
    assert kept.download() == list(range(100)) and kept.df.is_cached
    kept.unpersist()
    assert Context(spark).run(lambda: df.count()) == 100
    assert Context(spark).submit(from_values(spark, [1, 2]).to_array).result(60) == [1, 2]
