"""Scalar semantics against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arraylume.functions import expression as e
from arraylume.functions import ieee
from arraylume.functions.errors import ExpressionNotSupportedError

SPECIAL = [1.0, -1.0, 0.0, -0.0, 2.5, 3.5, -2.5, float("nan"), float("inf"), float("-inf"), 1e-30, 5e18]


def same(x, y):
    return (math.isnan(x) and math.isnan(y)) or x == y and (x != 0 or True)


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(a, b) for a in SPECIAL for b in SPECIAL], "a double, b double").cache()


def check(df, column, f):
    for a, b, got in df.select("a", "b", column.alias("c")).collect():
        with np.errstate(all="ignore"):
            want = float(f(np.float64(a), np.float64(b)))
        assert same(got, want), (a, b, got, want)


def test_divide(pairs):
    check(pairs, ieee.divide(F.col("a"), F.col("b"), "double"), lambda a, b: a / b)


def test_minimum_maximum_propagate_nan(pairs):
    check(pairs, ieee.minimum(F.col("a"), F.col("b"), "double"), np.minimum)
    check(pairs, ieee.maximum(F.col("a"), F.col("b"), "double"), np.maximum)


@pytest.mark.parametrize(("name", "f"), [("floor", np.floor), ("ceiling", np.ceil), ("rounded", np.round)])
def test_rounding(pairs, name, f):
    check(pairs, getattr(ieee, name)(F.col("a"), "double"), lambda a, _: f(a))


def test_logarithms(pairs):
    check(pairs, ieee.log(F.col("a"), "double"), lambda a, _: np.log(a))
    check(pairs, ieee.log(F.col("a"), "double", True), lambda a, _: np.log10(a))


def test_clamp_keeps_nan_and_checks_bounds(pairs):
    check(pairs, ieee.clamp(F.col("a"), -1, 2, "double"), lambda a, _: a if np.isnan(a) else min(max(a, -1), 2))
    with pytest.raises(ValueError):
        ieee.clamp(F.col("a"), 2, 1, "double")


def test_integers_wrap_and_divide_towards_zero(spark):
    df = spark.createDataFrame([(2147483647, 1), (-2147483648, -1), (-7, 2), (7, -2)], "a int, b int")
    c = [F.col("a"), F.col("b")]
    rows = df.select(*[e.build(f, "int", c).alias(n) for n, f in {"add": lambda a, b: a + b, "mul": lambda a, b: a * b, "div": lambda a, b: a / b, "neg": lambda a, b: -a}.items()]).collect()
    assert [r["add"] for r in rows] == [-2147483648, 2147483647, -5, 5]
    assert [r["div"] for r in rows] == [2147483647, -2147483648, -3, -3]
    assert rows[1]["neg"] == -2147483648 and rows[0]["mul"] == 2147483647


def test_nulls_stay_null(spark):
    df = spark.createDataFrame([(None, 1.0), (1.0, None)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    for c in (ieee.divide(a, b, "double"), ieee.minimum(a, b, "double"), ieee.maximum(a, b, "double"), ieee.add(a, b, "double")):
        assert [r[0] for r in df.select(c).collect()] == [None, None]


def test_float32_is_rounded_after_each_step(spark):
    df = spark.createDataFrame([(0.1,), (16777216.0,)], "x float")
    got = [r[0] for r in df.select(e.build(lambda x: (x + 1) * 3, "float", [F.col("x")])).collect()]
    assert got == [float((np.float32(v) + np.float32(1)) * np.float32(3)) for v in (0.1, 16777216.0)]


def test_atan2_of_minus_zero(spark):
    df = spark.createDataFrame([(0.0, -0.0), (1.0, 0.0), (0.0, 1.0)], "y double, x double")
    assert [r[0] for r in df.select(ieee.atan2(F.col("y"), F.col("x"), "double")).collect()] == [math.pi, math.pi / 2, 0.0]


def build(f, spark, kind="double"):
    return spark.range(1).select(e.build(f, kind, [F.lit(2).cast(kind)]).alias("v"))


def test_strict_identities(spark):
    plain = str(e.build(lambda x: x, "double", [F.col("v")]))
    assert str(e.build(lambda x: (-(-x) * 1 - 0.0) / 1, "double", [F.col("v")])) == plain
    for f in (lambda x: x * 0, lambda x: x + 0, lambda x: x - (-0.0)):
        assert str(e.build(f, "double", [F.col("v")])) != plain


def test_constants_fold_and_are_snapshots(spark):
    scale = 3.0
    df = build(lambda x: x * (scale * 2), spark)
    scale = 100.0  # noqa: F841
    assert df.first()[0] == 12.0
    assert build(lambda x: e.sqrt(x * 2), spark).first()[0] == 2.0


@pytest.mark.parametrize("f", [lambda x: x > 1, lambda x: 1 if x else 2, lambda x: x.name, lambda x: x + "a", lambda x: x + True, lambda x: None])
def test_unsupported_expressions_say_what_to_use(f, spark):
    with pytest.raises(ExpressionNotSupportedError) as caught:
        build(f, spark)
    assert caught.value.allowed


def test_functions_refuse_int(spark):
    with pytest.raises(ExpressionNotSupportedError):
        build(e.sqrt, spark, "int")
