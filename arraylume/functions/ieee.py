"""Scalar functions on Columns with IEEE-754 and wrapping 32-bit semantics.

``kind`` is ``float``, ``double`` or ``int``. Floating results are rounded to the
kind after each operation, NaN and infinities follow IEEE, integers wrap. Nothing
depends on ``spark.sql.ansi.enabled``, save that integer division by zero fails.
Null operands give null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("float", "double", "int")
NAN, INF = float("nan"), float("inf")


def as_kind(c: Column, kind: str) -> Column:
    return wrap32(c) if kind == "int" else c.cast(kind)


def wrap32(c: Column) -> Column:
    """A BIGINT value modulo 2**32 as INT."""
    return (F.pmod(c.cast("bigint") + F.lit(2**31).cast("bigint"), F.lit(2**32).cast("bigint")) - F.lit(2**31).cast("bigint")).cast("int")


def _wide(c: Column, kind: str) -> Column:
    return c.cast("bigint") if kind == "int" else c.cast(kind)


def add(a: Column, b: Column, kind: str) -> Column:
    return as_kind(_wide(a, kind) + _wide(b, kind), kind)


def subtract(a: Column, b: Column, kind: str) -> Column:
    return as_kind(_wide(a, kind) - _wide(b, kind), kind)


def multiply(a: Column, b: Column, kind: str) -> Column:
    return as_kind(_wide(a, kind) * _wide(b, kind), kind)


def negate(a: Column, kind: str) -> Column:
    return as_kind(-_wide(a, kind), kind)


def _minus_zero(c: Column) -> Column:
    return c.cast("string") == "-0.0"


def divide(a: Column, b: Column, kind: str) -> Column:
    """IEEE division; of integers, truncation towards zero and an error for zero."""
    if kind == "int":
        return wrap32(F.call_function("div", a.cast("bigint"), b.cast("bigint")))
    a, b = a.cast(kind), b.cast(kind)
    quotient = a / F.when(b != 0, b)
    infinite = F.when((a < 0) != _minus_zero(b), F.lit(-INF)).otherwise(F.lit(INF))
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).otherwise(infinite)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(b != 0, quotient).otherwise(by_zero).cast(kind)


def absolute(a: Column, kind: str) -> Column:
    return as_kind(F.abs(_wide(a, kind)), kind)


def _either_nan(a: Column, b: Column) -> Column:
    return F.isnan(a) | F.isnan(b)


def _known(a: Column, b: Column, value: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), value)


def minimum(a: Column, b: Column, kind: str) -> Column:
    """NaN if either is NaN."""
    a, b = a.cast(kind), b.cast(kind)
    if kind == "int":
        return _known(a, b, F.least(a, b))
    return _known(a, b, F.when(_either_nan(a, b), F.lit(NAN)).otherwise(F.least(a, b))).cast(kind)


def maximum(a: Column, b: Column, kind: str) -> Column:
    a, b = a.cast(kind), b.cast(kind)
    return _known(a, b, F.greatest(a, b)).cast(kind)


def clamp(x: Column, low, high, kind: str) -> Column:
    """Bounds may be numbers or Columns; low > high is an error, NaN stays NaN."""
    if not isinstance(low, Column) and not isinstance(high, Column):
        if low > high:
            raise ValueError(f"clamp bounds {low} > {high}")
        wrong = None
    else:
        wrong = F.raise_error(F.lit("clamp: low bound exceeds high bound"))
    lo, hi = (b if isinstance(b, Column) else F.lit(b) for b in (low, high))
    lo, hi, x = lo.cast(kind), hi.cast(kind), x.cast(kind)
    held = F.greatest(lo, F.least(x, hi))
    if kind != "int":
        held = F.when(F.isnan(x), x).otherwise(held)
    held = _known(x, lo, held)
    return (held if wrong is None else F.when(lo > hi, wrong.cast(kind)).otherwise(held)).cast(kind)


def log(x: Column, kind: str, base10: bool = False) -> Column:
    """-Infinity at zero, NaN below."""
    x = x.cast(kind)
    value = F.log10(x) if base10 else F.ln(x)
    return F.when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN)).otherwise(value).cast(kind)


def _integral(x: Column, kind: str, rounded: Column) -> Column:
    x = x.cast(kind)
    plain = F.isnan(x) | (F.abs(x) >= F.lit(float(2**52)))
    return F.when(plain, x).otherwise(rounded).cast(kind)


def floor(x: Column, kind: str) -> Column:
    return _integral(x, kind, F.floor(F.when(F.abs(x) < F.lit(float(2**52)), x)))


def ceiling(x: Column, kind: str) -> Column:
    return _integral(x, kind, F.ceil(F.when(F.abs(x) < F.lit(float(2**52)), x)))


def rounded(x: Column, kind: str) -> Column:
    """Half to even."""
    return F.rint(x.cast(kind)).cast(kind)


def at_least(x: Column, t) -> Column:
    """x >= t with NaN compared as false."""
    return ~F.isnan(x) & (x >= t)


def atan2(y: Column, x: Column, kind: str) -> Column:
    """Pi for a zero y and a negative zero x."""
    y, x = y.cast(kind), x.cast(kind)
    value = F.when((y == 0) & _minus_zero(x), F.when(_minus_zero(y), F.lit(-math.pi)).otherwise(F.lit(math.pi)))
    return value.otherwise(F.atan2(y, x)).cast(kind)
