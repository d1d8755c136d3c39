"""Lazy array pipelines: map, positional zip and fused reductions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arraylume.functions import expression, ieee
from arraylume.functions.errors import BackendNotSupportedError, BackendUnavailableError, BufferMismatchError
from arraylume.operators import reduce as reductions

BACKENDS = ("auto", "scalar", "parallel", "simd", "gpu")


class ArrayPipeline:
    """An immutable plan over (series_id, idx, value); nothing runs before a
    terminal. Chained selects become one projection, reductions take it in."""

    def __init__(self, df: DataFrame, kind: str = "float", operations: int = 0) -> None:
        self.df, self.kind, self.operation_count = df, kind, operations

    # -- building ---------------------------------------------------------
    def _with(self, value: Column, df: DataFrame | None = None) -> ArrayPipeline:
        return ArrayPipeline((self.df if df is None else df).select("series_id", "idx", value.alias("value")), self.kind, self.operation_count + 1)

    def select(self, f: Callable) -> ArrayPipeline:
        return self._with(expression.build(f, self.kind, [F.col("value")]))

    select_in_place = select

    def zip(self, other: ArrayPipeline, f: Callable) -> ArrayPipeline:
        """By position; a length that differs fails when the plan runs."""
        if other.kind != self.kind:
            raise BufferMismatchError(f"zip of {self.kind} and {other.kind} arrays")
        if other.df.sparkSession is not self.df.sparkSession:
            raise BufferMismatchError("both arrays must belong to one session")
        joined = self.df.withColumn("has_l", F.lit(True)).join(other.df.select("series_id", "idx", F.col("value").alias("right"), F.lit(True).alias("has_r")), ["series_id", "idx"], "full_outer")
        value = expression.build(f, self.kind, [F.col("value"), F.col("right")])
        checked = F.when(F.col("has_l").isNull() | F.col("has_r").isNull(), F.raise_error(F.lit("arrays differ in length"))).otherwise(value)
        return self._with(checked.cast(self.kind), joined)

    zip_in_place = zip

    def delegate(self, f: Callable) -> ArrayPipeline:
        """An arbitrary vectorised Python function (pandas Series -> Series) of a
        float array; its exceptions fail the plan."""
        if self.kind != "float":
            raise BackendNotSupportedError("delegate", f"{self.kind} arrays", "float arrays")

        def apply(values: pd.Series) -> pd.Series:
            return f(values)

        return self._with(F.pandas_udf(apply, "float")("value"))

    def explicit(self, f: Callable, backend: str) -> ArrayPipeline:
        """Map on a backend of one's choice. Spark's executors stand for all CPU
        backends; explicit choices never fall back."""
        if backend not in BACKENDS or backend == "auto":
            raise BackendNotSupportedError(backend, "an explicit map", ", ".join(BACKENDS[1:]))
        if backend == "gpu" and not self.df.sparkSession.conf.get("spark.plugins", ""):
            raise BackendUnavailableError("no accelerator plugin is configured in spark.plugins")
        return self.select(f)

    def persist(self) -> ArrayPipeline:
        """Marks the place where values are kept (memory, then disk)."""
        return ArrayPipeline(self.df.persist(), self.kind, self.operation_count)

    def unpersist(self) -> None:
        self.df.unpersist()

    # -- terminals --------------------------------------------------------
    def to_df(self) -> DataFrame:
        return self.df

    def to_array(self) -> list:
        return [r[0] for r in self.df.orderBy("series_id", "idx").select("value").collect()]

    download = to_array

    @property
    def length(self) -> int:
        return self.df.count()

    def sum(self) -> DataFrame:
        return reductions.reduce(self.df, "sum", self.kind)

    def min(self) -> DataFrame:
        return reductions.reduce(self.df, "min", self.kind)

    def max(self) -> DataFrame:
        return reductions.reduce(self.df, "max", self.kind)

    def average(self) -> DataFrame:
        return reductions.reduce(self.df, "average", self.kind)

    def scalar(self, name: str):
        """A reduction of the only series, as a Python value."""
        return reductions.scalar(self.df, name, self.kind)


def zip_rows(df: DataFrame, left: str, right: str, f: Callable, kind: str = "float", series_id=None) -> ArrayPipeline:
    """Zip of two columns of one table: a projection, no join."""
    key = F.lit(0) if series_id is None else F.col(series_id)
    return ArrayPipeline(df.select(key.alias("series_id"), F.lit(None).cast("long").alias("idx"), expression.build(f, kind, [F.col(left), F.col(right)]).alias("value")), kind, 1)


def zip_packed(df: DataFrame, left: str, right: str, f: Callable, kind: str = "float") -> Column:
    """Zip of two array columns; lengths that differ fail."""
    zipped = F.zip_with(left, right, lambda a, b: expression.build(f, kind, [a, b]))
    return F.when(F.size(left) == F.size(right), zipped).otherwise(F.raise_error(F.lit("arrays differ in length")).cast(f"array<{kind}>"))


def map_packed(values, f: Callable, kind: str = "float") -> Column:
    return F.transform(values, lambda v: expression.build(f, kind, [v]))


class PreparedMap:
    """A map whose expression is built once and applied to many tables."""

    def __init__(self, f: Callable, kind: str = "float") -> None:
        self.kind = kind
        self.column = expression.build(f, kind, [F.col("value")])

    def run(self, df: DataFrame) -> DataFrame:
        return df.select("series_id", "idx", self.column.alias("value"))


__all__ = ["ArrayPipeline", "PreparedMap", "ieee", "map_packed", "zip_packed", "zip_rows"]
