"""Array sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arraylume.operators.series import series, unpack
from arraylume.plans.pipeline import ArrayPipeline


def from_values(spark: SparkSession, values: Sequence, kind: str = "float") -> ArrayPipeline:
    """A small literal array."""
    rows = [(0, i, int(v) if kind == "int" else float(v)) for i, v in enumerate(values)]
    return ArrayPipeline(spark.createDataFrame(rows, f"series_id int, idx long, value {kind}"), kind)


def from_table(df: DataFrame, value, idx=None, series_id=None, kind: str = "float") -> ArrayPipeline:
    return ArrayPipeline(series(df, value, idx, series_id, kind), kind)


def from_packed(df: DataFrame, values: str, series_id: str, kind: str = "float") -> ArrayPipeline:
    return ArrayPipeline(unpack(df, values, series_id).withColumn("value", F.col("value").cast(kind)), kind)


def read_parquet(spark: SparkSession, path: str, value: str, idx=None, series_id=None, kind: str = "float") -> ArrayPipeline:
    return from_table(spark.read.parquet(path), value, idx, series_id, kind)


def write_parquet(pipeline: ArrayPipeline, path: str, mode: str = "error") -> None:
    pipeline.to_df().write.mode(mode).parquet(path)
