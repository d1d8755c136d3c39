"""Registration of queries and small helpers for their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Catalog:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracle: dict = {}

    def add(self, name: str, sql: str | None = None):
        def keep(f):
            if name in self.queries:
                raise ValueError(f"query {name} exists")
            self.queries[name] = f
            if sql:
                self.oracle[name] = sql
            return f

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(c, digits: int = 6) -> Column:
    """A rounded double; NaN and infinities become marked numbers, -0 becomes 0."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(F.isnan(c), -999.0).when(c == float("inf"), 998.0).when(c == float("-inf"), -998.0).otherwise(F.round(c, digits) + 0.0)


def plain_sql(c: str, digits: int = 6) -> str:
    return f"CASE WHEN isnan(({c})::DOUBLE) THEN -999.0 WHEN isinf(({c})::DOUBLE) THEN CASE WHEN ({c}) > 0 THEN 998.0 ELSE -998.0 END ELSE round(({c})::DOUBLE, {digits}) + 0.0 END::DOUBLE"
