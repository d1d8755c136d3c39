"""Long and packed layouts of arrays.

Long: one row per element, ``series_id, idx, value`` (idx counts from 0 within the
series). Packed: one row per series, ``series_id, values ARRAY``. The long layout
is for neighbours, joins and series of any length; the packed one for many short
vectors. Both ignore further columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Elements of a block when one series is spread over tasks.
BLOCK = 1 << 16


def series(df: DataFrame, value, idx=None, series_id=None, kind: str = "double") -> DataFrame:
    """Long layout from columns of any table; without ``idx`` the elements have no
    order, which is enough for maps and reductions."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select((F.lit(0) if series_id is None else column(series_id)).alias("series_id"), (F.lit(None).cast("long") if idx is None else column(idx).cast("long")).alias("idx"), column(value).cast(kind).alias("value"))


def indexed(df: DataFrame, series_id: str, order: list[str]) -> DataFrame:
    """Adds ``idx``, the place of a row in its series by the given order."""
    return df.withColumn("idx", (F.row_number().over(Window.partitionBy(series_id).orderBy(*order)) - 1).cast("long"))


def unpack(df: DataFrame, values: str, series_id: str) -> DataFrame:
    return df.select(F.col(series_id).alias("series_id"), F.posexplode(values).alias("idx", "value")).withColumn("idx", F.col("idx").cast("long"))


def pack(df: DataFrame) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("idx", "value")))
    return df.groupBy("series_id").agg(F.transform(ordered, lambda e: e["value"]).alias("values"))


def same_length(a: Column, b: Column, value: Column) -> Column:
    """value, or an error where two packed arrays differ in length."""
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("arrays differ in length")))


def with_halo(df: DataFrame, before: int, after: int, block: int = BLOCK) -> DataFrame:
    """Adds ``block`` and ``own``: each block of a series also holds, with ``own``
    false, ``before`` elements of those in front of it and ``after`` of those
    behind it. Windows over (series_id, block) then see every neighbour while one
    series is spread over many tasks."""
    if max(before, after) >= block:
        raise ValueError("a halo must be smaller than a block")
    home = F.floor(F.col("idx") / block)
    place = F.pmod(F.col("idx"), F.lit(block))
    copies = F.filter(F.array(home, F.when(place >= block - before, home + 1), F.when((place < after) & (home > 0), home - 1)), lambda b: b.isNotNull())
    return df.withColumn("home", home).withColumn("block", F.explode(copies)).withColumn("own", F.col("block") == F.col("home")).drop("home")


def neighbours(df: DataFrame, offsets: dict[str, int], block: int = BLOCK) -> DataFrame:
    """Adds, by name, the value at ``idx + offset`` of the series (null where the
    series has no element of that idx)."""
    before, after = max(0, -min(offsets.values())), max(0, *offsets.values())
    w = Window.partitionBy("series_id", "block").orderBy("idx")
    # A row that far away is the neighbour only if its idx says so: an idx may be missing.
    near = lambda o: F.when(F.lead("idx", o).over(w) == F.col("idx") + o, F.lead("value", o).over(w))
    shifted = with_halo(df, before, after, block).select("*", *[near(o).alias(n) for n, o in offsets.items()])
    return shifted.where("own").drop("own", "block")


def last_block(block: int = BLOCK) -> Column:
    """Aggregate: the number of a series' last block, for ``attach``."""
    return F.max(_block(block)).alias("last_block")


def _block(block: int) -> Column:
    return F.greatest(F.lit(0), F.floor(F.coalesce(F.col("idx"), F.lit(0)) / block))


def attach(df: DataFrame, rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The elements with the row of their series. ``rows`` has one row a series, with
    its ``last_block``, and is repeated for each block, so that the elements of one
    long series meet it in many tasks."""
    spread = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), "last_block"))).drop("last_block")
    return df.withColumn("block", _block(block)).join(spread, ["series_id", "block"]).drop("block")
