"""Composite values: structs of 1 to 16 fields, all FLOAT or all byte (SMALLINT)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arraylume.functions import ieee
from arraylume.functions.errors import ExpressionNotSupportedError
from arraylume.functions.expression import Operand


@dataclass(frozen=True)
class Descriptor:
    names: tuple[str, ...]
    byte: bool


def describe(struct: T.StructType) -> Descriptor:
    kinds = {f.dataType.typeName() for f in struct}
    if not 1 <= len(struct) <= 16 or len(kinds) != 1 or kinds - {"float", "short"}:
        raise ExpressionNotSupportedError(f"a struct {struct.simpleString()}", "composite value", "1 to 16 fields, all float or all smallint")
    return Descriptor(tuple(struct.fieldNames()), kinds == {"short"})


class Fields:
    """Attribute access to a composite value's fields as operands. Bytes count as
    int: their arithmetic wraps at 32 bits and divides towards zero."""

    def __init__(self, column: str, d: Descriptor) -> None:
        kind = "int" if d.byte else "float"
        self.__dict__.update({n: Operand(kind, F.col(f"{column}.{n}").cast(kind)) for n in d.names})


def to_byte(x: Operand) -> Operand:
    """Unchecked narrowing to 0..255; of floats, after truncation towards zero."""
    whole = x.column if x.kind == "int" else F.when(F.isnan(x.column), F.lit(0)).otherwise(x.column.cast("bigint"))
    return Operand("int", F.pmod(whole, F.lit(256)).cast("int"))


def to_float(x: Operand) -> Operand:
    return Operand("float", x.column.cast("float"))


class CompositePipeline:
    """Lazy maps of a struct column named ``value``."""

    def __init__(self, df: DataFrame, column: str = "value") -> None:
        self.df, self.column = df, column
        self.descriptor = describe(df.schema[column].dataType)

    def _put(self, value: Column) -> DataFrame:
        return self.df.withColumn(self.column, value)

    def select(self, f: Callable, byte: bool | None = None) -> CompositePipeline:
        """To a struct: ``f`` returns operands by field name. The target is of bytes
        or floats like the source unless ``byte`` says otherwise."""
        byte = self.descriptor.byte if byte is None else byte
        made = f(Fields(self.column, self.descriptor))
        plain = lambda v: v.column if isinstance(v, Operand) else F.lit(v)
        fields = [(F.pmod(plain(v), F.lit(256)).cast("smallint") if byte else plain(v).cast("float")).alias(n) for n, v in made.items()]
        return CompositePipeline(self._put(F.struct(*fields)), self.column)

    select_in_place = select

    def project(self, f: Callable) -> DataFrame:
        """To one float per value."""
        return self._put(f(Fields(self.column, self.descriptor)).column.cast("float"))

    def to_df(self) -> DataFrame:
        return self.df


def complex_op(name: str, a: Column, b: Column) -> Column:
    """add, subtract, multiply of structs (re, im); scale by a number."""
    re, im = a["re"], a["im"]
    if name == "scale":
        pair = re * b, im * b
    elif name in ("add", "subtract"):
        pair = (re + b["re"], im + b["im"]) if name == "add" else (re - b["re"], im - b["im"])
    elif name == "multiply":
        pair = re * b["re"] - im * b["im"], re * b["im"] + im * b["re"]
    else:
        raise ValueError(f"complex operation {name!r} is unknown")
    return F.struct(pair[0].cast("float").alias("re"), pair[1].cast("float").alias("im"))


def complex_magnitude(a: Column) -> Column:
    return F.sqrt(a["re"] * a["re"] + a["im"] * a["im"]).cast("float")


__all__ = ["CompositePipeline", "Descriptor", "complex_magnitude", "complex_op", "describe", "ieee", "to_byte", "to_float"]
