"""Element expressions: Python lambdas over typed operands that build Columns.

``build(lambda x: sin(x) * 2, kind, [column])`` calls the lambda once, while the
plan is made; numbers it closes over become constants then. Constants are folded
and the neutral operations that keep every bit (``--x``, ``x * 1``, ``x / 1``,
``x - 0``) go; ``x * 0`` and ``x + 0`` stay. Comparisons and data-dependent
branches are refused; a Python ``if`` on a captured bool picks a branch.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from arraylume.functions import ieee
from arraylume.functions.errors import ExpressionNotSupportedError

ALLOWED = "+ - * /, unary -, the functions of arraylume.functions.expression, captured numbers and Python 'if' on captured bools"


def _to_kind(value: float, kind: str):
    if kind == "int":
        if value != int(value):
            raise ExpressionNotSupportedError("a fractional constant", repr(value), "whole numbers in int arrays")
        return (int(value) + 2**31) % 2**32 - 2**31
    try:
        return struct.unpack("f", struct.pack("f", value))[0] if kind == "float" else float(value)
    except OverflowError:
        return math.copysign(math.inf, value)


class Operand:
    """A typed value: a constant or a Column. ``negated`` keeps -x's x."""

    __slots__ = ("kind", "column", "constant", "negated", "depth")

    def __init__(self, kind: str, column: Column | None = None, constant=None, negated: Operand | None = None) -> None:
        self.kind, self.constant, self.negated = kind, constant, negated
        self.column = F.lit(constant).cast(kind) if column is None else column

    def _coerce(self, other, what: str) -> Operand:
        if isinstance(other, Operand):
            if other.kind != self.kind:
                raise ExpressionNotSupportedError(f"mixing {self.kind} and {other.kind}", what, "operands of one kind")
            return other
        if isinstance(other, bool) or not isinstance(other, int | float):
            raise ExpressionNotSupportedError(type(other).__name__, what, ALLOWED)
        return Operand(self.kind, constant=_to_kind(other, self.kind))

    def _is(self, number: float) -> bool:
        return self.constant is not None and self.constant == number and (number != 0 or math.copysign(1, self.constant) > 0)

    def _binary(self, other, name: str, swap: bool = False) -> Operand:
        other = self._coerce(other, name)
        a, b = (other, self) if swap else (self, other)
        if name == "multiply" and (a._is(1) or b._is(1)):
            return b if a._is(1) else a
        if name == "divide" and b._is(1) or name == "subtract" and b._is(0):
            return a
        if a.constant is not None and b.constant is not None and not (name == "divide" and b.constant == 0):
            x, y = a.constant, b.constant
            exact = {"add": lambda: x + y, "subtract": lambda: x - y, "multiply": lambda: x * y, "divide": lambda: int(math.trunc(x / y)) if self.kind == "int" else x / y}[name]
            return Operand(self.kind, constant=_to_kind(exact(), self.kind))
        return Operand(self.kind, getattr(ieee, name)(a.column, b.column, self.kind))

    def __add__(self, other):
        return self._binary(other, "add")

    def __radd__(self, other):
        return self._binary(other, "add", True)

    def __sub__(self, other):
        return self._binary(other, "subtract")

    def __rsub__(self, other):
        return self._binary(other, "subtract", True)

    def __mul__(self, other):
        return self._binary(other, "multiply")

    def __rmul__(self, other):
        return self._binary(other, "multiply", True)

    def __truediv__(self, other):
        return self._binary(other, "divide")

    def __rtruediv__(self, other):
        return self._binary(other, "divide", True)

    def __neg__(self):
        if self.negated is not None:
            return self.negated
        if self.constant is not None:
            return Operand(self.kind, constant=_to_kind(-self.constant, self.kind))
        return Operand(self.kind, ieee.negate(self.column, self.kind), negated=self)

    def _refuse(self, *_):
        raise ExpressionNotSupportedError("a comparison or data-dependent branch", "element expression", ALLOWED)

    __lt__ = __le__ = __gt__ = __ge__ = __eq__ = __ne__ = __bool__ = _refuse
    __hash__ = None

    def __getattr__(self, name):
        raise ExpressionNotSupportedError(f"attribute {name}", "element expression", ALLOWED)


def _function(name: str, make: Callable[..., Column], ints: bool = False) -> Callable:
    def call(*arguments):
        first = next((a for a in arguments if isinstance(a, Operand)), None)
        if first is None:
            raise ExpressionNotSupportedError(f"{name} of constants only", name, "at least one array operand")
        if first.kind == "int" and not ints:
            raise ExpressionNotSupportedError(f"{name} of int", name, "float or double arrays")
        operands = [first._coerce(a, name) for a in arguments]
        return Operand(first.kind, make(*(o.column for o in operands), first.kind))

    call.__name__, call.__doc__ = name, f"{name} of element operands."
    return call


def _plain(f: Callable[[Column], Column]) -> Callable:
    return lambda x, kind: f(x).cast(kind)


absolute = _function("abs", ieee.absolute, True)
minimum = _function("min", ieee.minimum, True)
maximum = _function("max", ieee.maximum, True)
sqrt = _function("sqrt", _plain(F.sqrt))
sin = _function("sin", _plain(F.sin))
cos = _function("cos", _plain(F.cos))
tan = _function("tan", _plain(F.tan))
exp = _function("exp", _plain(F.exp))
log = _function("log", ieee.log)
log10 = _function("log10", lambda x, kind: ieee.log(x, kind, True))
power = _function("pow", lambda x, y, kind: F.pow(x, y).cast(kind))
floor = _function("floor", ieee.floor)
ceiling = _function("ceiling", ieee.ceiling)
round_even = _function("round", ieee.rounded)


def clamp(x: Operand, low, high) -> Operand:
    """x held between low and high."""
    if not isinstance(x, Operand):
        raise ExpressionNotSupportedError("clamp of a constant", "clamp", "an array operand")
    bounds = [b.constant if isinstance(b, Operand) and b.constant is not None else b.column if isinstance(b, Operand) else _to_kind(b, x.kind) for b in (low, high)]
    return Operand(x.kind, ieee.clamp(x.column, *bounds, x.kind))


def build(f: Callable, kind: str, columns: Sequence[Column]) -> Column:
    """The Column that a lambda over ``columns`` (cast to ``kind``) stands for."""
    if kind not in ieee.KINDS:
        raise ExpressionNotSupportedError(f"kind {kind}", "array", "float, double or int")
    result = f(*(Operand(kind, c.cast(kind)) for c in columns))
    if not isinstance(result, Operand):
        result = Operand(kind, constant=_to_kind(result, kind)) if isinstance(result, int | float) and not isinstance(result, bool) else None
    if result is None:
        raise ExpressionNotSupportedError("a result that is no element value", "element expression", ALLOWED)
    return result.column
