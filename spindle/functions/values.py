"""The dialect's types, and comparison of values on the driver (rows to insert, CHECK)."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
from pyspark.sql import types as T

from ..errors import TypeFault

SPARK = {"INT": T.IntegerType(), "FLOAT": T.FloatType(), "BOOLEAN": T.BooleanType(), "VARCHAR": T.StringType()}
#: Types that only registered files have. They can be read but not declared.
EXTENSION = {"bigint": "BIGINT", "double": "DOUBLE", "int": "INT", "float": "FLOAT", "boolean": "BOOLEAN", "string": "VARCHAR"}
WHOLE = ("INT", "BIGINT")
REAL = ("FLOAT", "DOUBLE")
NUMERIC = WHOLE + REAL
#: Whole numbers below this are floats exactly, and no larger one rounds to them.
FLOAT_EXACT = 1 << 24


def type_name(t: T.DataType) -> str:
    """The dialect's name of a Spark type; OTHER can be projected, sorted and counted only."""
    return EXTENSION.get(t.simpleString(), "OTHER")


def display(value) -> str:
    """A value's text: NULL, true, floats with six decimals."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            return str(value)
        return str(Decimal(value).quantize(Decimal("0.000001"), ROUND_HALF_EVEN)) if abs(value) < 1e15 else f"{value:.6f}"
    return str(value)


def float32(value) -> float:
    return float(np.float32(value))


def kind_of(value) -> str:
    if isinstance(value, bool):
        return "BOOLEAN"
    return {int: "INT", float: "FLOAT", str: "VARCHAR"}[type(value)]


def holds(value, op: str, other) -> bool:
    """Two-valued comparison: null or unlike types give False; whole and real meet as 32-bit floats."""
    if value is None or other is None:
        return False
    a, b = kind_of(value), kind_of(other)
    if a != b:
        if a not in NUMERIC or b not in NUMERIC:
            return False
        value, other = float32(value), float32(other)
    elif a == "FLOAT":
        value, other = float32(value), float32(other)
    elif a == "VARCHAR":
        value, other = value.encode(), other.encode()
    return {"=": value == other, "!=": value != other, "<": value < other, ">": value > other, "<=": value <= other, ">=": value >= other}[op]


def fit(value, column) -> object:
    """``value`` as the column stores it; TypeFault if it can't."""
    if value is None:
        if not column.nullable:
            raise TypeFault(f"column '{column.name}' cannot be NULL")
        return None
    if kind_of(value) != column.type:
        raise TypeFault(f"column '{column.name}' is {column.type}, the value is {kind_of(value)}")
    if column.type == "VARCHAR" and len(value.encode()) > column.length:
        raise TypeFault(f"column '{column.name}' holds {column.length} bytes at most")
    return float32(value) if column.type == "FLOAT" else value
