"""Comparison as Spark columns, with the dialect's rules.

A comparison's Column may be null where the dialect says false: a filter drops
both, and ``a OR b`` and ``a AND b`` of such columns are right again. Only a
negation has to tell them apart, so it is pushed to the leaf:
``NOT c = 5`` is ``c != 5 OR c IS NULL``, which parquet readers still see.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.ast import Literal
from .values import FLOAT_EXACT, NUMERIC, REAL, WHOLE

INVERSE = {"=": "!=", "!=": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}


@dataclass(frozen=True)
class Operand:
    """A Column with its dialect type; ``literal`` is set if it is a constant."""

    column: Column
    type: str
    nullable: bool = True
    literal: Literal | None = None


def constant(literal: Literal) -> Operand:
    spark = {"INT": "int", "FLOAT": "float", "BOOLEAN": "boolean", "VARCHAR": "string", "NULL": "string"}[literal.type]
    return Operand(F.lit(literal.value).cast(spark), literal.type, literal.type == "NULL", literal)


def _apply(a: Column, op: str, b: Column) -> Column:
    return {"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]


def _aligned(a: Operand, b: Operand) -> tuple[Column, Column] | None:
    """Both sides in the type in which they compare, or None if they never do."""
    if a.type == b.type:
        return a.column, b.column
    if a.type not in NUMERIC or b.type not in NUMERIC:
        return None
    if a.type in WHOLE and b.type in WHOLE:
        return a.column, b.column
    for x, y, swapped in ((a, b, False), (b, a, True)):
        value = y.literal.value if y.literal else None
        if value is None or x.literal:
            continue
        if x.type in WHOLE and value == int(value) and abs(value) < FLOAT_EXACT:
            pair = x.column, F.lit(int(value)).cast("int")  # a cast of the column would hide it from the scan
        elif x.type == "FLOAT":
            pair = x.column, F.lit(float(value)).cast("float")
        elif "DOUBLE" in (x.type, y.type) or x.type == "BIGINT":
            pair = x.column.cast("double"), F.lit(float(value))
        else:
            continue
        return pair[::-1] if swapped else pair
    wide = "DOUBLE" in (a.type, b.type) or "BIGINT" in (a.type, b.type)
    kind = "double" if wide else "float"
    return a.column.cast(kind), b.column.cast(kind)


def like(value: Column, pattern: Operand) -> Column:
    """LIKE without an escape character: Spark's is written twice."""
    if pattern.literal:
        return value.like(pattern.literal.value.replace("\\", "\\\\"))
    return F.call_function("like", value, F.replace(pattern.column, F.lit("\\"), F.lit("\\\\")))


def compare(a: Operand, op: str, b: Operand, negated: bool = False) -> Column:
    """``a op b``, or its two-valued negation."""
    never = F.lit(negated)
    if a.type == "NULL" or b.type == "NULL":
        return never
    if op == "LIKE":
        if a.type != "VARCHAR" or b.type != "VARCHAR":
            return never
        test = like(a.column, b)
        return (~test) | _any_null(a, b) if negated else test
    sides = _aligned(a, b)
    if sides is None:
        return never
    if not negated:
        return _apply(sides[0], op, sides[1])
    inverse = _apply(sides[0], INVERSE[op], sides[1])
    return inverse | _any_null(a, b) if a.nullable or b.nullable else inverse


def _any_null(a: Operand, b: Operand) -> Column:
    nulls = [x.column.isNull() for x in (a, b) if x.nullable and not x.literal]
    out = F.lit(False)
    for n in nulls:
        out = n if out is None else out | n
    return nulls[0] if len(nulls) == 1 else out


def join_condition(a: Operand, b: Operand) -> Column:
    """Join keys: null matches null; whole and real numbers never match.

    Where one side can't be null plain equality is the same, and cheaper.
    """
    same = a.type == b.type or (a.type in WHOLE and b.type in WHOLE) or (a.type in REAL and b.type in REAL)
    if same:
        left, right = (a.column, b.column) if a.type == b.type or a.type in WHOLE else (a.column.cast("double"), b.column.cast("double"))
        return left.eqNullSafe(right) if a.nullable and b.nullable else left == right
    if not (a.nullable and b.nullable):
        return F.lit(False)
    return F.when(a.column.isNull(), 0).otherwise(1) == F.when(b.column.isNull(), 0).otherwise(2)
