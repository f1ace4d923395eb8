"""The aggregates; MEDIAN is put together in ``operators.median``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import TypeFault
from .compare import Operand
from .values import NUMERIC


def mean_type(operand: Operand) -> str:
    """The Spark type of a mean or median: 64-bit for 64-bit columns, else 32-bit."""
    return "double" if operand.type in ("BIGINT", "DOUBLE") else "float"


def need_number(function: str, operand: Operand) -> None:
    if operand.type not in NUMERIC:
        raise TypeFault(f"{function} needs a numeric column, not {operand.type}")


def aggregate(function: str, operand: Operand | None, external: bool) -> Column:
    """One aggregate. Counts are INT and means FLOAT, but 64-bit over registered files and 64-bit columns."""
    if function == "COUNT":
        n = F.count(F.lit(1) if operand is None else operand.column)
        return n if external else n.cast("int")
    if function in ("MIN", "MAX"):
        return F.min(operand.column) if function == "MIN" else F.max(operand.column)
    need_number(function, operand)
    kind = mean_type(operand)
    return F.avg(operand.column.cast(kind)).cast(kind)


def median_value(operand: Operand) -> Column:
    """What a MEDIAN is taken of, as doubles that hold the column's own precision."""
    need_number("MEDIAN", operand)
    return operand.column.cast(mean_type(operand)).cast("double")
