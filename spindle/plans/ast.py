"""Statements as data."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Literal:
    """type: INT, FLOAT, BOOLEAN, VARCHAR or NULL."""

    value: object
    type: str


@dataclass(frozen=True)
class ColumnRef:
    name: str
    qualifier: str | None = None

    def __str__(self) -> str:
        return f"{self.qualifier}.{self.name}" if self.qualifier else self.name


@dataclass(frozen=True)
class Aggregate:
    """argument is None in COUNT(*)."""

    function: str
    argument: ColumnRef | None = None

    @property
    def header(self) -> str:
        return f"{self.function}({self.argument.name if self.argument else '*'})"


@dataclass(frozen=True)
class Compare:
    left: ColumnRef | Aggregate
    op: str
    right: Literal | ColumnRef


@dataclass(frozen=True)
class IsNull:
    column: ColumnRef
    negated: bool = False


@dataclass(frozen=True)
class InQuery:
    column: ColumnRef
    query: Select
    negated: bool = False


@dataclass(frozen=True)
class Exists:
    query: Select


@dataclass(frozen=True)
class Not:
    operand: object


@dataclass(frozen=True)
class And:
    operands: tuple


@dataclass(frozen=True)
class Or:
    operands: tuple


@dataclass(frozen=True)
class TableRef:
    name: str
    alias: str | None = None


@dataclass(frozen=True)
class Join:
    """kind: inner, left or right."""

    kind: str
    table: TableRef
    left: ColumnRef
    right: ColumnRef


@dataclass(frozen=True)
class OrderKey:
    key: ColumnRef | Aggregate
    descending: bool = False


@dataclass(frozen=True)
class Select:
    """items is None in SELECT *."""

    items: tuple | None
    table: TableRef
    joins: tuple = ()
    where: object = None
    group_by: tuple = ()
    having: object = None
    order_by: tuple = ()
    limit: int | None = None


@dataclass(frozen=True)
class Insert:
    """values hold Literals and, for DEFAULT, None."""

    table: str
    columns: tuple | None
    values: tuple


@dataclass(frozen=True)
class Update:
    table: str
    assignments: tuple
    where: object = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: object = None


@dataclass
class ColumnSpec:
    name: str
    type: str
    length: int = 0
    primary_key: bool = False
    not_null: bool = False
    unique: bool = False
    auto_increment: bool = False
    default: Literal | None = None
    checks: list = field(default_factory=list)
    references: tuple[str, str] | None = None


@dataclass
class ForeignKeySpec:
    columns: tuple[str, ...]
    table: str
    ref_columns: tuple[str, ...]
    cascade: bool = False


@dataclass
class CreateTable:
    name: str
    columns: list[ColumnSpec] = field(default_factory=list)
    primary_key: tuple[str, ...] | None = None
    uniques: list[tuple[str, ...]] = field(default_factory=list)
    checks: list = field(default_factory=list)
    foreign_keys: list[ForeignKeySpec] = field(default_factory=list)


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    columns: tuple[str, ...]
    unique: bool = False


@dataclass(frozen=True)
class Drop:
    """kind: TABLE, INDEX or DATABASE."""

    kind: str
    name: str


@dataclass(frozen=True)
class CreateDatabase:
    name: str


@dataclass(frozen=True)
class Use:
    name: str


@dataclass(frozen=True)
class Show:
    """kind: TABLES or DATABASES."""

    kind: str


@dataclass(frozen=True)
class Describe:
    table: str
