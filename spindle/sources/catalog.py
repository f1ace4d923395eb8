"""Table and index definitions, as JSON."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

from ..errors import NameFault
from ..functions.values import SPARK

FORMAT = 3


def stored(name: str) -> str:
    """A column's name in files and frames, where case does not count: capitals are marked by their places."""
    capitals = sum(1 << k for k, c in enumerate(name) if c.isupper())
    return f"{name}${capitals:x}" if capitals else name


@dataclass
class Column:
    name: str
    type: str
    length: int = 0
    nullable: bool = True
    auto_increment: bool = False
    has_default: bool = False
    default: object = None

    @property
    def shown_type(self) -> str:
        return f"{self.type}({self.length})" if self.type == "VARCHAR" and self.length else self.type


@dataclass
class ForeignKey:
    columns: list[str]
    table: str
    ref_columns: list[str]
    cascade: bool = False


@dataclass
class Table:
    """A definition and its snapshot.

    checks are (column, op, literal) and all must hold. parts are the folders of
    the snapshot's rows. path is set for registered files, whose tables can only
    be read.
    """

    name: str
    columns: list[Column]
    primary_key: list[str] = field(default_factory=list)
    uniques: list[list[str]] = field(default_factory=list)
    checks: list[list] = field(default_factory=list)
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    create_sql: str = ""
    parts: list[str] = field(default_factory=list)
    path: str = ""
    format: str = "parquet"

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise NameFault(f"unknown column '{name}' in table '{self.name}'")

    def has(self, name: str) -> bool:
        return any(c.name == name for c in self.columns)

    @property
    def schema(self) -> T.StructType:
        """Of the rows, under stored names."""
        return T.StructType([T.StructField(stored(c.name), SPARK[c.type]) for c in self.columns])

    @property
    def key(self) -> list[str]:
        """The primary key's stored names."""
        return [stored(c) for c in self.primary_key]

    @property
    def external(self) -> bool:
        return bool(self.path)


@dataclass
class Index:
    name: str
    table: str
    columns: list[str]
    unique: bool = False

    @property
    def implied(self) -> bool:
        """Made by a constraint, not by CREATE INDEX."""
        return self.name.startswith(("__unique_", "__fk_"))


class Catalog:
    """One database's definitions. External tables live in the session and are not saved."""

    def __init__(self):
        self.tables: dict[str, Table] = {}
        self.indexes: dict[str, Index] = {}

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise NameFault(f"table '{name}' does not exist")
        return self.tables[name]

    def indexes_of(self, table: str) -> list[Index]:
        return [i for i in self.indexes.values() if i.table == table]

    def children_of(self, table: str) -> list[tuple[Table, ForeignKey]]:
        """The foreign keys that refer to ``table``."""
        return [(t, fk) for t in self.tables.values() for fk in t.foreign_keys if fk.table == table]

    def dump(self) -> dict:
        own = [asdict(t) for t in self.tables.values() if not t.external]
        return {"format": FORMAT, "tables": own, "indexes": [asdict(i) for i in self.indexes.values()]}

    @classmethod
    def load(cls, data: dict) -> Catalog:
        if data.get("format") != FORMAT:
            raise NameFault(f"catalog format {data.get('format')} is not {FORMAT}")
        out = cls()
        for t in data["tables"]:
            t["columns"] = [Column(**c) for c in t["columns"]]
            t["foreign_keys"] = [ForeignKey(**f) for f in t["foreign_keys"]]
            out.tables[t["name"]] = Table(**t)
        for i in data["indexes"]:
            out.indexes[i["name"]] = Index(**i)
        return out
