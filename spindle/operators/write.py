"""INSERT, UPDATE and DELETE with their constraints, over snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConstraintFault, EngineError, TypeFault
from ..functions.compare import Operand, compare, constant
from ..functions.values import fit, holds, kind_of
from ..plans import ast
from ..plans.predicates import Where
from ..plans.scope import Scope
from ..sources.catalog import ForeignKey, Table, stored
from ..sources.storage import Store, union
from .select import Planner

#: Internal names hold a sign that no column's name has.
PATH = "$path"


def passes(rule: list, value) -> bool:
    """A CHECK rule: null columns pass, a null literal never holds."""
    column, op, literal = rule
    return value is None or holds(value, op, literal)


def all_of(conditions: list[Column]) -> Column:
    return reduce(Column.__and__, conditions)


def same(a: list[Column], b: list[Column]) -> Column:
    return all_of([x == y for x, y in zip(a, b, strict=True)])


class Writer:
    def __init__(self, store: Store, planner: Planner):
        self.store, self.planner = store, planner

    def _own(self, name: str) -> Table:
        table = self.store.catalog.table(name)
        if table.external:
            raise EngineError(f"'{name}' is a registered file and can only be read")
        return table

    def _keys(self, table: Table) -> list[tuple[str, list[str]]]:
        """(name, columns) of every UNIQUE constraint and index."""
        return [(i.name, i.columns) for i in self.store.catalog.indexes_of(table.name) if i.unique]

    # -- INSERT --

    def insert(self, stmt: ast.Insert) -> int:
        table = self._own(stmt.table)
        names = [c.name for c in table.columns] if stmt.columns is None else list(stmt.columns)
        for name in names:
            table.column(name)
        if len(names) != len(stmt.values):
            raise EngineError(f"{len(names)} columns but {len(stmt.values)} values")
        row = {c.name: c.default for c in table.columns}
        for name, literal in zip(names, stmt.values, strict=True):
            row[name] = table.column(name).default if literal is None else literal.value
        for rule in table.checks:
            if not passes(rule, row[rule[0]]):
                raise ConstraintFault(f"CHECK fails: {rule[0]} {rule[1]} {rule[2]}")
        for fk in table.foreign_keys:
            self._need_parent(fk, [row[c] for c in fk.columns])
        self._number(table, row)
        key = [row[c] for c in table.primary_key]
        if None in key:
            raise ConstraintFault("a primary key column cannot be NULL")
        stored = tuple(fit(row[c.name], c) for c in table.columns)
        at = {c.name: i for i, c in enumerate(table.columns)}
        if self._holds_row(table, table.primary_key, [stored[at[c]] for c in table.primary_key]):
            raise ConstraintFault(f"primary key {tuple(key)} already exists")
        for name, columns in self._keys(table):
            values = [stored[at[c]] for c in columns]
            if None not in values and self._holds_row(table, columns, values):
                raise ConstraintFault(f"{name}: {tuple(values)} already exists")
        self.store.append(table, stored)
        if table.name in self.store.largest:
            self.store.largest[table.name] = max(self.store.largest[table.name], stored[at[table.primary_key[0]]])
        return 1

    def _number(self, table: Table, row: dict) -> None:
        """AUTO_INCREMENT: one more than the largest key there is now."""
        first = table.column(table.primary_key[0])
        if len(table.primary_key) > 1 or not first.auto_increment or row[first.name] is not None:
            return
        if table.name not in self.store.largest:
            top = self.store.frame(table).agg(F.max(*table.key)).head()[0]
            self.store.largest[table.name] = 0 if top is None else top
        row[first.name] = self.store.largest[table.name] + 1

    def _holds_row(self, table: Table, columns: list[str], values: list) -> bool:
        """Whether a row has these values: the log first, then the parts (their statistics prune the files)."""
        at = [[c.name for c in table.columns].index(c) for c in columns]
        if any([r[i] for i in at] == values for r in self.store.rows.get(table.name, ())):
            return True
        parts = self.store.parts(table)
        if parts is None:
            return False
        test = all_of([F.col(c) == F.lit(v).cast(table.schema[c].dataType) for c, v in zip(map(stored, columns), values, strict=True)])
        return not parts.filter(test).select(F.lit(1)).isEmpty()

    def _need_parent(self, fk: ForeignKey, values: list) -> None:
        parent = self.store.catalog.table(fk.table)
        if None in values:
            return
        try:
            wanted = [fit(v, parent.column(c)) for v, c in zip(values, fk.ref_columns, strict=True)]
        except TypeFault:
            wanted = None
        if wanted is None or not self._holds_row(parent, fk.ref_columns, wanted):
            raise ConstraintFault(f"FOREIGN KEY: '{fk.table}' has no {tuple(values)}")

    def insert_frame(self, name: str, rows: DataFrame) -> int:
        """Append many rows, all or none. Columns go by name; missing ones take their defaults, AUTO_INCREMENT keys the next numbers."""
        table = self._own(name)
        for c in rows.columns:
            table.column(c)
        given = rows.toDF(*map(stored, rows.columns))
        filled = given.select(*((F.col(f.name) if f.name in given.columns else F.lit(c.default)).cast(f.dataType).alias(f.name) for c, f in zip(table.columns, table.schema, strict=True)))
        # What is checked is what was written: the caller's frame may give other rows when it runs again.
        made = [self.store.write_part(table, filled)]
        try:
            first = table.column(table.primary_key[0])
            if len(table.primary_key) == 1 and first.auto_increment:
                made.append(self._number_part(table, made[0]))
            n = self._check_part(table, self.store.parts(table, made[-1:]))
        except (EngineError, PySparkException):
            for part in made:
                self.store.discard(table, part)
            raise
        for part in made[:-1]:
            self.store.discard(table, part)
        self.store.adopt({name: (made[-1:], [])}, keep_rows=True)
        self.store.largest.pop(name, None)
        return n

    def _number_part(self, table: Table, part: str) -> str:
        """The part again, rows without a key numbered on from the largest key there is, in the order they lie in."""
        key = table.key[0]
        rows = self.store.parts(table, [part])
        top = self.store.frame(table).select(key).unionByName(rows.select(key)).agg(F.max(key)).head()[0] or 0
        blank = rows.filter(F.col(key).isNull()).withColumn("$at", F.monotonically_increasing_id())
        place, at = F.shiftright("$at", 33), F.col("$at").bitwiseAND(F.lit((1 << 33) - 1))
        # One count for each partition of the scan.
        counts = sorted((r[0], r[1]) for r in blank.groupBy(place.alias("$place")).agg(F.max(at).alias("_last")).collect())
        starts, next_ = [], top + 1
        for number, last in counts:
            starts.append((number, next_))
            next_ += last + 1
        first = F.broadcast(self.store.spark.createDataFrame(starts, "`$place` long, `$first` long"))
        numbered = blank.withColumn("$place", place).join(first, "$place").withColumn(key, (F.col("$first") + at).cast(table.schema[key].dataType))
        return self.store.write_part(table, rows.filter(F.col(key).isNotNull()).unionByName(numbered.select(*rows.columns)))

    def _check_part(self, table: Table, filled: DataFrame) -> int:
        """The number of new rows, all constraints held."""
        self._check_rows(table, filled)
        old = self.store.frame(table)
        for label, columns in [("primary key", table.primary_key), *self._keys(table)]:
            columns = [stored(c) for c in columns]
            keys = filled.select(*columns).dropna()
            if not keys.groupBy(*columns).agg(F.count(F.lit(1)).alias("$n")).filter(F.col("$n") > 1).isEmpty():
                raise ConstraintFault(f"{label}: the new rows repeat a key")
            if not keys.join(old.select(*columns), columns, "left_semi").isEmpty():
                raise ConstraintFault(f"{label}: a key already exists")
        for fk in table.foreign_keys:
            self._check_parents(fk, filled)
        return filled.count()

    def _check_rows(self, table: Table, rows: DataFrame) -> None:
        wrong = F.lit(False)
        for c in table.columns:
            if not c.nullable:
                wrong = wrong | F.col(stored(c.name)).isNull()
            if c.type == "VARCHAR":
                wrong = wrong | F.coalesce(F.octet_length(stored(c.name)) > c.length, F.lit(False))
        if not rows.filter(wrong).isEmpty():
            raise TypeFault(f"a row does not fit the columns of '{table.name}'")
        for column, op, value in table.checks:
            spec = table.column(column)
            literal = ast.Literal(value, "NULL" if value is None else kind_of(value))
            holds_ = compare(Operand(F.col(stored(column)), spec.type), op, constant(literal))
            if not rows.filter(F.col(stored(column)).isNotNull() & ~F.coalesce(holds_, F.lit(False))).isEmpty():
                raise ConstraintFault(f"CHECK fails: {column} {op} {value}")

    def _check_parents(self, fk: ForeignKey, rows: DataFrame) -> None:
        """Every foreign key without null has its parent row."""
        parent = self.store.frame(self.store.catalog.table(fk.table)).select(*(F.col(stored(c)).alias(f"$p{k}") for k, c in enumerate(fk.ref_columns)))
        keys = rows.select(*(F.col(stored(c)).alias(f"$k{k}") for k, c in enumerate(fk.columns))).dropna()
        match = all_of([F.col(f"$k{k}") == F.col(f"$p{k}") for k in range(len(fk.columns))])
        if not keys.join(parent, match, "left_anti").isEmpty():
            raise ConstraintFault(f"FOREIGN KEY: a row of '{fk.table}' is missing")

    # -- which rows, and in which parts --

    def _tagged(self, table: Table) -> DataFrame:
        """All rows with the part that each lies in (null for the log)."""
        logged = self.store.rows.get(table.name, [])
        parts = self.store.parts(table)
        frames = []
        if parts is not None:
            frames.append(parts.select("*", F.element_at(F.split("_metadata.file_path", "/"), -2).alias(PATH)))
        if logged or parts is None:
            frames.append(self.store.local(table, logged).withColumn(PATH, F.lit(None).cast("string")))
        return union(frames)

    def _where(self, table: Table, where) -> tuple[DataFrame, Column]:
        """The tagged rows under prefixed names, and the condition on them."""
        instance = self.planner.prefixes.instance(table, ast.TableRef(table.name))
        rows = self._tagged(table)
        rows = rows.toDF(*instance.ids([c.name for c in table.columns]), PATH)
        test = F.lit(True) if where is None else Where(Scope([instance]), self.planner.subquery).build(where)
        return rows, test

    def _plain(self, table: Table, rows: DataFrame) -> DataFrame:
        return rows.select(*rows.columns[: len(table.columns)]).toDF(*table.schema.names)

    @staticmethod
    def _parts_of(rows: DataFrame) -> tuple[list[str], int]:
        """The parts that hold the rows (no more than the table has) and the number of rows, in one pass."""
        found = rows.groupBy(PATH).agg(F.count(F.lit(1))).collect()
        return [r[0] for r in found if r[0] is not None], sum(r[1] for r in found)

    # -- UPDATE --

    def update(self, stmt: ast.Update) -> int:
        table = self._own(stmt.table)
        new = {}
        for name, literal in stmt.assignments:
            new[name] = table.column(name).default if literal is None else literal.value
        rows, test = self._where(table, stmt.where)
        hit = rows.filter(test)
        parts, n = self._parts_of(hit)
        if not n:
            return 0
        for rule in table.checks:
            if rule[0] in new and not passes(rule, new[rule[0]]):
                raise ConstraintFault(f"CHECK fails: {rule[0]} {rule[1]} {rule[2]}")
        for name in table.primary_key:
            if name in new and new[name] is None:
                raise ConstraintFault("a primary key column cannot be NULL")
        values = {name: fit(v, table.column(name)) for name, v in new.items()}
        old = self._plain(table, hit)
        lits = {name: F.lit(v).cast(table.schema[stored(name)].dataType) for name, v in values.items()}
        changed = old.select(*(lits.get(c.name, F.col(stored(c.name))).alias(stored(c.name)) for c in table.columns))
        for fk in table.foreign_keys:
            if set(fk.columns) & set(new):
                self._check_parents(fk, changed)
        self._check_children(table, old, lits)
        self._check_keys(table, old, lits)
        rest = self._plain(table, rows.filter(~F.coalesce(test, F.lit(False)) & (F.col(PATH).isNull() | F.col(PATH).isin(parts))))
        self.store.replace({table.name: (union([rest, changed]), parts)})
        self.store.largest.pop(table.name, None)
        return n

    def _check_children(self, table: Table, old: DataFrame, new: dict[str, Column]) -> None:
        """A referenced value that changes must have no children."""
        for child, fk in self.store.catalog.children_of(table.name):
            touched = [c for c in fk.ref_columns if c in new]
            if not touched:
                continue
            moved = old.filter(~all_of([F.col(stored(c)).eqNullSafe(new[c]) for c in touched]))
            if not self._referring(child, fk, moved).isEmpty():
                raise ConstraintFault(f"rows of '{child.name}' refer to a key that would change")

    def _referring(self, child: Table, fk: ForeignKey, parents: DataFrame) -> DataFrame:
        """The rows of ``child`` whose foreign key is one of ``parents``' keys."""
        keys = parents.select(*(F.col(stored(c)).alias(f"$p{k}") for k, c in enumerate(fk.ref_columns)))
        match = all_of([F.col(stored(c)) == F.col(f"$p{k}") for k, c in enumerate(fk.columns)])
        return self.store.frame(child).join(keys, match, "left_semi")

    def _check_keys(self, table: Table, old: DataFrame, new: dict[str, Column]) -> None:
        """New keys must not meet one another, nor any row's present key but their own row's."""
        for label, columns in [("primary key", table.primary_key), *self._keys(table)]:
            if not set(columns) & set(new):
                continue
            mine = old.select(
                *(F.col(c).alias(f"$o{k}") for k, c in enumerate(table.key)),
                *(new.get(c, F.col(stored(c))).alias(f"$n{k}") for k, c in enumerate(columns)),
            )
            news = [f"$n{k}" for k in range(len(columns))]
            mine = mine.dropna(subset=news)
            if not mine.groupBy(*news).agg(F.count(F.lit(1)).alias("$n")).filter(F.col("$n") > 1).isEmpty():
                raise ConstraintFault(f"{label}: two rows of this UPDATE would share a key")
            there = self.store.frame(table).select(*(F.col(c).alias(f"$t{k}") for k, c in enumerate(table.key)), *(F.col(stored(c)).alias(f"$k{k}") for k, c in enumerate(columns)))
            itself = all_of([F.col(f"$o{k}") == F.col(f"$t{k}") for k in range(len(table.primary_key))])
            meets = all_of([F.col(f"$n{k}") == F.col(f"$k{k}") for k in range(len(columns))])
            if not mine.join(there, meets & ~itself, "left_semi").isEmpty():
                raise ConstraintFault(f"{label}: a key of this UPDATE already exists")

    # -- DELETE --

    def delete(self, stmt: ast.Delete) -> int:
        table = self._own(stmt.table)
        rows, test = self._where(table, stmt.where)
        own, n = self._parts_of(rows.filter(test))
        if not n:
            return 0
        tagged = {table.name: rows.filter(test).toDF(*table.schema.names, PATH)}
        first = tagged[table.name]
        # Parents are older than their children, so one pass in order of creation closes the set.
        for name in list(self.store.catalog.tables):
            if name not in tagged:
                continue
            for child, fk in self.store.catalog.children_of(name):
                if fk.cascade:
                    found = self._tagged(child).join(self._keys_of(fk, tagged[name]), self._match(fk), "left_semi")
                    tagged[child.name] = tagged[child.name].unionByName(found).dropDuplicates(child.key) if child.name in tagged else found
        for name, gone in tagged.items():
            for child, fk in self.store.catalog.children_of(name):
                if not fk.cascade:
                    left = self._without(child, self.store.frame(child), tagged.get(child.name))
                    if not left.join(self._keys_of(fk, gone), self._match(fk), "left_semi").isEmpty():
                        raise ConstraintFault(f"rows of '{child.name}' refer to what would be deleted")
        changes = {}
        for name, gone in tagged.items():
            t = self.store.catalog.table(name)
            # A cascade may have added rows of the table that the statement names.
            parts = own if gone is first else self._parts_of(gone)[0]
            affected = self._tagged(t).filter(F.col(PATH).isNull() | F.col(PATH).isin(parts)).drop(PATH)
            changes[name] = (self._without(t, affected, gone), parts)
            self.store.largest.pop(name, None)
        self.store.replace(changes)
        return n

    @staticmethod
    def _keys_of(fk: ForeignKey, parents: DataFrame) -> DataFrame:
        return parents.select(*(F.col(stored(c)).alias(f"$p{k}") for k, c in enumerate(fk.ref_columns)))

    @staticmethod
    def _match(fk: ForeignKey) -> Column:
        return all_of([F.col(stored(c)) == F.col(f"$p{k}") for k, c in enumerate(fk.columns)])

    @staticmethod
    def _without(table: Table, rows: DataFrame, gone: DataFrame | None) -> DataFrame:
        if gone is None:
            return rows
        keys = gone.select(*(F.col(c).alias(f"$g{k}") for k, c in enumerate(table.key)))
        return rows.join(keys, all_of([F.col(c) == F.col(f"$g{k}") for k, c in enumerate(table.key)]), "left_anti")
