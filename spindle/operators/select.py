"""SELECT to DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError, NameFault
from ..functions.aggregates import aggregate, mean_type, median_value
from ..functions.compare import Operand, compare, constant, join_condition
from ..functions.values import display
from ..plans import ast
from ..plans.parser import INT_MAX
from ..plans.predicates import Where, condition
from ..plans.scope import Prefixes, Scope
from ..sources.catalog import Table
from .median import matched, medians


@dataclass
class Query:
    """frame has the rows, in order only if the statement orders them; shown is in the
    dialect's implicit order too (by primary key, groups by their keys)."""

    frame: DataFrame
    shown: DataFrame


@dataclass
class Source:
    """FROM and WHERE: rows, scope, and the ids that give the implicit order."""

    rows: DataFrame
    scope: Scope
    order: list[str]

    @property
    def external(self) -> bool:
        return any(i.table.external for i in self.scope.instances)


class Planner:
    """tables: name -> definition; frame: definition -> its rows."""

    def __init__(self, tables: Callable[[str], Table], frame: Callable[[Table], DataFrame]):
        self.tables, self.frame, self.prefixes = tables, frame, Prefixes()

    # -- FROM and WHERE --

    def scan(self, ref: ast.TableRef):
        instance = self.prefixes.instance(self.tables(ref.name), ref)
        return instance, instance.renamed(self.frame(instance.table))

    def source(self, query: ast.Select, outer: Scope | None = None) -> Source:
        first, rows = self.scan(query.table)
        instances, optional = [first], set()
        order = first.ids(first.table.primary_key)
        for join in query.joins:
            right, right_rows = self.scan(join.table)
            a = self._side(join.left, Scope(instances, optional=optional), join)
            b = self._side(join.right, Scope([right]), join)
            rows = rows.join(right_rows, join_condition(a, b), join.kind)
            if join.kind == "left":
                optional.add(right.prefix)
            if join.kind == "right":
                optional |= {i.prefix for i in instances}
            keys = right.ids(right.table.primary_key)
            order = keys + order if join.kind == "right" else order + keys
            instances.append(right)
        scope = Scope(instances, outer, optional)
        if query.where is not None:
            rows = rows.filter(Where(scope, self.subquery).build(query.where))
        return Source(rows, scope, order)

    @staticmethod
    def _side(ref: ast.ColumnRef, scope: Scope, join: ast.Join) -> Operand:
        try:
            return scope.find(ref).operand
        except NameFault as e:
            raise NameFault(f"ON compares a column of the tables before with one of '{join.table.name}': {e}") from None

    def subquery(self, query: ast.Select, outer: Scope, keep_limit: bool) -> tuple[DataFrame, Scope]:
        """Rows of an inner SELECT before its select list. Its ORDER BY, GROUP BY and HAVING have no effect."""
        if query.joins:
            raise EngineError("a subquery has one table")
        source = self.source(query, outer)
        rows = source.rows
        if keep_limit and query.limit is not None:
            rows = self._ordered(rows, source.order).limit(min(query.limit, INT_MAX))
        return rows, source.scope

    @staticmethod
    def _ordered(rows: DataFrame, ids: list[str]) -> DataFrame:
        return rows.orderBy(*(F.col(i).asc_nulls_last() for i in ids)) if ids else rows

    # -- the rest --

    def plan(self, query: ast.Select) -> Query:
        if query.having is not None and not query.group_by:
            raise EngineError("HAVING needs GROUP BY")
        if query.group_by:
            return self._grouped(query)
        aggregates = [isinstance(i, ast.Aggregate) for i in query.items or ()]
        if any(aggregates):
            if not all(aggregates):
                raise EngineError("aggregates and other items need GROUP BY")
            return self._global(query)
        return self._plain(query)

    def _plain(self, query: ast.Select) -> Query:
        if any(isinstance(k.key, ast.Aggregate) for k in query.order_by):
            raise EngineError("ORDER BY an aggregate needs GROUP BY")
        source = self.source(query)
        if query.items is None:
            picks = [(F.col(i.id(c.name)), c.name) for i in source.scope.instances for c in i.table.columns]
        else:
            picks = [self._pick(item, source.scope) for item in query.items]
        keys = [self._sort(F.col(source.scope.find(k.key).id), k) for k in query.order_by]
        ties = [F.col(i).asc_nulls_last() for i in source.order]
        rows, shown = source.rows, source.rows
        if keys or (query.limit is not None and ties):
            rows = shown = rows.orderBy(*keys, *ties)
        elif ties:
            shown = rows.orderBy(*ties)
        if query.limit is not None:
            rows, shown = rows.limit(min(query.limit, INT_MAX)), shown.limit(min(query.limit, INT_MAX))
        return Query(_project(rows, picks), _project(shown, picks))

    @staticmethod
    def _pick(item, scope: Scope) -> tuple[Column, str]:
        if isinstance(item, ast.Literal):
            return constant(item).column, display(item.value)
        return F.col(scope.find(item, left_wins=True).id), item.name

    @staticmethod
    def _sort(column: Column, key: ast.OrderKey) -> Column:
        return column.desc_nulls_last() if key.descending else column.asc_nulls_last()

    def _operand(self, node: ast.Aggregate, source: Source) -> Operand | None:
        return None if node.argument is None else source.scope.find(node.argument).operand

    def _aggregated(self, source: Source, ids: list[str], nodes: dict[object, str]) -> DataFrame:
        """Groups by ``ids`` with each aggregate or ungrouped column under its name; medians are joined to the rest."""
        columns, middles = [], []
        for node, name in nodes.items():
            if isinstance(node, ast.ColumnRef):
                columns.append(self._first(node, source).alias(name))
            elif node.function == "MEDIAN":
                middles.append((self._operand(node, source), name))
            else:
                columns.append(aggregate(node.function, self._operand(node, source), source.external).alias(name))
        values = [(median_value(operand), mean_type(operand), name) for operand, name in middles]
        rows = source.rows
        if not ids and middles:
            ids, rows = ["_one"], rows.withColumn("_one", F.lit(1))
        if ids == ["_one"]:  # one row even if there is nothing to aggregate
            out = rows.agg(F.lit(1).alias("_one"), *columns, F.count(F.lit(1)).alias("_rows"))
        elif ids:
            out = rows.groupBy(*ids).agg(*columns) if columns else rows.select(*ids).distinct()
        else:
            out = rows.agg(*columns)
        for value, kind, name in values:
            out = matched(out, medians(rows, ids, value, name), ids, "_m", "left").withColumn(name, F.col(name).cast(kind))
        return out

    def _global(self, query: ast.Select) -> Query:
        """One row; ORDER BY and LIMIT have no effect on it."""
        source = self.source(query)
        nodes = {item: f"a{k}" for k, item in enumerate(dict.fromkeys(query.items))}
        out = _project(self._aggregated(source, [], nodes), [(F.col(nodes[item]), item.header) for item in query.items])
        return Query(out, out)

    def _grouped(self, query: ast.Select) -> Query:
        if query.items is None:
            raise EngineError("SELECT * can't be grouped")
        if len(query.order_by) > 1:
            raise EngineError("a grouped query orders by one key")
        source = self.source(query)
        groups = {ref.name: source.scope.find(ref).id for ref in reversed(query.group_by)}
        nodes: dict[object, str] = {}

        def named(node) -> str:
            """The output name of an aggregate or column after grouping."""
            if isinstance(node, ast.ColumnRef) and node.name in groups:
                return groups[node.name]
            return nodes.setdefault(node, f"a{len(nodes)}")

        picks = []
        for item in query.items:
            if isinstance(item, ast.ColumnRef) and item.name not in groups:
                raise EngineError(f"column '{item}' is not in GROUP BY")
            if isinstance(item, ast.Literal):
                picks.append((constant(item).column, display(item.value)))
            else:
                picks.append((F.col(named(item)), item.header if isinstance(item, ast.Aggregate) else item.name))
        types: dict[str, str] = {}

        def having(node: ast.Compare, negated: bool) -> Column:
            name = named(node.left)
            types[name] = self._type(node.left, source)
            return compare(Operand(F.col(name), types[name]), node.op, constant(node.right), negated)

        kept = None if query.having is None else condition(query.having, having)
        keys = []
        for k in query.order_by:
            if isinstance(k.key, ast.ColumnRef) and k.key.name not in groups:
                raise EngineError(f"ORDER BY column '{k.key}' is not in GROUP BY")
            keys.append(self._sort(F.col(named(k.key)), k))
        ids = list(dict.fromkeys(source.scope.find(ref).id for ref in query.group_by))
        rows = self._aggregated(source, ids, nodes)
        if kept is not None:
            rows = rows.filter(kept)
        ties = [F.col(i).asc_nulls_first() for i in ids]
        shown = rows.orderBy(*keys, *ties)
        if keys or query.limit is not None:
            rows = shown
        if query.limit is not None:
            rows = shown = shown.limit(min(query.limit, INT_MAX))
        return Query(_project(rows, picks), _project(shown, picks))

    @staticmethod
    def _type(node, source: Source) -> str:
        if isinstance(node, ast.ColumnRef):
            return source.scope.find(node).operand.type
        if node.function == "COUNT":
            return "BIGINT" if source.external else "INT"
        inner = source.scope.find(node.argument).operand.type
        if node.function in ("MIN", "MAX"):
            return inner
        return "DOUBLE" if inner in ("BIGINT", "DOUBLE") else "FLOAT"

    @staticmethod
    def _first(ref: ast.ColumnRef, source: Source) -> Column:
        """HAVING on a column that is not grouped takes its value in the group's first row."""
        column = source.scope.find(ref)
        if len(source.scope.instances) > 1 or not source.order:
            raise EngineError(f"HAVING column '{ref}' is not in GROUP BY")
        return F.min_by(F.col(column.id), F.struct(*source.order))


def _project(rows: DataFrame, picks: list[tuple[Column, str]]) -> DataFrame:
    """Headers may repeat, so they are given last."""
    return rows.select(*(c.alias(f"c{k}") for k, (c, _) in enumerate(picks))).toDF(*(h for _, h in picks))
