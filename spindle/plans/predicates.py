"""Conditions to Columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import TypeFault
from ..functions.compare import Operand, compare, constant
from . import ast
from .scope import Scope


#: Comparisons that some value on the left fulfils if the least does, or if the largest does.
LEAST, LARGEST = {"<", "<="}, {">", ">="}


def condition(node, leaf: Callable) -> Column:
    """leaf(node, negated) makes the Column of one comparison; NOT is passed down to it."""
    if isinstance(node, ast.And):
        return reduce(Column.__and__, (condition(x, leaf) for x in node.operands))
    if isinstance(node, ast.Or):
        return reduce(Column.__or__, (condition(x, leaf) for x in node.operands))
    if isinstance(node, ast.Not):
        return leaf(node.operand, True)
    return leaf(node, False)


class Where:
    """Builds WHERE conditions; ``subquery`` makes the rows of an inner SELECT."""

    def __init__(self, scope: Scope, subquery: Callable):
        self.scope, self.subquery = scope, subquery

    def build(self, node) -> Column:
        return condition(node, self.leaf)

    def operand(self, value) -> Operand:
        return constant(value) if isinstance(value, ast.Literal) else self.scope.find(value).operand

    def leaf(self, node, negated: bool) -> Column:
        if isinstance(node, ast.Compare):
            return compare(self.operand(node.left), node.op, self.operand(node.right), negated)
        if isinstance(node, ast.IsNull):
            column = self.scope.find(node.column).operand.column
            return column.isNotNull() if node.negated != negated else column.isNull()
        if isinstance(node, ast.Exists):
            if node.query.limit == 0:
                return F.lit(negated)
            found = self.extreme(node.query)
            if found is None:
                rows, _ = self.subquery(node.query, self.scope, keep_limit=False)
                found = rows.exists()
            return ~found if negated else found
        return self.membership(node, negated)

    def extreme(self, query: ast.Select) -> Column | None:
        """EXISTS whose one tie to the outer row is an inequality, by the inner column's least or largest value.

        A semi join without a key would hold every row against every other; one
        value decides as well, since casts to the type of a comparison keep order.
        """
        parts = list(query.where.operands) if isinstance(query.where, ast.And) else [query.where]
        inner = self.subquery(replace(query, where=None), self.scope, keep_limit=False)[1]
        ties = [p for p in parts if p is not None and not self.local(p, inner)]
        if len(ties) != 1 or not isinstance(tie := ties[0], ast.Compare) or tie.op not in LEAST | LARGEST | {"!="}:
            return None
        sides = [None if isinstance(x, ast.Literal) else inner.find(x) for x in (tie.left, tie.right)]
        if None in sides or sides[0].outer == sides[1].outer:
            return None
        rest = [p for p in parts if p is not tie]
        rows, inner = self.subquery(replace(query, where=ast.And(tuple(rest)) if rest else None), self.scope, keep_limit=False)

        def decided(value: Callable) -> Column:
            both = []
            for ref in (tie.left, tie.right):
                me = inner.find(ref)
                both.append(self.scope.find(ref).operand if me.outer else Operand(rows.agg(value(me.operand.column)).scalar(), me.column.type))
            return F.coalesce(compare(both[0], tie.op, both[1]), F.lit(False))

        if tie.op == "!=":
            return decided(F.min) | decided(F.max)
        return decided(F.min if (tie.op in LEAST) != sides[0].outer else F.max)

    @staticmethod
    def local(node, inner: Scope) -> bool:
        """Whether a condition has inner columns alone; of a nested query that is not known."""
        if isinstance(node, ast.And | ast.Or):
            return all(Where.local(x, inner) for x in node.operands)
        if isinstance(node, ast.Not):
            return Where.local(node.operand, inner)
        if isinstance(node, ast.IsNull):
            return not inner.find(node.column).outer
        if isinstance(node, ast.Compare):
            return all(isinstance(x, ast.Literal) or not inner.find(x).outer for x in (node.left, node.right))
        return False

    def membership(self, node: ast.InQuery, negated: bool) -> Column:
        """IN as EXISTS of an equal row, so that it is a semi join on the key.

        NOT IN also needs a left side that is not null and a list without null.
        """
        me = self.scope.find(node.column).operand
        rows, inner = self.subquery(node.query, self.scope, keep_limit=True)
        items = node.query.items
        if items is None or len(items) != 1 or not isinstance(items[0], ast.ColumnRef):
            raise TypeFault("a subquery of IN selects exactly one column")
        value = inner.find(items[0]).operand
        here = Operand(me.column.outer(), me.type, me.nullable)
        equal = rows.filter(compare(value, "=", here)).exists()
        if not node.negated:
            return ~equal if negated else equal
        has_null = rows.filter(value.column.isNull()).exists() if value.nullable else F.lit(False)
        if negated:
            return me.column.isNull() | has_null | equal
        return me.column.isNotNull() & ~has_null & ~equal
