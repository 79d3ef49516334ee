"""Holdout predicates: boolean expressions over key columns, compiled to Columns that Catalyst can push down.

The language is a small part of Python's expression syntax: and, or, not, parentheses; ==, !=, <, <=, >,
>=, in, not in, chained; numbers (signed), strings, True, False, None, tuples, lists and sets as literals.
Everything else is refused when the predicate is made, and nothing is ever evaluated as Python.

Logic has two values. An ordering against null is False (so ``not (x >= 1)`` holds for null), equality is
null-safe, and a comparison of a number with a string is False where it is equality, an error where it
is an ordering, whatever Spark would coerce.
"""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of a measurement's key, in their order.
KEY_FIELDS = ("angle", "dpi", "jpeg", "sigma", "seed", "parasite", "identity", "source", "jitter", "capture", "mark_step")
_STRINGS = {"identity", "source", "capture"}
_ORDER = {ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}


class PredicateError(ValueError):
    """An expression outside the language."""


def _kind_of_value(value) -> str:
    return "null" if value is None else "string" if isinstance(value, str) else "number"


class Predicate:
    """A compiled expression: ``column()`` for DataFrames, ``fields`` for the columns it reads."""

    def __init__(self, text: str, kinds: dict[str, str] | None = None) -> None:
        self.text = text
        self.kinds = kinds or {f: "string" if f in _STRINGS else "number" for f in KEY_FIELDS}
        self.fields: set[str] = set()
        try:
            tree = ast.parse(text.strip(), mode="eval")
        except (SyntaxError, ValueError) as bad:
            raise PredicateError(f"not an expression: {text!r}") from bad
        self._column = self._compile(tree.body)

    @classmethod
    def over(cls, df: DataFrame, text: str) -> Predicate:
        """For any table: its scalar columns are the fields."""
        return cls(text, {f.name: "string" if isinstance(f.dataType, T.StringType) else "number" for f in df.schema if isinstance(f.dataType, (T.StringType, T.NumericType, T.BooleanType))})

    def column(self) -> Column:
        return self._column

    def __repr__(self) -> str:
        return f"Predicate({self.text!r})"

    def _compile(self, node: ast.expr) -> Column:
        match node:
            case ast.BoolOp(op=op, values=values):
                parts = [self._compile(v) for v in values]
                out = parts[0]
                for p in parts[1:]:
                    out = out & p if isinstance(op, ast.And) else out | p
                return out
            case ast.UnaryOp(op=ast.Not(), operand=inner):
                return ~self._compile(inner)
            case ast.Constant(value=bool() as value):
                return F.lit(value)
            case ast.Compare(left=left, ops=ops, comparators=rights):
                out = None
                for op, right in zip(ops, rights):
                    link = self._link(left, op, right)
                    out = link if out is None else out & link
                    left = right
                return out
        raise PredicateError(f"not allowed here: {ast.unparse(node)!r} in {self.text!r}")

    def _link(self, left: ast.expr, op: ast.cmpop, right: ast.expr) -> Column:
        a = self._operand(left)
        if isinstance(op, (ast.In, ast.NotIn)):
            found = F.lit(False)
            for value in self._members(right):
                found = found | self._equal(a, (F.lit(value), _kind_of_value(value)))
            return ~found if isinstance(op, ast.NotIn) else found
        b = self._operand(right)
        if isinstance(op, ast.Eq):
            return self._equal(a, b)
        if isinstance(op, ast.NotEq):
            return ~self._equal(a, b)
        if type(op) not in _ORDER:
            raise PredicateError(f"no such comparison in {self.text!r}")
        if "null" in (a[1], b[1]):
            return F.lit(False)
        if a[1] != b[1]:
            raise PredicateError(f"a number and a string have no order in {self.text!r}")
        compare: Callable[[Column, Column], Column] = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}[_ORDER[type(op)]]
        return F.coalesce(compare(a[0], b[0]), F.lit(False))

    @staticmethod
    def _equal(a: tuple[Column, str], b: tuple[Column, str]) -> Column:
        if "null" in (a[1], b[1]):
            return a[0].isNull() & b[0].isNull()
        return F.lit(False) if a[1] != b[1] else a[0].eqNullSafe(b[0])

    def _operand(self, node: ast.expr) -> tuple[Column, str]:
        if isinstance(node, ast.Name):
            if node.id not in self.kinds:
                raise PredicateError(f"no such field: {node.id!r}")
            self.fields.add(node.id)
            value, kind = F.col(node.id), self.kinds[node.id]
            return (value.cast("double") if kind == "number" else value), kind
        value = self._literal(node)
        if isinstance(value, (tuple, list, set)):
            raise PredicateError(f"a collection only follows in: {self.text!r}")
        kind = _kind_of_value(value)
        return F.lit(float(value)) if kind == "number" else F.lit(value), kind

    def _literal(self, node: ast.expr):
        match node:
            case ast.Constant(value=bool() | int() | float() | str() | None as value):
                return value
            case ast.UnaryOp(op=ast.USub(), operand=ast.Constant(value=int() | float() as value)) if not isinstance(value, bool):
                return -value
            case ast.Tuple(elts=items) | ast.List(elts=items) | ast.Set(elts=items):
                return [self._literal(i) for i in items]
        raise PredicateError(f"not a literal: {ast.unparse(node)!r}")

    def _members(self, node: ast.expr) -> list:
        if not isinstance(node, (ast.Tuple, ast.List, ast.Set)):
            raise PredicateError(f"in needs a collection of literals: {self.text!r}")
        out = []
        for value in self._literal(node):
            if isinstance(value, list):
                raise PredicateError(f"nested collection: {self.text!r}")
            out.append(float(value) if _kind_of_value(value) == "number" else value)
        return out


class Holdout:
    """Which rows calibrate and which are reported on; both, either or neither, as declared."""

    def __init__(self, calibrate: str = "seed != 37", report: str = "seed == 37", kinds: dict[str, str] | None = None) -> None:
        self.calibrate, self.report = Predicate(calibrate, kinds), Predicate(report, kinds)

    @property
    def on_parasite(self) -> bool:
        return "parasite" in self.calibrate.fields | self.report.fields

    def sides(self, df: DataFrame) -> DataFrame:
        """df's rows of either side, with is_cal and is_rep: one scan serves both."""
        return df.withColumns({"is_cal": self.calibrate.column(), "is_rep": self.report.column()}).where("is_cal OR is_rep")


def clean_pages(df: DataFrame, holdout: Holdout) -> DataFrame:
    """Rows without foreign ink, unless the protocol itself speaks of it."""
    return df if holdout.on_parasite else df.where(F.coalesce(F.col("parasite"), F.lit(0.0)) == 0)


def from_dpi(df: DataFrame, dpi: int) -> DataFrame:
    return df.where(F.col("dpi") >= dpi)


def refuse_unknown(df: DataFrame, column: str, known: DataFrame, known_column: str, what: str) -> DataFrame:
    """df, or ValueError with up to 20 values that known lacks."""
    stray = df.select(column).distinct().join(known.select(F.col(known_column).alias(column)), column, "left_anti").orderBy(column).limit(20).collect()
    if stray:
        raise ValueError(f"unknown {what}: {', '.join(str(r[0]) for r in stray)}")
    return df
