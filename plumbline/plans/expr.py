"""Predicates over metadata: a small language, type-checked against a schema and compiled to clauses, then to Spark columns.

A compiled filter is an AND of clauses, each an OR of leaves (column, comparison, literal). A clause that holds both `c = v` and `c <> v` is dropped, and
rows with a null in c then pass it. Otherwise a null satisfies no leaf, `<>` included. NaN satisfies `<>` only.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass
from enum import Enum
from functools import reduce
from itertools import product
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import datetimes
from plumbline.types import DataType, EngineError


class CmpOp(Enum):
    Eq = "="
    Neq = "<>"
    Lt = "<"
    Lte = "<="
    Gt = ">"
    Gte = ">="


class ExprError(EngineError):
    pass


class UnknownColumn(ExprError):
    def __init__(self, name: str) -> None:
        super().__init__(f"Unknown column '{name}'")


class TypeMismatch(ExprError):
    def __init__(self, name: str, kind: DataType, got: str) -> None:
        self.got = got
        super().__init__(f"Type mismatch for column '{name}': expected {kind.name}, got literal {got}")


class UnsupportedStringOp(ExprError):
    def __init__(self, name: str) -> None:
        super().__init__(f"Unsupported comparator for string column '{name}'")


class InvalidComparison(ExprError):
    def __init__(self) -> None:
        super().__init__("Invalid expression shape for comparison (expect column vs literal)")


class InvalidExpression(ExprError):
    def __init__(self) -> None:
        super().__init__("Invalid expression (unexpected literal or column without comparator)")


class Expr:
    """Base of the nodes; comparisons take a plain value."""

    def _compare(self, op: CmpOp, value: Any) -> Compare:
        return Compare(self, op, value if isinstance(value, Expr) else Lit(value))

    def eq(self, value: Any) -> Compare:
        return self._compare(CmpOp.Eq, value)

    def neq(self, value: Any) -> Compare:
        return self._compare(CmpOp.Neq, value)

    def lt(self, value: Any) -> Compare:
        return self._compare(CmpOp.Lt, value)

    def lte(self, value: Any) -> Compare:
        return self._compare(CmpOp.Lte, value)

    def gt(self, value: Any) -> Compare:
        return self._compare(CmpOp.Gt, value)

    def gte(self, value: Any) -> Compare:
        return self._compare(CmpOp.Gte, value)

    def and_(self, other: Expr) -> And:
        return And(self, other)

    def or_(self, other: Expr) -> Or:
        return Or(self, other)

    __and__, __or__ = and_, or_

    def compile(self, schema: Mapping[str, DataType]) -> CompiledFilter:
        return CompiledFilter(tuple(c for c in _clauses(self, schema) if not _always(c)))


@dataclass(frozen=True)
class Col(Expr):
    name: str


@dataclass(frozen=True)
class Lit(Expr):
    value: Any

    def __post_init__(self) -> None:
        if isinstance(self.value, bool) or not isinstance(self.value, (int, float, str)):
            raise TypeError(f"a literal is an int, a float or a str, not {type(self.value).__name__}")
        if isinstance(self.value, int) and not -(2**63) <= self.value < 2**63:
            raise TypeError("an integer literal has 64 bits at most")


@dataclass(frozen=True)
class Compare(Expr):
    left: Expr
    op: CmpOp
    right: Expr


@dataclass(frozen=True)
class And(Expr):
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Or(Expr):
    left: Expr
    right: Expr


def col(name: str) -> Col:
    return Col(name)


def lit(value: Any) -> Lit:
    return Lit(value)


@dataclass(frozen=True)
class ColumnFilter:
    """A leaf. value: an int for integer columns, a float for float columns, milliseconds for datetimes, a str for strings."""

    column: str
    kind: DataType
    op: CmpOp
    value: int | float | str

    def to_spark(self) -> Column:
        """True for the rows that satisfy the leaf, false or null for others. The literal is cast, never the column, so that it is pushed
        down to files."""
        c = F.col(f"`{self.column}`")
        if self.kind.is_float and math.isnan(self.value):
            return c.isNotNull() if self.op is CmpOp.Neq else F.lit(False)
        if self.kind is DataType.DateTime:
            v = datetimes.literal(self.value)
        elif self.kind is DataType.Float32:
            v = F.lit(float(self.value)).cast("float")
        elif self.kind is DataType.Int32 and not -(2**31) <= self.value < 2**31:
            v = F.lit(self.value).cast("long")
        else:
            v = F.lit(self.value).cast(self.kind.value)
        out = compare(c, self.op.value, v)
        if self.kind.is_float and self.op in (CmpOp.Gt, CmpOp.Gte):  # Spark has NaN above all numbers
            out = out & (c <= F.lit(math.inf).cast(self.kind.value))
        return out


def compare(a: Column, op: str, b: Column) -> Column:
    return {"=": a.__eq__, "<>": a.__ne__, "<": a.__lt__, "<=": a.__le__, ">": a.__gt__, ">=": a.__ge__}[op](b)


@dataclass(frozen=True)
class CompiledFilter:
    clauses: tuple[tuple[ColumnFilter, ...], ...]

    def to_spark(self) -> Column:
        return self.lower(ColumnFilter.to_spark)

    def lower(self, leaf) -> Column:
        return reduce(Column.__and__, (reduce(Column.__or__, map(leaf, c)) for c in self.clauses), F.lit(True))


def _always(clause: tuple[ColumnFilter, ...]) -> bool:
    """Whether a clause holds a leaf and its contrary. Numbers compare as numbers: NaN is no contrary of NaN."""
    return any(a.op is CmpOp.Eq and b.op is CmpOp.Neq and a.column == b.column and a.value == b.value for a in clause for b in clause)


def _clauses(e: Expr, schema: Mapping[str, DataType]) -> list[tuple[ColumnFilter, ...]]:
    if isinstance(e, And):
        left = _clauses(e.left, schema)
        return left + _clauses(e.right, schema)
    if isinstance(e, Or):
        left = _clauses(e.left, schema)
        return [a + b for a, b in product(left, _clauses(e.right, schema))]
    if isinstance(e, Compare):
        return [(_leaf(e, schema),)]
    raise InvalidExpression


def _leaf(e: Compare, schema: Mapping[str, DataType]) -> ColumnFilter:
    if not (isinstance(e.left, Col) and isinstance(e.right, Lit)):
        raise InvalidComparison
    name, value = e.left.name, e.right.value
    if name not in schema:
        raise UnknownColumn(name)
    kind = schema[name]
    got = "string" if isinstance(value, str) else "float" if isinstance(value, float) else "int"
    if kind is DataType.String:
        if e.op not in (CmpOp.Eq, CmpOp.Neq):
            raise UnsupportedStringOp(name)
        if got != "string":
            raise TypeMismatch(name, kind, "string")
        return ColumnFilter(name, kind, e.op, value)
    if kind is DataType.DateTime:
        millis = datetimes.parse(value) if got == "string" else None
        if millis is None:
            raise TypeMismatch(name, kind, "datetime string")
        return ColumnFilter(name, kind, e.op, millis)
    if got == "string" or kind.is_integer and got == "float":
        raise TypeMismatch(name, kind, got)
    return ColumnFilter(name, kind, e.op, float(value) if kind.is_float else value)
