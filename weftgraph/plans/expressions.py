"""Predicates over ``alias.field`` paths, and their Columns."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import Invalid, TypeMismatch, Unsupported
from ..functions import maps
from ..types import MEMBERS, FieldType, tag_of

ORDERED = {">": "__gt__", "<": "__lt__", ">=": "__ge__", "<=": "__le__"}
TEXTUAL = {"CONTAINS": "contains", "STARTS_WITH": "startswith", "ENDS_WITH": "endswith"}
OPERATORS = ("=", "!=", *ORDERED, *TEXTUAL)
NUMERIC = ("int32", "int64", "float", "double")


@dataclass(frozen=True)
class Reference:
    """A resolved path: the column of an alias's field, and the key within it if the field is a map."""

    alias: str
    field: str
    type: FieldType
    key: str | None = None

    @property
    def column(self) -> Column:
        return F.col(f"`{self.alias}.{self.field}`")


class Resolver(Protocol):
    def resolve(self, path: str) -> Reference: ...


class Expression:
    def aliases(self) -> set[str]:
        raise NotImplementedError

    def comparisons(self) -> list[Comparison]:
        raise NotImplementedError

    def column(self, scope: Resolver) -> Column:
        raise NotImplementedError

    def nested(self) -> bool:
        """Whether a path reaches into a map, so that the predicate is not moved into a hop."""
        return any(c.path.count(".") > 1 for c in self.comparisons())

    def __and__(self, other: Expression) -> Expression:
        return Both("AND", self, other)

    def __or__(self, other: Expression) -> Expression:
        return Both("OR", self, other)


@dataclass(frozen=True)
class Comparison(Expression):
    path: str
    op: str
    value: Any

    def __post_init__(self) -> None:
        if self.op not in OPERATORS:
            raise Invalid(f"unknown operator {self.op!r}")
        if self.path.count(".") < 1:
            raise Invalid(f"{self.path!r} is not alias.field")

    def aliases(self) -> set[str]:
        return {self.path.split(".")[0]}

    def comparisons(self) -> list[Comparison]:
        return [self]

    def __str__(self) -> str:
        value = "NULL" if self.value is None else f'"{self.value}"' if isinstance(self.value, str) else str(self.value).lower() if isinstance(self.value, bool) else str(self.value)
        return f"{self.path} {self.op} {value}"

    def column(self, scope: Resolver) -> Column:
        """Null equals null and nothing else. A comparison of a null field with a value is null but for !=, and no filter lets
        null through; as there is no NOT, that is as good as false, and it reaches the scan as it is."""
        ref = scope.resolve(self.path)
        if self.value is None and self.op not in ("=", "!="):
            raise TypeMismatch(f"{self}: null has no order")
        if ref.key is not None:
            return self._of_map(ref)
        if ref.type.kind in ("array", "map"):
            if self.value is None:
                return self._equal(ref.column, F.lit(None))
            raise TypeMismatch(f"{self}: {ref.type} can't be compared")
        self._check(ref.type.kind)
        if self.op in ("=", "!="):
            return self._equal(ref.column, F.lit(self.value))
        return self._ordered(ref.column)

    def _ordered(self, column: Column) -> Column:
        if self.op in TEXTUAL:
            return getattr(column, TEXTUAL[self.op])(self.value)
        return getattr(column, ORDERED[self.op])(F.lit(self.value))

    def _equal(self, column: Column, value: Column) -> Column:
        if self.op == "=" and self.value is not None:
            return column == value
        same = column.eqNullSafe(value)
        return same if self.op == "=" else ~same

    def _check(self, kind: str) -> None:
        if self.value is None:
            return
        own = tag_of(self.value)
        if not (own == kind or own in NUMERIC and kind in NUMERIC):
            raise TypeMismatch(f"{self}: the field is {kind}, the value {own}")
        if kind == "bool" and self.op not in ("=", "!="):
            raise TypeMismatch(f"{self}: booleans have no order")
        if self.op in TEXTUAL and kind != "string":
            raise TypeMismatch(f"{self}: {self.op} is for strings")

    def _of_map(self, ref: Reference) -> Column:
        value = F.try_element_at(ref.column, F.lit(ref.key))
        if self.value is None:
            return self._equal(value["tag"], F.lit(None))
        own = tag_of(self.value)
        self._check(own)
        if own not in NUMERIC:
            found = value[MEMBERS[own]]
            return self._equal(found, F.lit(self.value)) if self.op in ("=", "!=") else self._ordered(found)
        # Whole numbers are compared as such: as doubles those above 2**53 would run together.
        whole, number = maps.whole(value), maps.real(value)
        if self.op == "!=":
            return ~F.coalesce(self._of_whole(whole, "="), number == float(self.value), F.lit(False))
        op = getattr(number, ORDERED.get(self.op, "__eq__"))
        return F.coalesce(self._of_whole(whole, self.op), op(F.lit(float(self.value))))

    def _of_whole(self, whole: Column, op: str) -> Column:
        """A whole number compared with the value, exactly; null where there is none."""
        bound = self.value
        if isinstance(bound, float) and not math.isfinite(bound):
            return getattr(whole.cast("double"), ORDERED.get(op, "__eq__"))(F.lit(bound))
        if bound != int(bound):  # between two whole numbers
            if op == "=":
                return F.when(whole.isNotNull(), F.lit(False))
            bound = math.floor(bound) if op in (">", "<=") else math.ceil(bound)
        bound = int(bound)
        if not -(2**63) <= bound < 2**63:
            return F.when(whole.isNotNull(), F.lit(op != "=" and (op in ("<", "<=")) == (bound > 0)))
        return getattr(whole, ORDERED.get(op, "__eq__"))(F.lit(bound).cast("bigint"))


@dataclass(frozen=True)
class Path:
    """Another field, as the right side of a comparison."""

    text: str

    def __str__(self) -> str:
        return self.text


@dataclass(frozen=True)
class FieldComparison(Expression):
    """Two fields compared, of one alias or of two. Numbers of any type are compared with each other; null equals null."""

    path: str
    op: str
    other: str

    def __post_init__(self) -> None:
        if self.op not in OPERATORS:
            raise Invalid(f"unknown operator {self.op!r}")
        for path in (self.path, self.other):
            if path.count(".") < 1:
                raise Invalid(f"{path!r} is not alias.field")

    def aliases(self) -> set[str]:
        return {self.path.split(".")[0], self.other.split(".")[0]}

    def comparisons(self) -> list[Comparison]:
        """What each side looks at."""
        return [Comparison(self.path, "=", None), Comparison(self.other, "=", None)]

    def __str__(self) -> str:
        return f"{self.path} {self.op} {self.other}"

    def column(self, scope: Resolver) -> Column:
        left, right = scope.resolve(self.path), scope.resolve(self.other)
        if left.key is not None or right.key is not None:
            raise Unsupported(f"{self}: keys of maps are compared with values only")
        kinds = (left.type.kind, right.type.kind)
        if not (kinds[0] == kinds[1] or all(k in NUMERIC for k in kinds)) or "array" in kinds or "map" in kinds:
            raise TypeMismatch(f"{self}: {left.type} and {right.type} can't be compared")
        if kinds[0] == "bool" and self.op not in ("=", "!="):
            raise TypeMismatch(f"{self}: booleans have no order")
        if self.op in TEXTUAL:
            if kinds[0] != "string":
                raise TypeMismatch(f"{self}: {self.op} is for strings")
            return getattr(left.column, TEXTUAL[self.op])(right.column)
        if self.op in ("=", "!="):
            same = left.column.eqNullSafe(right.column)
            return same if self.op == "=" else ~same
        return getattr(left.column, ORDERED[self.op])(right.column)


@dataclass(frozen=True)
class Both(Expression):
    op: str  # AND, OR
    left: Expression
    right: Expression

    def aliases(self) -> set[str]:
        return self.left.aliases() | self.right.aliases()

    def comparisons(self) -> list[Comparison]:
        return self.left.comparisons() + self.right.comparisons()

    def __str__(self) -> str:
        return f"({self.left}) {self.op} ({self.right})"

    def column(self, scope: Resolver) -> Column:
        left, right = self.left.column(scope), self.right.column(scope)
        return left & right if self.op == "AND" else left | right


def compare(path: str, op: str, value: Any) -> Comparison | FieldComparison:
    if isinstance(value, Path):
        return FieldComparison(path, op, value.text)
    if isinstance(value, Column):
        raise Unsupported("a value is a literal")
    return Comparison(path, op, value)
