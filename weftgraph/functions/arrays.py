"""Array fields: append."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def array_literal(values: list[Any] | None, kind: T.ArrayType) -> Column:
    if values is None:
        return F.lit(None).cast(kind)
    return F.array(*(F.lit(v).cast(kind.elementType) for v in values)).cast(kind)


def append(column: Column, values: Any, kind: T.ArrayType) -> Column:
    """The array with one value, or a list of them, at its end. A null array becomes the list; an empty list changes nothing."""
    values = list(values) if isinstance(values, (list, tuple)) else [values]
    if not values:
        return column
    return F.concat(F.coalesce(column, F.array().cast(kind)), array_literal(values, kind))
