"""Field types and their Spark types.

A property map holds values of six types under free keys. Spark maps have one value type, so a value is a struct of a tag
and six members of which one is set; the difference between 32 and 64 bit integers survives a round trip.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

from .errors import Invalid, TypeMismatch

#: Tags of map values; the numbers are part of the stored format.
TAGS = {"int32": 0, "int64": 1, "float": 2, "double": 3, "bool": 4, "string": 5}
MEMBERS = {"int32": "i32", "int64": "i64", "float": "f32", "double": "f64", "bool": "b", "string": "s"}
SCALARS: dict[str, T.DataType] = {
    "int32": T.IntegerType(), "int64": T.LongType(), "float": T.FloatType(),
    "double": T.DoubleType(), "bool": T.BooleanType(), "string": T.StringType(),
}
MAP_VALUE = T.StructType([T.StructField("tag", T.ByteType()), *(T.StructField(MEMBERS[k], SCALARS[k]) for k in TAGS)])
MAP = T.MapType(T.StringType(), MAP_VALUE)
INT_RANGE = {"int32": 31, "int64": 63}


@dataclass(frozen=True)
class FieldType:
    """A scalar, string(n) with at most n bytes, array<element> or map."""

    kind: str
    element: str | None = None
    limit: int | None = None

    @classmethod
    def parse(cls, text: str) -> FieldType:
        name = text.strip().lower()
        name = {"int": "int32", "long": "int64", "bigint": "int64", "float64": "double", "float32": "float", "boolean": "bool", "utf8": "string", "properties": "map"}.get(name, name)
        if name in SCALARS or name == "map":
            return cls(name)
        if m := re.fullmatch(r"string\((\d+)\)", name):
            return cls("string", limit=int(m[1]))
        if m := re.fullmatch(r"array<(\w+)(?:,\s*(\d+))?>", name):
            element = cls.parse(m[1])
            if element.kind in SCALARS:
                return cls("array", element.kind, int(m[2]) if m[2] else None)
        raise Invalid(f"unknown type {text!r}")

    @classmethod
    def of_spark(cls, kind: T.DataType) -> FieldType:
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            return cls("int32")
        for name, spark in SCALARS.items():
            if kind == spark:
                return cls(name)
        if isinstance(kind, T.ArrayType) and (element := cls.of_spark(kind.elementType)).kind in SCALARS:
            return cls("array", element.kind)
        if kind.simpleString() == MAP.simpleString():
            return cls("map")
        raise TypeMismatch(f"no field can hold {kind.simpleString()}")

    @property
    def spark(self) -> T.DataType:
        if self.kind == "array":
            return T.ArrayType(SCALARS[self.element])
        return MAP if self.kind == "map" else SCALARS[self.kind]

    def __str__(self) -> str:
        if self.kind == "array":
            return f"array<{self.element}>"
        return f"string({self.limit})" if self.limit else self.kind

    def check(self, value: Any) -> Any:
        """value as this type stores it; TypeMismatch if it is of another type."""
        if value is None:
            return None
        if self.kind == "array":
            if not isinstance(value, (list, tuple)):
                raise TypeMismatch(f"{value!r} is not a list")
            return [FieldType(self.element).check(x) for x in value]
        if self.kind == "map":
            if not isinstance(value, dict):
                raise TypeMismatch(f"{value!r} is not a map")
            return {str(k): tagged(v) for k, v in value.items()}
        if self.kind == "bool":
            good = isinstance(value, bool)
        elif self.kind in INT_RANGE:
            good = isinstance(value, int) and not isinstance(value, bool) and -(2 ** INT_RANGE[self.kind]) <= value < 2 ** INT_RANGE[self.kind]
        elif self.kind in ("float", "double"):
            good = isinstance(value, (int, float)) and not isinstance(value, bool)
            value = float(value) if good else value
        else:
            good = isinstance(value, str)
            if good and self.limit is not None and len(value.encode()) > self.limit:
                raise TypeMismatch(f"string of more than {self.limit} bytes")
        if not good:
            raise TypeMismatch(f"{value!r} is not {self}")
        return value


def tag_of(value: Any) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int64"
    if isinstance(value, float):
        return "double"
    if isinstance(value, str):
        return "string"
    raise TypeMismatch(f"a map can't hold {value!r}")


def tagged(value: Any, tag: str | None = None) -> dict | None:
    """A map value as stored; tag picks the 32-bit types, which Python can't tell from the others."""
    if value is None or isinstance(value, dict) and "tag" in value:
        return value
    tag = tag or tag_of(value)
    return {"tag": TAGS[tag]} | {m: None for m in MEMBERS.values()} | {MEMBERS[tag]: value}
