"""Property maps: read, set, replace and remove keys, and compare and print their tagged values."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import Field
from ..types import MAP, MAP_VALUE, MEMBERS, TAGS, tagged


def value_literal(value: Any, tag: str | None = None) -> Column:
    if value is None:
        return F.lit(None).cast(MAP_VALUE)
    got = tagged(value, tag)
    return F.struct(*(F.lit(got[f.name]).cast(f.dataType).alias(f.name) for f in MAP_VALUE))


def map_literal(values: dict[str, Any] | None) -> Column:
    if values is None:
        return F.lit(None).cast(MAP)
    if not values:
        return F.create_map().cast(MAP)
    return F.create_map(*(c for k, v in values.items() for c in (F.lit(k), value_literal(v)))).cast(MAP)


def set_key(column: Column, key: str, value: Any) -> Column:
    """The map with key set; a null map becomes a map of one key."""
    rest = F.map_filter(F.coalesce(column, map_literal({})), lambda k, _: k != key)
    return F.map_concat(rest, F.create_map(F.lit(key), value_literal(value)).cast(MAP))


def remove_key(column: Column, key: str) -> Column:
    return F.map_filter(column, lambda k, _: k != key)


def value_text(value: Column) -> Column:
    """A value as text; floating-point numbers have six decimals."""
    real = F.coalesce(value["f32"].cast("double"), value["f64"])
    return F.coalesce(value["s"], value["i32"].cast("string"), value["i64"].cast("string"), value["b"].cast("string"), F.when(real.isNotNull(), F.format_string("%.6f", real)))


def value_as(value: Column, kind: str) -> Column:
    """The value if it is of that type (any type for string, as text), else null."""
    return value_text(value) if kind == "string" else value[MEMBERS[kind]]


def whole(value: Column) -> Column:
    """The value, if it is a whole number's type."""
    return F.coalesce(value["i32"].cast("bigint"), value["i64"])


def real(value: Column) -> Column:
    """The value, if it is a floating-point number."""
    return F.coalesce(value["f32"].cast("double"), value["f64"])


def text_to_json(text: Column) -> Column:
    quoted = F.to_json(F.array(text))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def to_json(column: Column) -> Column:
    """A property map as a flat JSON object, its keys in order; 32 and 64 bit numbers look alike there."""

    def entry(e: Column) -> Column:
        value = e["value"]
        number = F.coalesce(value["i32"].cast("string"), value["i64"].cast("string"), real(value).cast("string"), value["b"].cast("string"))
        return F.concat(text_to_json(e["key"]), F.lit(":"), F.coalesce(F.when(value["s"].isNotNull(), text_to_json(value["s"])), number, F.lit("null")))

    entries = F.array_sort(F.map_entries(column))
    return F.when(column.isNotNull(), F.concat(F.lit("{"), F.array_join(F.transform(entries, entry), ","), F.lit("}")))


def fields_to_json(fields: tuple[Field, ...]) -> Column:
    """The columns of fields as a JSON object; null ones are left out."""
    plain = F.to_json(F.struct(*(F.col(f.name) for f in fields if f.type.kind != "map"))) if any(f.type.kind != "map" for f in fields) else F.lit("{}")
    parts = [F.nullif(F.substring(plain, F.lit(2), F.length(plain) - 2), F.lit(""))]
    parts += [F.concat(text_to_json(F.lit(f.name)), F.lit(":"), to_json(F.col(f.name))) for f in fields if f.type.kind == "map"]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def fields_from_json(column: Column, fields: tuple[Field, ...]) -> list[Column]:
    """The fields of a JSON object, each null where it is missing or of another type."""
    kinds = ", ".join(f"`{f.name}` {'string' if f.type.kind == 'map' else f.type.spark.simpleString()}" for f in fields)
    if not kinds:
        return []
    got = F.from_json(column, f"struct<{kinds.replace('` ', '`: ')}>")
    return [from_json(got[f.name]) if f.type.kind == "map" else got[f.name] for f in fields]


def from_json(column: Column | str) -> Column:
    """A flat JSON object to a property map: whole numbers are int64, other numbers double, else bool or string."""
    raw = F.from_json(column, "map<string,string>")

    def value(_, text: Column) -> Column:
        whole, real = text.rlike(r"^-?[0-9]{1,18}$"), text.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$")
        truth = text.isin("true", "false")
        tag = F.when(whole, TAGS["int64"]).when(real, TAGS["double"]).when(truth, TAGS["bool"]).otherwise(TAGS["string"])
        is_tag = lambda k: tag == TAGS[k]
        none = lambda kind: F.lit(None).cast(kind)
        return F.struct(
            tag.cast("tinyint").alias("tag"), none("int").alias("i32"), F.when(is_tag("int64"), text.try_cast("bigint")).alias("i64"),
            none("float").alias("f32"), F.when(is_tag("double"), text.try_cast("double")).alias("f64"), F.when(is_tag("bool"), text == "true").alias("b"), F.when(is_tag("string"), text).alias("s"),
        )

    return F.transform_values(raw, value)
