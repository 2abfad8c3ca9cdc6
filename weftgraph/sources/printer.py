"""Tables as text."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Row

from ..types import MEMBERS, TAGS

_MEMBER_OF_TAG = {TAGS[k]: MEMBERS[k] for k in TAGS}


def cell(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, Row) and "tag" in value.__fields__:
        return cell(value[_MEMBER_OF_TAG[value["tag"]]])
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value:.6f}"
    if isinstance(value, str):
        return f'"{value}"'
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(cell, value)) + "]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{k}: {cell(v)}" for k, v in sorted(value.items())) + "}"
    return str(value)


def table(df: DataFrame, limit: int = 100) -> str:
    """The first rows in order of the ids among the columns, in a frame."""
    ids = [f"`{c}`" for c in df.columns if c == "id" or c.endswith(".id")]
    rows = [[cell(v) for v in r] for r in (df.orderBy(*ids) if ids else df).limit(limit + 1).collect()]
    more, rows = len(rows) > limit, rows[:limit]
    widths = [max(len(x) for x in column) for column in zip(df.columns, *rows, strict=True)] if df.columns else []
    line = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    show = lambda cells: "|" + "|".join(f" {x:<{w}} " for x, w in zip(cells, widths, strict=True)) + "|"
    return "\n".join([line, show(df.columns), line, *map(show, rows), line, f"{len(rows)} rows" + " shown, there are more" * more])
