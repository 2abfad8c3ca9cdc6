"""Runs statements against a graph."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import GraphError, Invalid, ParseError
from ..graph import Graph
from ..plans.query import Assignment, GraphUpdate, UpdateResult
from ..sources.printer import table
from . import parser as p

log = logging.getLogger(__name__)


def _picked(graph: Graph, selector: p.Selector) -> tuple[str, Column]:
    """A selection as (schema, condition). Literals are cast to their fields' types."""
    schema = graph.catalog.node(selector.schema)
    if selector.id is not None:
        return schema.name, F.col("id") == selector.id
    tests = [F.col(n).eqNullSafe(F.lit(v).cast(schema.field(n).type.spark)) for n, v in selector.properties.items()]
    return schema.name, reduce(lambda a, b: a & b, tests)


def _assignments(pairs: tuple[tuple[str, Any], ...], with_alias: bool) -> tuple[Assignment, ...]:
    out = []
    for path, value in pairs:
        parts = path.split(".")
        alias = None
        if with_alias:
            if len(parts) < 2:
                raise Invalid(f"SET {path}: an update by pattern names alias.field")
            alias, *parts = parts
        out.append(Assignment(alias, parts[0], value, parts[1] if len(parts) > 1 else None, len(parts) > 2))
    return tuple(out)


def execute(graph: Graph, text: str) -> DataFrame | UpdateResult | int | str | None:
    """Run one statement: a DataFrame for MATCH and SHOW, the id or number for CREATE and DELETE, the result of an UPDATE."""
    s = p.parse(text)
    log.debug("%s", s)
    match s:
        case p.CreateSchema(edge=True):
            graph.create_edge_schema(s.name, s.fields)
        case p.CreateSchema():
            graph.create_schema(s.name, s.fields)
        case p.CreateNode():
            schema = graph.catalog.node(s.schema)
            for f in schema.fields:
                if f.name not in s.properties and f.type.kind != "map":
                    raise Invalid(f"{s.schema}.{f.name} is required")
            return graph.create_node(s.schema, **s.properties)
        case p.CreateEdge():
            return graph.connect_selected(s.type, _picked(graph, s.source), _picked(graph, s.target), s.unique, **s.properties)
        case p.Match():
            return graph.query(s.query).df
        case p.UpdateNode():
            if s.target.id is None:
                raise ParseError("UPDATE names a node by id or by pattern")
            return graph.update(GraphUpdate(s.target.schema, s.target.id, assignments=_assignments(s.assignments, False)))
        case p.UpdateMatch():
            return graph.update(GraphUpdate(query=s.query, assignments=_assignments(s.assignments, True)))
        case p.DeleteNode():
            if s.target.id is None:
                raise ParseError("DELETE names a node by id or by pattern")
            graph.delete_node(s.target.schema, s.target.id)
            return 1
        case p.DeleteMatch():
            aliases = dict.fromkeys([s.query.start.alias, *(a.alias for c in s.query.clauses if hasattr(c, "target") for a in (c.source, c.target))])
            return graph.delete_matched(s.query, aliases)
        case p.DeleteEdge():
            ends = [None if e is None else _picked(graph, e) for e in (s.source, s.target)]
            return graph.delete_edges(s.type, *ends)
        case p.Show(edge_type=None):
            return graph.edge_types()
        case p.Show():
            return graph.scan_edges(s.edge_type).select("id", "source_id", "target_id", "created_ts")
        case p.Commit():
            return graph.commit()
    return None


def statements(text: str) -> list[str]:
    """The statements of a script: each ends with a line that ends in a semicolon."""
    out, lines = [], []
    for line in text.splitlines():
        if not lines and (not line.strip() or line.strip().startswith(("--", "//"))):
            continue
        lines.append(line)
        if line.split("//")[0].rstrip().endswith(";"):
            out.append("\n".join(lines))
            lines = []
    return out + (["\n".join(lines)] if lines else [])


@dataclass
class ScriptResult:
    executed: int = 0
    failed: int = 0


def describe(result: Any) -> str:
    if isinstance(result, DataFrame):
        return table(result)
    if isinstance(result, UpdateResult):
        return f"Updated {result.updated}" + f", failed {result.failed}: {'; '.join(result.errors)}" * bool(result.failed)
    return "OK" if result is None else str(result)


def run_script(graph: Graph, text: str, write: Callable[[str], None] = print) -> ScriptResult:
    """Run a script and go on after errors."""
    done = ScriptResult()
    for one in statements(text):
        try:
            began = time.perf_counter()
            write(describe(execute(graph, one)))
            log.info("%.3f s: %s", time.perf_counter() - began, one.strip())
            done.executed += 1
        except GraphError as error:
            log.debug("failed: %s", one, exc_info=True)
            write(f"Error: {error}")
            done.failed += 1
    return done
