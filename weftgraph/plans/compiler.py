"""A query to one lazy DataFrame."""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..catalog import EDGE_FIELDS, EdgeType, NodeSchema
from ..errors import Invalid, NotFound, Unsupported
from ..functions import maps
from ..operators import traverse as hops
from ..types import TAGS, FieldType
from .expressions import Expression, Reference
from .query import GraphQuery, Item, Traverse, Where

if TYPE_CHECKING:
    from ..graph import Graph


@dataclass
class Stats:
    """WHERE clauses that were moved to where their alias is read, and those left for the whole rows."""

    where_inlined: int = 0
    where_post_processed: int = 0


@dataclass
class Result:
    df: DataFrame
    stats: Stats

    def explain(self, mode: str = "formatted") -> None:
        self.df.explain(mode)


class Scope:
    """Aliases of a query: node schemas and edge types."""

    def __init__(self, graph: Graph, query: GraphQuery):
        self.catalog = graph.catalog
        self.nodes: dict[str, NodeSchema] = {}
        self.edges: dict[str, EdgeType] = {}
        self.order: list[str] = []  # of the aliases' columns
        self.declare(query.start.alias, query.start.schema or query.start.alias)
        for c in query.clauses:
            if isinstance(c, Traverse):
                for node in (c.source, c.target):
                    if node.alias not in self.nodes or node.schema:
                        self.declare(node.alias, node.schema)
                if c.alias:
                    self.declare_edge(c.alias, c.type)
        for c in query.clauses:
            if isinstance(c, Where):
                for one in c.expression.comparisons():
                    self.resolve(one.path)

    def declare(self, alias: str, schema: str | None) -> None:
        if alias in self.edges:
            raise Invalid(f"{alias} is an edge")
        if schema is None:
            raise NotFound(f"alias {alias} has no schema")
        known = self.nodes.get(alias)
        if known and known.name != schema:
            raise Invalid(f"{alias} is {known.name}, not {schema}")
        if not known:
            self.nodes[alias] = self.catalog.node(schema)
            self.order.append(alias)

    def declare_edge(self, alias: str, type: str) -> None:
        if alias in self.nodes or alias in self.edges:
            raise Invalid(f"alias {alias} is taken")
        edge = self.catalog.edge(type)
        if edge.fields is None:
            raise Invalid(f"edge type {type} has no schema, so it can have no alias")
        self.edges[alias] = edge
        self.order.append(alias)

    def resolve(self, path: str) -> Reference:
        alias, *parts = path.split(".")
        if alias not in self.nodes and alias not in self.edges:
            raise NotFound(f"unknown alias {alias}")
        if not parts:
            raise Invalid(f"{path} names no field")
        found = (self.nodes.get(alias) or self.edges[alias]).field(parts[0])
        if len(parts) > 2:
            raise Unsupported(f"{path}: maps are read one level deep")
        if len(parts) == 2 and found.type.kind != "map":
            raise Invalid(f"{path}: {alias}.{parts[0]} is no map")
        return Reference(alias, parts[0], found.type, parts[1] if len(parts) == 2 else None)

    def fields(self, alias: str) -> list[str]:
        """Of an edge only its properties."""
        return list(self.nodes[alias].names) if alias in self.nodes else [f.name for f in self.edges[alias].fields]


class Compiler:
    def __init__(self, graph: Graph, query: GraphQuery):
        self.graph, self.query = graph, query
        self.scope = Scope(graph, query)
        self.stats = Stats()

    def compile(self) -> Result:
        query, scope, start = self.query, self.scope, self.query.start.alias
        hop_of = {}  # the clause that brings an alias in
        known = {start}
        for at, c in enumerate(query.clauses):
            if isinstance(c, Traverse):
                for alias in (c.source.alias, c.target.alias, c.alias):
                    if alias and alias not in known:
                        hop_of[alias] = at
                        known.add(alias)
        pushed: dict[str, list[Expression]] = {}
        placed: dict[int, list[tuple[str, Expression]]] = {}
        late: list[Expression] = []
        for at, c in enumerate(query.clauses):
            if not isinstance(c, Where):
                continue
            aliases = c.expression.aliases()
            alias = next(iter(aliases))
            if len(aliases) > 1:
                late.append(c.expression)
                self.stats.where_post_processed += 1
            elif alias == start or alias in scope.edges or query.inline and not c.expression.nested():
                pushed.setdefault(alias, []).append(c.expression)
                self.stats.where_inlined += 1
            else:
                placed.setdefault(max(at, hop_of[alias]), []).append((alias, c.expression))

        rows = self.nodes(start, pushed)
        present, first = {start}, True
        for at, c in enumerate(query.clauses):
            if isinstance(c, Traverse):
                rows = self.hop(rows, c, present, first, pushed)
                present |= {c.source.alias, c.target.alias}
                first = False
            for alias, expression in placed.get(at, ()):
                keep = expression.column(scope)
                if query.mode == "compat":  # a row that found nothing at this alias is not judged by it
                    keep = keep | F.col(f"`{alias}.id`").isNull()
                rows = rows.filter(keep)
        for expression in late:
            rows = rows.filter(expression.column(scope))
        return Result(self.project(rows), self.stats)

    def nodes(self, alias: str, pushed: dict[str, list[Expression]]) -> DataFrame:
        schema = self.scope.nodes[alias]
        frame = self.graph.node_frame(schema.name, self.query.valid_time, self.query.tx_time)
        frame = frame.select(*(F.col(n).alias(f"{alias}.{n}") for n in schema.names))
        for expression in pushed.get(alias, ()):
            frame = frame.filter(expression.column(self.scope))
        return frame

    def edges(self, c: Traverse, pushed: dict[str, list[Expression]], near_is_source: bool) -> hops.Edges:
        frame = self.graph.edge_frame(c.type, self.scope.nodes[c.source.alias].name, self.scope.nodes[c.target.alias].name)
        kind, columns = self.scope.catalog.edge(c.type), []
        if c.alias:
            names = [*EDGE_FIELDS, *(f.name for f in kind.fields)]
            frame = frame.select(*EDGE_FIELDS, *(F.col(n).alias(f"{c.alias}.{n}") for n in names))
            for expression in pushed.get(c.alias, ()):
                frame = frame.filter(expression.column(self.scope))
            columns = [f"{c.alias}.{n}" for n in self.wanted(c.alias, [f.name for f in kind.fields])]
        near, far = ("source_id", "target_id") if near_is_source else ("target_id", "source_id")
        # Edges that have no id are told apart by what is looked at; a map has no hash, but its entries have.
        told = [F.array_sort(F.map_entries(f"`{x}`")) if isinstance(frame.schema[x].dataType, MapType) else F.col(f"`{x}`") for x in columns]
        order = [] if kind.unique or not columns else [F.coalesce(F.col("id"), F.xxhash64(*told)).alias(hops.ORDER)]
        frame = frame.select(F.col(near).alias(hops.NEAR), F.col(far).alias(hops.FAR), *(F.col(f"`{x}`") for x in columns), *order)
        return hops.Edges(frame, tuple(columns), kind.unique)

    def wanted(self, alias: str, fields: list[str]) -> list[str]:
        """Which properties of an edge are looked at after its hop; the others need not be told apart among parallel edges."""
        if self.query.items is None or any(i.path == alias for i in self.query.items):
            return fields
        paths = [i.path for i in self.query.items]
        for c in self.query.clauses:
            if isinstance(c, Where) and len(c.expression.aliases()) > 1:
                paths += [one.path for one in c.expression.comparisons()]
        used = {p.split(".")[1] for p in paths if p.startswith(f"{alias}.")}
        return [f for f in fields if f in used]

    def hop(self, rows: DataFrame, c: Traverse, present: set[str], first: bool, pushed: dict[str, list[Expression]]) -> DataFrame:
        source, target = c.source.alias, c.target.alias
        forward = source in present
        if not forward and target not in present:
            raise Invalid(f"neither {source} nor {target} is reached by an earlier part of the pattern")
        near, far = (source, target) if forward else (target, source)
        edges = self.edges(c, pushed, forward)
        near, far_alias, far = f"{near}.id", far, f"{far}.id"
        if far_alias in present:
            if c.join in ("RIGHT", "FULL"):
                raise Unsupported(f"{c}: both ends are bound already")
            return hops.close(rows, edges, near, far, "inner" if c.join == "INNER" else "left")
        nodes = self.nodes(far_alias, pushed)
        # LEFT keeps sources and RIGHT keeps targets; past the first hop RIGHT keeps what is there as well.
        keep_near = c.join == "FULL" or c.join == ("LEFT" if forward else "RIGHT") or c.join == "RIGHT" and not first
        keep_far = c.join == "FULL" or c.join == ("RIGHT" if forward else "LEFT")
        if self.query.mode == "ansi":
            keep_near = c.join == "FULL" or c.join == ("LEFT" if forward else "RIGHT")
        elif c.join in ("RIGHT", "FULL") and self.scope.nodes[source] == self.scope.nodes[target]:
            return hops.within_schema(rows, edges, nodes, near, far, keep_near, keep_far, forward)
        how = {(False, False): hops.inner, (True, False): hops.keep_prefix, (False, True): hops.keep_nodes, (True, True): hops.keep_both}
        return how[keep_near, keep_far](rows, edges, nodes, near, far)

    def project(self, rows: DataFrame) -> DataFrame:
        """Columns stand in the order of the aliases in the pattern, not of SELECT; a map's keys follow all others."""
        scope, items = self.scope, self.query.items
        every = [f"{a}.{n}" for a in scope.order for n in scope.fields(a)]
        if items is None:
            return rows.select(*(F.col(f"`{c}`") for c in every))
        names: dict[str, list[str]] = {}
        keys: list[tuple[Item, Reference]] = []
        for item in items:
            if "." not in item.path:
                if item.path not in scope.order:
                    raise NotFound(f"unknown alias {item.path}")
                if item.name:
                    raise Invalid(f"{item.path} is an alias and can't be renamed")
                for n in scope.fields(item.path):
                    names.setdefault(f"{item.path}.{n}", []).append(f"{item.path}.{n}")
                continue
            ref = scope.resolve(item.path)
            if ref.key is not None:
                keys.append((item, ref))
            elif item.path not in every:
                raise NotFound(f"{item.path} is not part of the result")
            else:
                names.setdefault(item.path, []).append(item.name or item.path)
        columns = [F.col(f"`{c}`").alias(n) for c in every for n in dict.fromkeys(names.get(c, ()))]
        for item, ref in keys:
            value = F.try_element_at(ref.column, F.lit(ref.key))
            kind = item.kind or self.kind_of_key(rows, value)
            column = F.lit(None) if kind is None else maps.value_as(value, kind)
            columns.append(column.alias(item.name or item.path))
        return rows.select(*columns)

    @staticmethod
    def kind_of_key(rows: DataFrame, value) -> str | None:
        """The type that all values of a key have; string if they differ, None if there is none. Reads the rows once; saying the type in SELECT saves that."""
        tags = [r[0] for r in rows.select(value["tag"].alias("tag")).filter("tag IS NOT NULL").distinct().collect()]  # six at most
        return next(k for k, t in TAGS.items() if t == tags[0]) if len(tags) == 1 else "string" if tags else None


def field_type(graph: Graph, schema: str, name: str) -> FieldType:
    return graph.catalog.node(schema).field(name).type
