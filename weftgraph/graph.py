"""The graph: catalog, node and edge tables, changes and queries."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .catalog import EDGE_FIELDS, Catalog, EdgeType, NodeSchema
from .errors import GraphError, Invalid, NotFound, TypeMismatch, Unsupported
from .functions import arrays, maps
from .operators import mutate, temporal
from .plans.compiler import Compiler, Result, Scope
from .plans.query import Assignment, GraphQuery, GraphUpdate, Item, Query, Update, UpdateResult
from .storage import write_once

log = logging.getLogger(__name__)
#: Nodes of the smaller side of a statement that connects every node of one selection with every one of another: up to so
#: many they are broadcast.
BROADCAST_NODES = 200_000


@dataclass(frozen=True)
class Config:
    path: str | None = None  # of snapshots
    validation: bool = True
    versioning: bool = False
    shard_capacity: int = 100_000
    chunk_size: int = 10_000  # rows of a chunk of a scan
    clock: Callable[[], int] = temporal.system_clock  # nanoseconds
    #: Changes of one table after which its lineage is cut by a checkpoint.
    checkpoint_every: int = 8


@dataclass
class Table:
    """A table that is replaced on change, and rows added one by one that wait on the driver for the next read."""

    frame: DataFrame
    waiting: list[tuple] = field(default_factory=list)
    changes: int = 0
    dirty: bool = True
    next_id: int | None = 0  # None: one above the highest id that is there
    saved: str | None = None  # where the last snapshot has it
    bounds: list[int] | None = None
    numbered: bool = True  # edges have ids


class Graph:
    def __init__(self, spark: SparkSession, config: Config | None = None):
        self.spark, self.config = spark, config or Config()
        self.catalog = Catalog()
        self.nodes: dict[str, Table] = {}
        self.versions: dict[str, temporal.Versions] = {}
        self.edges: dict[str, Table] = {}
        self._edge_ids = 0

    # Schemas

    def create_schema(self, name: str, spec) -> NodeSchema:
        schema = self.catalog.add_node_schema(name, spec)
        if name not in self.nodes:
            self.nodes[name] = Table(self.spark.createDataFrame([], schema.spark))
        return schema

    def create_edge_schema(self, name: str, spec=None, source: str | None = None, target: str | None = None, unique: bool = False) -> EdgeType:
        edge = self.catalog.add_edge_type(name, spec, source, target, unique)
        if name in self.edges and self.edges[name].frame.columns != edge.spark.names:
            old = self._flushed(self.edges[name], self._edge_schema_of(name))
            self.edges[name].frame = old.select(*EDGE_FIELDS, *(F.lit(None).cast(f.type.spark).alias(f.name) for f in edge.fields or ()))
        self.edges.setdefault(name, Table(self.spark.createDataFrame([], edge.spark)))
        return edge

    def _edge_schema_of(self, name: str):
        return self.catalog.edge(name).spark

    def use_nodes(self, name: str, frame: DataFrame, versions: DataFrame | None = None) -> NodeSchema:
        """Let a DataFrame with an id column serve as the nodes of a schema made from its columns; nothing is copied.

        versions is a version table of these nodes. Without one, where versions are kept, they begin now. New nodes get ids
        above those that are there.
        """
        rest = [c for c in frame.columns if c != "id"]
        schema = self.catalog.add_node_schema(name, frame.select(*rest).schema)
        self.nodes[name] = Table(frame.select(F.col("id").cast("bigint").alias("id"), *rest), next_id=None)
        if versions is not None:
            self.versions[name] = temporal.Versions(versions)
        elif self.config.versioning:
            self.begin_versions(name)
        return schema

    def begin_versions(self, name: str) -> None:
        """Let the nodes of a schema, as they are, be their first versions, valid from now on."""
        fields = [f.name for f in self.catalog.node(name).fields]
        self.versions[name] = temporal.Versions(temporal.first_versions(self.nodes[name].frame, fields, self.config.clock()))

    def _next_id(self, name: str) -> int:
        table = self.nodes[name]
        if table.next_id is None:
            highest = table.frame.agg(F.max("id")).first()[0]
            table.next_id = 0 if highest is None else highest + 1
        return table.next_id

    def use_edges(self, name: str, frame: DataFrame, source: str | None = None, target: str | None = None, unique: bool = False) -> EdgeType:
        """Let a DataFrame with source_id and target_id serve as an edge type; nothing is copied.

        Without an id column, of parallel edges the one with the highest hash of the properties looked at counts, and edges get
        ids when they are first changed.
        """
        rest = [c for c in frame.columns if c not in EDGE_FIELDS]
        edge = self.catalog.add_edge_type(name, frame.select(*rest).schema if rest else None, source, target, unique)
        whole = [F.col(c).cast("bigint").alias(c) if c in frame.columns else F.lit(None).cast("bigint").alias(c) for c in EDGE_FIELDS]
        self.edges[name] = Table(frame.select(*whole, *rest), numbered="id" in frame.columns)
        return edge

    def _numbered(self, name: str) -> None:
        """Give the edges of a type ids, if they have none."""
        table = self.edges[name]
        if not table.numbered:
            frame, n = mutate.with_dense_ids(table.frame.drop("id"), self._edge_ids)
            self._edge_ids += n
            table.frame, table.numbered, table.dirty = frame.select(*table.frame.columns), True, True

    def on_demand(self, name: str, load: Callable[[], object]) -> None:
        """Call load, which registers the schema or edge type of that name, when the name is first asked for."""
        self.catalog.loaders[name] = load

    # Tables

    def _flushed(self, table: Table, schema) -> DataFrame:
        if table.waiting:
            rows = self.spark.createDataFrame(table.waiting, schema)
            table.waiting = []
            self._store(table, table.frame.unionByName(rows))
        return table.frame

    def _store(self, table: Table, frame: DataFrame) -> None:
        table.changes += 1
        table.dirty = True
        table.frame = self._cut(frame) if table.changes % self.config.checkpoint_every == 0 else frame

    @staticmethod
    def _cut(frame: DataFrame) -> DataFrame:
        return write_once(frame)

    def node_frame(self, name: str, valid_time: int | None = None, tx_time: int | None = None) -> DataFrame:
        """The nodes of a schema: id and fields; as of times, if versions are kept."""
        schema = self.catalog.node(name)
        current = self._flushed(self.nodes[name], schema.spark)
        if (valid_time is None and tx_time is None) or name not in self.versions:
            return current
        return self.versions[name].as_of([f.name for f in schema.fields], valid_time, tx_time)

    def edge_frame(self, name: str, source: str | None = None, target: str | None = None) -> DataFrame:
        """The edges of a type; none, if it is declared between other schemas than those asked for."""
        edge = self.catalog.edge(name)
        if name not in self.edges:
            return self.spark.createDataFrame([], edge.spark)
        frame = self._flushed(self.edges[name], edge.spark)
        if source and edge.source and edge.source != source or target and edge.target and edge.target != target:
            return frame.filter(F.lit(False))
        return frame

    def scan(self, schema: str, valid_time: int | None = None, tx_time: int | None = None) -> DataFrame:
        """The nodes of a schema in order of id."""
        return self.node_frame(schema, valid_time, tx_time).orderBy("id")

    def chunks(self, schema: str) -> Iterator[list[Row]]:
        """The rows of a scan, chunk_size at a time; the driver holds one partition at most."""
        chunk: list[Row] = []
        for row in self.scan(schema).toLocalIterator():
            chunk.append(row)
            if len(chunk) == self.config.chunk_size:
                yield chunk
                chunk = []
        if chunk:
            yield chunk

    def scan_edges(self, type: str) -> DataFrame:
        """The edges of a type in order of id."""
        return self.edge_frame(type).orderBy("id", "source_id", "target_id")

    def column(self, schema: str, field: str) -> DataFrame:
        """(id, value) of a field where it is not null."""
        self.catalog.node(schema).field(field)
        return self.node_frame(schema).filter(F.col(field).isNotNull()).select("id", F.col(field).alias("value"))

    def iter_values(self, schema: str, field: str) -> Iterator:
        """The values of a field that are not null, in order of id; the driver holds one partition at most."""
        return (r["value"] for r in self.column(schema, field).orderBy("id").toLocalIterator())

    def column_values(self, schema: str, field: str) -> list:
        """The same as a list, so all of them come to the driver."""
        return list(self.iter_values(schema, field))

    def version_counts(self, schema: str) -> DataFrame:
        """(id, versions) of a schema whose versions are kept."""
        if schema not in self.versions:
            raise NotFound(f"no versions of {schema} are kept")
        return self.versions[schema].whole().groupBy("id").agg(F.count("*").alias("versions"))

    def version_at(self, schema: str, id: int, valid_time: int | None = None, tx_time: int | None = None) -> Row | None:
        """One node as of times; None where it is not visible."""
        return self.node_frame(schema, valid_time, tx_time).filter(F.col("id") == id).first()

    def get_node(self, schema: str, id: int):
        row = self.node_frame(schema).filter(F.col("id") == id).first()
        if row is None:
            raise NotFound(f"no {schema} {id}")
        return row

    def get_edge(self, type: str, id: int):
        row = self.edge_frame(type).filter(F.col("id") == id).first()
        if row is None:
            raise NotFound(f"no {type} edge {id}")
        return row

    def edges_of(self, type: str, ids: DataFrame) -> DataFrame:
        """The edges whose ids a table has."""
        return self.edge_frame(type).join(ids, "id", "left_semi")

    def outgoing(self, id: int, type: str) -> DataFrame:
        return self.edge_frame(type).filter(F.col("source_id") == id)

    def incoming(self, id: int, type: str) -> DataFrame:
        return self.edge_frame(type).filter(F.col("target_id") == id)

    def edge_types(self) -> DataFrame:
        """(type, count) of every edge type."""
        self.catalog.load_all()
        schema = "type string, count bigint"
        out = self.spark.createDataFrame([], schema)
        for name in sorted(self.edges):
            out = out.unionByName(self.edge_frame(name).agg(F.lit(name).alias("type"), F.count("*").alias("count")))
        return out

    # Creation

    def _row(self, schema: NodeSchema, values: dict[str, Any]) -> tuple:
        if "id" in values:
            raise Invalid("ids are given by the graph")
        for name in values:
            schema.field(name)
        out = []
        for f in schema.fields:
            value = values.get(f.name)
            if self.config.validation:
                if value is None and not f.nullable:
                    raise Invalid(f"{schema.name}.{f.name} is required")
                value = f.type.check(value)
            out.append(value)
        return tuple(out)

    def create_node(self, schema: str, **values: Any) -> int:
        """Add one node; it waits on the driver until the next read. For many, see create_nodes."""
        kind, table = self.catalog.node(schema), self.nodes.get(schema)
        row = self._row(kind, values)
        id = self._next_id(schema)
        table.next_id = id + 1
        table.waiting.append((id, *row))
        if self.config.versioning:
            self._versions_of(kind).waiting.append((id, 0, self.config.clock(), temporal.FOREVER, 0, temporal.FOREVER, *row))
        return id

    def _versions_of(self, kind: NodeSchema) -> temporal.Versions:
        if kind.name not in self.versions:
            none = self.spark.createDataFrame([], kind.spark)
            self.versions[kind.name] = temporal.Versions(temporal.first_versions(none, [f.name for f in kind.fields], 0))
        return self.versions[kind.name]

    def create_nodes(self, schema: str, rows: DataFrame) -> int:
        """Add many nodes; they are written once and get consecutive ids. Columns that the schema lacks are an error, fields left out are null."""
        kind, table = self.catalog.node(schema), self.nodes[schema]
        for c in rows.columns:
            if c == "id":
                raise Invalid("ids are given by the graph")
            kind.field(c)
        for f in kind.fields:
            if f.name in rows.columns and rows.schema[f.name].dataType != f.type.spark and self.config.validation and type(rows.schema[f.name].dataType) is not type(f.type.spark):
                raise TypeMismatch(f"{schema}.{f.name} is {f.type}, not {rows.schema[f.name].dataType.simpleString()}")
            if not f.nullable and self.config.validation and f.name not in rows.columns:
                raise Invalid(f"{schema}.{f.name} is required")
        full = rows.select(*(F.col(f.name).cast(f.type.spark).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.type.spark).alias(f.name) for f in kind.fields))
        first = self._next_id(schema)
        numbered, n = mutate.with_dense_ids(full, first)
        numbered = numbered.select(*kind.names)
        required = [f.name for f in kind.fields if not f.nullable]
        if required and n and self.config.validation:  # of what was written, so that rows run once
            missing = numbered.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in required)).first()
            if any(missing):
                raise Invalid(f"{schema}.{next(c for c in required if missing[c])} is required")
        table.next_id = first + n
        self._store(table, self._flushed(table, kind.spark).unionByName(numbered))
        if self.config.versioning:
            self._versions_of(kind).add(temporal.first_versions(numbered, [f.name for f in kind.fields], self.config.clock()))
        return n

    def connect(self, source_id: int, type: str, target_id: int, **properties: Any) -> int:
        """Add one edge, without a look at its ends."""
        edge = self.catalog.edge(type)
        if properties and edge.fields is None:
            raise Invalid(f"edge type {type} has no schema, so its edges have no properties")
        for name in properties:
            if name in EDGE_FIELDS:
                raise Invalid(f"{name} is given by the graph")
            edge.field(name)
        values = []
        for f in edge.fields or ():
            value = properties.get(f.name)
            if value is None and not f.nullable:
                raise Invalid(f"{type}.{f.name} is required")
            values.append(f.type.check(value))
        self.edges.setdefault(type, Table(self.spark.createDataFrame([], edge.spark)))
        id, self._edge_ids = self._edge_ids, self._edge_ids + 1
        self.edges[type].waiting.append((id, source_id, target_id, self.config.clock() // 1_000_000, *values))
        return id

    def connect_many(self, type: str, rows: DataFrame) -> int:
        """Add many edges from a table with source_id, target_id and properties; they are written once and get consecutive ids."""
        edge = self.catalog.edge(type)
        self.edges.setdefault(type, Table(self.spark.createDataFrame([], edge.spark)))
        for c in rows.columns:
            if c not in ("source_id", "target_id"):
                if edge.fields is None:
                    raise Invalid(f"edge type {type} has no schema, so its edges have no properties")
                edge.field(c)
        properties = [F.col(f.name).cast(f.type.spark).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.type.spark).alias(f.name) for f in edge.fields or ()]
        full = rows.select(F.col("source_id").cast("bigint").alias("source_id"), F.col("target_id").cast("bigint").alias("target_id"), F.lit(self.config.clock() // 1_000_000).cast("bigint").alias("created_ts"), *properties)
        numbered, n = mutate.with_dense_ids(full, self._edge_ids)
        self._edge_ids += n
        table = self.edges[type]
        self._store(table, self._flushed(table, edge.spark).unionByName(numbered.select(*edge.spark.names)))
        return n

    def connect_selected(self, type: str, source: tuple[str, Column], target: tuple[str, Column], unique: bool = False, **properties: Any) -> int:
        """Edges from every node that one selection picks to every node of the other; unique: one node on each side."""
        sides = [self.node_frame(schema).filter(picked).select("id") for schema, picked in (source, target)]
        counts = [s.limit(2).count() for s in sides] if unique else [s.limit(1).count() for s in sides]
        for (schema, _), n in zip((source, target), counts, strict=True):
            if not n:
                raise NotFound(f"no {schema} matches")
            if unique and n > 1:
                raise Invalid(f"more than one {schema} matches")
        edge = self.catalog.edge(type)
        # Every source with every target is what is asked for: its size is counted and said, and only a small side is broadcast.
        counts = [s.count() for s in sides]
        log.info("%s: %d sources x %d targets = %d edges", type, *counts, counts[0] * counts[1])
        ends = [s.select(F.col("id").alias(c)) for s, c in zip(sides, ("source_id", "target_id"), strict=True)]
        least = counts.index(min(counts))
        if counts[least] <= BROADCAST_NODES:
            ends[least] = F.broadcast(ends[least])
        pairs = ends[0].crossJoin(ends[1])
        for name, value in properties.items():
            kind = edge.field(name).type
            pairs = pairs.withColumn(name, self._literal(kind, kind.check(value)))
        return self.connect_many(type, pairs)

    def connect_json(self, type: str, rows: DataFrame, column: str = "properties") -> int:
        """Add many edges whose properties stand in a JSON object of a text column; names that the edge type lacks are left out."""
        edge = self.catalog.edge(type)
        ends = [F.col("source_id"), F.col("target_id")]
        return self.connect_many(type, rows.select(*ends, *(c.alias(f.name) for f, c in zip(edge.fields or (), maps.fields_from_json(F.col(column), edge.fields or ()), strict=True))))

    def edges_as_json(self, type: str) -> DataFrame:
        """(id, source_id, target_id, created_ts, properties): the properties of each edge as a JSON object; null ones are left out."""
        frame, fields = self.edge_frame(type), self.catalog.edge(type).fields or ()
        return frame.select(*EDGE_FIELDS, maps.fields_to_json(fields).alias("properties"))

    # Queries

    def query(self, query: GraphQuery | Query) -> Result:
        return Compiler(self, query.build() if isinstance(query, Query) else query).compile()

    # Updates

    @staticmethod
    def _literal(kind, value) -> Column:
        if kind.kind == "array":
            return arrays.array_literal(value, kind.spark)
        if kind.kind == "map":
            return maps.map_literal(value)
        return F.lit(value).cast(kind.spark)

    def _changes(self, kind: NodeSchema | EdgeType, assignments: Iterable[Assignment], append: bool) -> dict[str, Column]:
        """New values of columns; assignments to one map's keys build on each other."""
        out: dict[str, Column] = {}
        for a in assignments:
            type = kind.field(a.field).type
            if a.field == "id" or isinstance(kind, EdgeType) and a.field in EDGE_FIELDS:
                raise Invalid(f"{a.field} can't be changed")
            now = out.get(a.field, F.col(a.field))
            if a.deep:
                raise Unsupported(f"{a.field}.{a.key}: maps are set one level deep")
            if a.key is not None:
                if type.kind != "map":
                    raise TypeMismatch(f"{a.field} is no map")
                out[a.field] = maps.remove_key(now, a.key) if a.remove else maps.set_key(now, a.key, a.value)
            elif append:
                if type.kind != "array":
                    raise TypeMismatch(f"{a.field} is no array")
                values = type.check(a.value if isinstance(a.value, (list, tuple)) else [a.value])
                out[a.field] = arrays.append(now, values, type.spark)
            else:
                out[a.field] = self._literal(type, type.check(a.value))
        return out

    def _apply(self, schema: str, ids: DataFrame | Column, changes: dict[str, Column]) -> None:
        kind, table = self.catalog.node(schema), self.nodes[schema]
        frame = self._flushed(table, kind.spark)
        if self.config.versioning and schema in self.versions:
            changed = mutate.changed_rows(frame, ids, changes)
            self.versions[schema].change(changed, [f.name for f in kind.fields], self.config.clock(), self.config.checkpoint_every)
        self._store(table, mutate.update_rows(frame, ids, changes))

    def update_node(self, schema: str, id: int, field: str, value: Any, append: bool = False) -> UpdateResult:
        """Set one field of a node (field or map.key), or append to it."""
        update = Update.on(schema, id)
        return self.update(update.append(field, value) if append else update.set(field, value))

    def update_node_fields(self, schema: str, id: int, values: dict[str, Any], append: bool = False) -> UpdateResult:
        """Set several fields of a node, or append to them, as one change."""
        update = Update.on(schema, id)
        for name, value in values.items():
            update = update.append(name, value) if append else update.set(name, value)
        return self.update(update)

    def update(self, update: GraphUpdate | Update) -> UpdateResult:
        """Update one node by id, or what a pattern matches: each node and edge once, however many rows it stands in."""
        update = update.build() if isinstance(update, Update) else update
        if not update.assignments:
            raise Invalid("an update sets something")
        if update.query is None:
            kind = self.catalog.node(update.schema)
            for a in update.assignments:
                kind.field(a.field)
            try:
                changes = self._changes(kind, update.assignments, update.append)
                self.get_node(update.schema, update.id)
            except GraphError as error:
                return UpdateResult(0, 1, [str(error)])
            self._apply(update.schema, F.col("id") == update.id, changes)
            return UpdateResult(1)
        scope = Scope(self, update.query)
        by_alias: dict[str, list[Assignment]] = {}
        for a in update.assignments:
            scope.resolve(f"{a.alias}.{a.field}")
            by_alias.setdefault(a.alias, []).append(a)
        result, plans = UpdateResult(), []
        for alias, assignments in by_alias.items():
            kind = scope.nodes.get(alias) or scope.edges[alias]
            try:
                plans.append((alias, kind, self._changes(kind, assignments, update.append)))
            except GraphError as error:
                result.failed += 1
                result.errors.append(str(error))
        ids = {alias: self._matched_ids(update.query, alias, kind) for alias, kind, _ in plans}  # all before any change
        for alias, kind, changes in plans:
            n = ids[alias].count()
            if n and isinstance(kind, NodeSchema):
                self._apply(kind.name, ids[alias], changes)
            elif n:
                table = self.edges[kind.name]
                self._store(table, mutate.update_rows(self._flushed(table, kind.spark), ids[alias], changes))
            result.updated += n
        return result

    def _matched_ids(self, query: GraphQuery, alias: str, kind: NodeSchema | EdgeType) -> DataFrame:
        if isinstance(kind, NodeSchema):
            found = self.query(_selecting(query, f"{alias}.id")).df.select(F.col(f"`{alias}.id`").alias("id"))
            return self._cut(found.filter("id IS NOT NULL").distinct())
        # An edge is known by its ends here; of parallel ones the query sees the one with the highest id.
        self._numbered(kind.name)
        hop = next(c for c in query.clauses if getattr(c, "alias", None) == alias)
        ends = [f"{hop.source.alias}.id", f"{hop.target.alias}.id"]
        found = self.query(_selecting(query, *ends)).df.select(*(F.col(f"`{e}`").alias(c) for e, c in zip(ends, ("source_id", "target_id"), strict=True))).distinct()
        edges = self.edge_frame(kind.name)
        scope = Scope(self, query)
        renamed = edges.select("id", "source_id", "target_id", *(F.col(c).alias(f"{alias}.{c}") for c in edges.columns))
        for clause in query.clauses:
            if hasattr(clause, "expression") and clause.expression.aliases() == {alias}:
                renamed = renamed.filter(clause.expression.column(scope))
        best = renamed.join(found, ["source_id", "target_id"], "left_semi").groupBy("source_id", "target_id").agg(F.max("id").alias("id"))
        return self._cut(best.select("id"))

    # Deletion

    def delete_node(self, schema: str, id: int) -> None:
        """Remove one node; edges that end there stay, and lead nowhere."""
        self.get_node(schema, id)
        self._remove_nodes(schema, F.col("id") != id)

    def _remove_nodes(self, schema: str, keep: Column | DataFrame) -> None:
        table, kind = self.nodes[schema], self.catalog.node(schema)
        frame = self._flushed(table, kind.spark)
        self._store(table, frame.filter(keep) if isinstance(keep, Column) else frame.join(keep, "id", "left_anti"))
        if schema in self.versions:
            self.versions[schema].keep(lambda v: v.filter(keep) if isinstance(keep, Column) else v.join(keep, "id", "left_anti"))

    def delete_matched(self, query: GraphQuery | Query, aliases: Iterable[str] | None = None) -> int:
        """Remove the nodes that a pattern matches, of the aliases given or of its first."""
        query = query.build() if isinstance(query, Query) else query
        scope = Scope(self, query)
        found = {a: self._matched_ids(query, a, scope.nodes[a]) for a in aliases or [query.start.alias]}
        total = 0
        for alias, ids in found.items():
            n = ids.count()
            total += n
            if n:
                self._remove_nodes(scope.nodes[alias].name, ids)
        return total

    def delete_edges(self, type: str, source: tuple[str, Column] | None = None, target: tuple[str, Column] | None = None, id: int | None = None) -> int:
        """Remove edges of a type: all, by id, or from and to the nodes that selections pick."""
        frame = self.edge_frame(type)
        if type not in self.edges:
            return 0
        self._numbered(type)
        frame = self.edge_frame(type)
        gone = frame if id is None else frame.filter(F.col("id") == id)
        for side, picked in (("source_id", source), ("target_id", target)):
            if picked is not None:
                ends = self.node_frame(picked[0]).filter(picked[1]).select(F.col("id").alias(side))
                gone = gone.join(ends, side, "left_semi")
        gone = self._cut(gone.select("id").distinct())
        n = gone.count()
        if n:
            self._store(self.edges[type], frame.join(gone, "id", "left_anti"))
        return n

    # Shards

    def shards(self, schema: str) -> DataFrame:
        """(shard, count, min_id, max_id): nodes fill shards in order of id; compaction closes the gaps that deletes leave."""
        frame, table = self.node_frame(schema), self.nodes[schema]
        capacity = self.config.shard_capacity
        if table.bounds is None:
            runs = frame.groupBy(F.floor(F.col("id") / capacity).alias("shard"))
            return runs.agg(F.count("*").alias("count"), F.min("id").alias("min_id"), F.max("id").alias("max_id"))
        return mutate.shards(frame, table.bounds)

    def compact(self, schema: str) -> None:
        bounds = mutate.compact_bounds(self.node_frame(schema), self.config.shard_capacity)
        self.nodes[schema].bounds = bounds or None

    def compact_all(self) -> None:
        self.catalog.load_all()
        for schema in self.nodes:
            self.compact(schema)

    # Snapshots

    def commit(self) -> str:
        from .sources.snapshot import commit

        return commit(self)

    @classmethod
    def open(cls, spark: SparkSession, config: Config) -> Graph:
        from .sources.snapshot import restore

        return restore(spark, config)


def _selecting(query: GraphQuery, *paths: str) -> GraphQuery:
    from dataclasses import replace

    return replace(query, items=tuple(Item(p) for p in paths))
