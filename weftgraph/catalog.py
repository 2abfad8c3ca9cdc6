"""Node schemas and edge types."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import types as T

from .errors import AlreadyExists, Invalid, NotFound
from .types import FieldType

EDGE_FIELDS = ("id", "source_id", "target_id", "created_ts")


@dataclass(frozen=True)
class Field:
    name: str
    type: FieldType
    nullable: bool = True


def fields_of(spec) -> tuple[Field, ...]:
    """From a StructType, a dict of name to type text, or Fields."""
    if isinstance(spec, T.StructType):
        return tuple(Field(f.name, FieldType.of_spark(f.dataType), f.nullable) for f in spec)
    if isinstance(spec, dict):
        spec = [Field(k, v if isinstance(v, FieldType) else FieldType.parse(v.removesuffix("!")), not (isinstance(v, str) and v.endswith("!"))) for k, v in spec.items()]
    return tuple(spec)


@dataclass(frozen=True)
class NodeSchema:
    name: str
    fields: tuple[Field, ...]
    version: int = 0

    @property
    def names(self) -> tuple[str, ...]:
        return ("id", *(f.name for f in self.fields))

    def field(self, name: str) -> Field:
        if name == "id":
            return Field("id", FieldType("int64"), False)
        for f in self.fields:
            if f.name == name:
                return f
        raise NotFound(f"{self.name} has no field {name}")

    @property
    def spark(self) -> T.StructType:
        return T.StructType([T.StructField("id", T.LongType()), *(T.StructField(f.name, f.type.spark) for f in self.fields)])


@dataclass(frozen=True)
class EdgeType:
    """source and target name the node schemas that edges run between, where known; unique: no parallel edges."""

    name: str
    fields: tuple[Field, ...] | None = None  # None: no schema, so no properties and no alias
    source: str | None = None
    target: str | None = None
    unique: bool = False

    def field(self, name: str) -> Field:
        if name in EDGE_FIELDS:
            return Field(name, FieldType("int64"), False)
        for f in self.fields or ():
            if f.name == name:
                return f
        raise NotFound(f"edge type {self.name} has no field {name}")

    @property
    def spark(self) -> T.StructType:
        return T.StructType([*(T.StructField(c, T.LongType()) for c in EDGE_FIELDS), *(T.StructField(f.name, f.type.spark) for f in self.fields or ())])


@dataclass
class Catalog:
    nodes: dict[str, NodeSchema] = field(default_factory=dict)
    edges: dict[str, EdgeType] = field(default_factory=dict)
    #: What registers a schema or edge type when it is first asked for.
    loaders: dict[str, Callable[[], object]] = field(default_factory=dict)

    def load(self, name: str) -> None:
        if load := self.loaders.pop(name, None):
            load()

    def load_all(self) -> None:
        for name in list(self.loaders):
            self.load(name)

    def add_node_schema(self, name: str, spec) -> NodeSchema:
        """Register a node schema; a name that is taken keeps what it has."""
        fields = fields_of(spec)
        if any(f.name == "id" for f in fields):
            raise Invalid("id is added to every schema")
        if len({f.name for f in fields}) < len(fields):
            raise Invalid("a field name stands twice")
        return self.nodes.setdefault(name, NodeSchema(name, fields))

    def add_edge_type(self, name: str, spec=None, source: str | None = None, target: str | None = None, unique: bool = False) -> EdgeType:
        if name in self.edges and self.edges[name].fields is not None:
            raise AlreadyExists(f"edge type {name} has a schema")
        fields = None if spec is None else fields_of(spec)
        if fields and any(f.name in EDGE_FIELDS for f in fields):
            raise Invalid(f"{', '.join(EDGE_FIELDS)} are part of every edge")
        self.edges[name] = EdgeType(name, fields, source, target, unique)
        return self.edges[name]

    def node(self, name: str) -> NodeSchema:
        self.load(name)
        if name not in self.nodes:
            raise NotFound(f"no node schema {name}")
        return self.nodes[name]

    def edge(self, name: str) -> EdgeType:
        """An edge type nobody registered has no schema."""
        self.load(name)
        return self.edges.get(name) or EdgeType(name)
