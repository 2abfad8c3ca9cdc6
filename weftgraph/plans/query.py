"""Pattern queries and updates as data, and their fluent builders."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from ..errors import Invalid
from .expressions import Both, Expression, compare

JOINS = ("INNER", "LEFT", "RIGHT", "FULL")


@dataclass(frozen=True)
class Node:
    """An alias, and the schema it stands for where that is said."""

    alias: str
    schema: str | None = None

    @classmethod
    def parse(cls, text: str | Node) -> Node:
        if isinstance(text, Node):
            return text
        alias, _, schema = (x.strip() for x in text.partition(":"))
        if not alias:
            raise Invalid(f"{text!r} has no alias")
        return cls(alias, schema or None)


@dataclass(frozen=True)
class Where:
    expression: Expression
    inlined: bool = False

    def __str__(self) -> str:
        return f"WHERE {self.expression}" + " (inlined)" * self.inlined


@dataclass(frozen=True)
class Traverse:
    source: Node
    type: str
    target: Node
    join: str = "INNER"
    alias: str | None = None

    def __str__(self) -> str:
        return f"TRAVERSE ({self.source.alias})-[{self.alias or ''}:{self.type} {self.join}]->({self.target.alias})"


@dataclass(frozen=True)
class Item:
    """One entry of SELECT: an alias, alias.field or alias.map.key; renamed; for a key, the type wanted."""

    path: str
    name: str | None = None
    kind: str | None = None


@dataclass(frozen=True)
class GraphQuery:
    start: Node
    clauses: tuple[Where | Traverse, ...] = ()
    items: tuple[Item, ...] | None = None
    inline: bool = False
    valid_time: int | None = None
    tx_time: int | None = None
    mode: str = "compat"

    def __str__(self) -> str:
        tail = [] if self.items is None else ["SELECT " + ", ".join(i.path for i in self.items)]
        return "\n".join([f"FROM {self.start.alias}:{self.start.schema or self.start.alias}", *map(str, self.clauses), *tail])


class Query:
    """Builder: ``Query.match("u:User").where("u.age", ">", 30).traverse("u", "KNOWS", "f:User").select("u.name").build()``."""

    def __init__(self, start: str | Node):
        self._query = GraphQuery(Node.parse(start))

    @classmethod
    def match(cls, start: str | Node) -> Query:
        return cls(start)

    def _with(self, **changes: Any) -> Query:
        self._query = replace(self._query, **changes)
        return self

    def _add(self, clause: Where | Traverse) -> Query:
        return self._with(clauses=(*self._query.clauses, clause))

    def where(self, path: str | Expression, op: str | None = None, value: Any = None) -> Query:
        return self._add(Where(path if isinstance(path, Expression) else compare(path, op, value)))

    def _fold(self, kind: str, path: str | Expression, op: str | None, value: Any) -> Query:
        """Joins onto the last WHERE, left to right: a OR b AND c is (a OR b) AND c."""
        clauses = self._query.clauses
        if not clauses or not isinstance(clauses[-1], Where):
            raise Invalid(f"{kind} follows a WHERE")
        right = path if isinstance(path, Expression) else compare(path, op, value)
        return self._with(clauses=(*clauses[:-1], Where(Both(kind, clauses[-1].expression, right))))

    def and_where(self, path: str | Expression, op: str | None = None, value: Any = None) -> Query:
        return self._fold("AND", path, op, value)

    def or_where(self, path: str | Expression, op: str | None = None, value: Any = None) -> Query:
        return self._fold("OR", path, op, value)

    def traverse(self, source: str | Node, type: str, target: str | Node, join: str = "INNER", alias: str | None = None) -> Query:
        join = join.upper()
        if join not in JOINS:
            raise Invalid(f"unknown join {join}")
        return self._add(Traverse(Node.parse(source), type, Node.parse(target), join, alias))

    def select(self, *items: str | Item | Iterable[str | Item]) -> Query:
        flat = [x for i in items for x in ([i] if isinstance(i, (str, Item)) else i)]
        return self._with(items=tuple(x if isinstance(x, Item) else Item(x) for x in flat))

    def inline_where(self) -> Query:
        """Predicates on a traversed alias decide which edges match, as ON does, instead of filtering what matched."""
        return self._with(inline=True)

    def as_of_valid_time(self, ns: int) -> Query:
        return self._with(valid_time=ns)

    def as_of_tx_time(self, ns: int) -> Query:
        return self._with(tx_time=ns)

    def as_of(self, valid_ns: int, tx_ns: int) -> Query:
        return self._with(valid_time=valid_ns, tx_time=tx_ns)

    def mode(self, mode: str) -> Query:
        if mode not in ("compat", "ansi"):
            raise Invalid(f"unknown mode {mode}")
        return self._with(mode=mode)

    def parallel(self, *_: Any) -> Query:
        """Accepted and without effect: Spark decides on parallelism. Likewise the two below."""
        return self

    parallel_batch_size = parallel_thread_count = parallel

    def build(self) -> GraphQuery:
        return self._query


@dataclass(frozen=True)
class Assignment:
    """alias is None for an update by id; key for one entry of a map."""

    alias: str | None
    field: str
    value: Any
    key: str | None = None
    deep: bool = False
    remove: bool = False  # the key is removed


@dataclass(frozen=True)
class GraphUpdate:
    schema: str | None = None
    id: int | None = None
    query: GraphQuery | None = None
    assignments: tuple[Assignment, ...] = ()
    append: bool = False


@dataclass
class UpdateResult:
    updated: int = 0
    failed: int = 0
    errors: list[str] = field(default_factory=list)


class Update:
    """Builder: ``Update.on("User", 0).set("age", 31)`` or ``Update.match(query).set("u.age", 31)``."""

    def __init__(self, update: GraphUpdate):
        self._update = update

    @classmethod
    def on(cls, schema: str, id: int) -> Update:
        return cls(GraphUpdate(schema, id))

    @classmethod
    def match(cls, query: GraphQuery | Query) -> Update:
        return cls(GraphUpdate(query=query.build() if isinstance(query, Query) else query))

    def set(self, path: str, value: Any) -> Update:
        parts = path.split(".")
        alias = None
        if self._update.query is not None:
            if len(parts) < 2:
                raise Invalid(f"SET {path}: an update by pattern names alias.field")
            alias, *parts = parts
        new = Assignment(alias, parts[0], value, parts[1] if len(parts) > 1 else None, len(parts) > 2)
        self._update = replace(self._update, assignments=(*self._update.assignments, new))
        return self

    def append(self, path: str, value: Any) -> Update:
        """Appends to arrays; the kind of update holds for all assignments."""
        self._update = replace(self._update, append=True)
        return self.set(path, value)

    def remove(self, path: str) -> Update:
        """Removes a key of a map."""
        last = self.set(path, None)._update.assignments[-1]
        if last.key is None:
            raise Invalid(f"{path} names no key of a map")
        self._update = replace(self._update, assignments=(*self._update.assignments[:-1], replace(last, remove=True)))
        return self

    def build(self) -> GraphUpdate:
        return self._update
