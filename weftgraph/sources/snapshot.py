"""Snapshots: Parquet tables and JSON manifests, under any path that Spark can write.

A commit writes the tables that changed since the last one, then a manifest with all tables' places, then the metadata, and last
db_info.json, which names the current metadata; until that file is replaced, readers see the snapshot before.
"""

from __future__ import annotations

import json
import time
import uuid
from typing import TYPE_CHECKING

from pyspark.sql import SparkSession

from ..catalog import EdgeType, Field, NodeSchema
from ..errors import Invalid, NotFound
from ..types import FieldType

if TYPE_CHECKING:
    from ..graph import Config, Graph

INFO = "db_info.json"


class Files:
    """Small text files by way of Hadoop, so that they lie where the tables lie."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._charset = spark._jvm.java.nio.charset.StandardCharsets.UTF_8
        self._io = spark._jvm.org.apache.hadoop.io.IOUtils
        self._buffer = spark._jvm.java.io.ByteArrayOutputStream
        self.system = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._conf = spark._jsc.hadoopConfiguration()
        gateway = spark.sparkContext._gateway
        self._overwrite = gateway.new_array(getattr(gateway.jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        self._overwrite[0] = getattr(gateway.jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        self._context = gateway.jvm.org.apache.hadoop.fs.FileContext
        self._scheme = self.system.getUri().getScheme()
        if self._scheme == "file":  # without checksum files beside, so that one rename is all
            self.system = gateway.jvm.org.apache.hadoop.fs.RawLocalFileSystem()
            self.system.initialize(gateway.jvm.java.net.URI("file:///"), self._conf)

    def read(self, name: str) -> dict | None:
        path = self._path(f"{self.root}/{name}")
        if not self.system.exists(path):
            return None
        source, out = self.system.open(path), self._buffer()
        self._io.copyBytes(source, out, 4096, True)
        return json.loads(out.toString(self._charset))

    def write(self, name: str, content: dict) -> None:
        """Put the file in place in one step: readers find the one before or this one, whole, whatever fails in between.

        File systems with a rename get it written beside and then renamed over; object stores show a file when it is complete.
        """
        path, beside = self._path(f"{self.root}/{name}"), self._path(f"{self.root}/{name}.new")
        scheme = self._scheme
        renames = scheme in ("file", "hdfs", "viewfs")
        stream = self.system.create(beside if renames else path, True)
        stream.write(bytearray(json.dumps(content, indent=1).encode()))
        stream.close()
        if scheme == "file":
            self.system.rename(beside, path)  # rename(2), which replaces
        elif renames:
            self._context.getFileContext(path.toUri(), self._conf).rename(beside, path, self._overwrite)


def _fields_out(fields) -> list | None:
    return None if fields is None else [[f.name, str(f.type), f.nullable] for f in fields]


def _fields_in(fields) -> tuple[Field, ...] | None:
    return None if fields is None else tuple(Field(n, FieldType.parse(t), nullable) for n, t, nullable in fields)


def commit(graph: Graph) -> str:
    """Write a snapshot and return its id. Versions are not part of it."""
    config = graph.config
    if not config.path:
        raise Invalid("the graph has no path")
    files = Files(graph.spark, config.path)
    info = files.read(INFO) or {"snapshots": []}
    parent = info.get("current")
    graph.compact_all()
    entries: dict[str, dict] = {"nodes": {}, "edges": {}}
    for kind, tables in (("nodes", graph.nodes), ("edges", graph.edges)):
        for name, table in tables.items():
            spark_schema = (graph.catalog.node(name) if kind == "nodes" else graph.catalog.edge(name)).spark
            frame = graph._flushed(table, spark_schema)
            if table.dirty or table.saved is None:
                folder = f"data/{name if kind == 'nodes' else f'edges/{name}'}/{uuid.uuid4().hex}.parquet"
                writer = frame.write.option("compression", "snappy").option("maxRecordsPerFile", config.shard_capacity)
                writer.parquet(f"{files.root}/{folder}")
                table.saved, table.dirty = folder, False
                table.frame = graph.spark.read.schema(spark_schema).parquet(f"{files.root}/{folder}")
            entries[kind][name] = {"path": table.saved, "next_id": table.next_id, "bounds": table.bounds, "numbered": table.numbered}
    snapshot = uuid.uuid4().hex
    schemas = {
        "nodes": {n: {"fields": _fields_out(s.fields), "version": s.version} for n, s in graph.catalog.nodes.items()},
        "edges": {n: {"fields": _fields_out(e.fields), "source": e.source, "target": e.target, "unique": e.unique} for n, e in graph.catalog.edges.items()},
    }
    files.write(f"manifests/{snapshot}.manifest.json", entries | {"edge_ids": graph._edge_ids})
    files.write(f"metadata/{snapshot}.metadata.json", {"id": snapshot, "parent": parent, "manifest": f"manifests/{snapshot}.manifest.json", "created_ms": time.time_ns() // 1_000_000, "schemas": schemas})
    files.write(INFO, {"current": snapshot, "snapshots": [*info["snapshots"], snapshot]})
    return snapshot


def restore(spark: SparkSession, config: Config, snapshot: str | None = None) -> Graph:
    """The graph of the current snapshot (or of the one named); an empty one, if there is none. Tables are read on use.

    Versions, where they are kept, begin anew: the nodes as restored are valid from now on.
    """
    from ..graph import Graph, Table

    graph = Graph(spark, config)
    files = Files(spark, config.path)
    info = files.read(INFO)
    if info is None:
        return graph
    snapshot = snapshot or info["current"]
    metadata = files.read(f"metadata/{snapshot}.metadata.json")
    if metadata is None:
        raise NotFound(f"no snapshot {snapshot}")
    manifest = files.read(metadata["manifest"])
    for name, s in metadata["schemas"]["nodes"].items():
        graph.catalog.nodes[name] = NodeSchema(name, _fields_in(s["fields"]), s["version"])
    for name, e in metadata["schemas"]["edges"].items():
        graph.catalog.edges[name] = EdgeType(name, _fields_in(e["fields"]), e["source"], e["target"], e["unique"])
    for kind, tables in (("nodes", graph.nodes), ("edges", graph.edges)):
        for name, entry in manifest[kind].items():
            schema = (graph.catalog.node(name) if kind == "nodes" else graph.catalog.edge(name)).spark
            frame = spark.read.schema(schema).parquet(f"{files.root}/{entry['path']}")
            tables[name] = Table(frame, dirty=False, next_id=entry["next_id"], saved=entry["path"], bounds=entry["bounds"], numbered=entry.get("numbered", True))
    graph._edge_ids = manifest["edge_ids"]
    if config.versioning:
        for name in graph.nodes:
            graph.begin_versions(name)
    return graph


def snapshots(spark: SparkSession, path: str) -> list[str]:
    return (Files(spark, path).read(INFO) or {"snapshots": []})["snapshots"]
