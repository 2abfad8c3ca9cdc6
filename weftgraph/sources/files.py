"""Nodes and edges from CSV and Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import Graph


def read_csv(graph: Graph, path: str, schema: T.StructType | str) -> DataFrame:
    return graph.spark.read.csv(path, header=True, schema=schema)


def nodes_from_csv(graph: Graph, name: str, path: str, schema: T.StructType | str, id_column: str = "id") -> None:
    """A CSV file with a header as the nodes of a schema, under the ids it has."""
    rows = read_csv(graph, path, schema)
    graph.use_nodes(name, rows.withColumnRenamed(id_column, "id"))


def edges_from_csv(graph: Graph, name: str, path: str, schema: T.StructType | str, source: str, target: str, source_column: str = "src", target_column: str = "dst") -> None:
    rows = read_csv(graph, path, schema)
    graph.use_edges(name, rows.withColumnsRenamed({source_column: "source_id", target_column: "target_id"}), source, target)


def nodes_from_parquet(graph: Graph, name: str, path: str, id_column: str = "id") -> None:
    graph.use_nodes(name, graph.spark.read.parquet(path).withColumnRenamed(id_column, "id"))


def edges_from_parquet(graph: Graph, name: str, path: str, source_column: str, target_column: str, source: str | None = None, target: str | None = None) -> None:
    rows = graph.spark.read.parquet(path)
    graph.use_edges(name, rows.withColumn("source_id", F.col(source_column)).withColumn("target_id", F.col(target_column)).drop(source_column, target_column), source, target)
