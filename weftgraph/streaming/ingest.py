"""Nodes and edges from streams: each micro-batch is one bulk load."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..graph import Graph


def stream_nodes(graph: Graph, schema: str, rows: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream of rows with a schema's fields. A batch is written once, so queries don't go back to the stream."""
    return _start(rows, checkpoint, lambda batch: graph.create_nodes(schema, batch), trigger)


def stream_edges(graph: Graph, type: str, rows: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    return _start(rows, checkpoint, lambda batch: graph.connect_many(type, batch), trigger)


def _start(rows: DataFrame, checkpoint: str, load, trigger: dict) -> StreamingQuery:
    seen: set[int] = set()

    def batch(df: DataFrame, number: int) -> None:
        if number not in seen:  # a batch that is tried again is loaded once
            load(df)
            seen.add(number)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
