"""Command line: ``python -m weftgraph.cli --script FILE`` or statements from standard input.

At a terminal, statements can be edited, are kept in a history file, and the tabulator completes keywords and the names of schemas,
edge types and fields.
"""

from __future__ import annotations

import argparse
import logging
import os
import sys
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

from .graph import Config, Graph
from .lang.runner import run_script, statements


KEYWORDS = (
    "MATCH", "WHERE", "AND", "OR", "SELECT", "AS", "INNER", "LEFT", "RIGHT", "FULL", "CREATE", "SCHEMA", "NODE", "EDGE", "UNIQUE", "FROM", "TO", "WITH",
    "RETURN", "UPDATE", "SET", "DELETE", "SHOW", "EDGES", "TYPES", "COMMIT", "CONTAINS", "STARTS_WITH", "ENDS_WITH",
)


def completions(graph: Graph, text: str) -> list[str]:
    """Keywords and names of the graph that begin with text."""
    known = {*KEYWORDS, *graph.catalog.nodes, *graph.catalog.edges, *(f.name for kind in (*graph.catalog.nodes.values(), *graph.catalog.edges.values()) for f in kind.fields or ())}
    return sorted(w for w in known if w.startswith(text))


def lines(graph: Graph, history: str) -> Iterator[str]:
    """Lines from a terminal with history and completion, or from standard input as they are."""
    if not sys.stdin.isatty():
        yield from sys.stdin
        return
    try:
        import readline
    except ImportError:
        readline = None
    if readline is not None:
        if os.path.exists(history):
            readline.read_history_file(history)
        readline.set_completer(lambda text, n: [*completions(graph, text), None][n])
        readline.parse_and_bind("tab: complete")
    try:
        while True:
            yield input("weftgraph> ") + "\n"
    except EOFError:
        return
    finally:
        if readline is not None:
            readline.write_history_file(history)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="weftgraph", description=__doc__)
    parser.add_argument("--db-path", default="weft-db", help="where snapshots lie")
    parser.add_argument("--script", help="a file of statements")
    parser.add_argument("--output", help="a file that gets what is printed as well")
    parser.add_argument("--unique-db", "--temp-db", action="store_true", help="use a new path under the one given")
    parser.add_argument("--detach", "--batch", action="store_true", help="don't go on with standard input after a script")
    parser.add_argument("--history", default=os.path.expanduser("~/.weftgraph_history"), help="where statements typed are kept")
    parser.add_argument("--log-level", default="WARNING", choices=["DEBUG", "INFO", "WARNING", "ERROR"])
    parser.add_argument("--debug", action="store_true", help="the same as --log-level DEBUG")
    got = parser.parse_args(args)
    logging.basicConfig(level=logging.DEBUG if got.debug else got.log_level)
    logging.getLogger("weftgraph").setLevel(logging.DEBUG if got.debug else got.log_level)
    path = f"{got.db_path}/{uuid.uuid4().hex}" if got.unique_db else got.db_path
    spark = SparkSession.builder.appName("weftgraph").getOrCreate()
    graph = Graph.open(spark, Config(path=path))
    tee = open(got.output, "w") if got.output else None

    def write(text: str) -> None:
        print(text)
        if tee:
            print(text, file=tee)

    failed = 0
    if got.script:
        with open(got.script) as f:
            done = run_script(graph, f.read(), write)
        write(f"{done.executed} executed, {done.failed} failed")
        failed = done.failed
    if not got.script or not got.detach and sys.stdin.isatty():
        waiting = ""
        for line in lines(graph, got.history):
            waiting += line
            if line.rstrip().endswith(";"):
                for one in statements(waiting):
                    failed += run_script(graph, one, write).failed
                waiting = ""
    if tee:
        tee.close()
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
