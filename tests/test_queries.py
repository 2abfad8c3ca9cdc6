import pytest

import __spark_entry__ as entry
from tests.oracle import compare
from weftgraph.cli import completions, main
from weftgraph.graph import Graph
from weftgraph.queries import QUERIES, SQL


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert QUERIES.keys() == SQL.keys() and QUERIES.keys() <= entry.queries().keys() and entry.oracle_sql().keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name])


def test_command_line(spark, tmp_path, capsys):
    script = tmp_path / "s.txt"
    script.write_text('CREATE SCHEMA U (name: STRING);\nCREATE NODE U (name = "Ann");\nMATCH (u:U);\nCOMMIT;\nNONSENSE;\n')
    output = tmp_path / "out"
    assert main(["--script", str(script), "--db-path", str(tmp_path / "db"), "--output", str(output), "--batch"]) == 1
    assert '"Ann"' in capsys.readouterr().out and "4 executed, 1 failed" in output.read_text()


def test_completion(spark):
    graph = Graph(spark)
    graph.create_schema("Member", {"nickname": "string"})
    graph.create_edge_schema("MEETS", {"minutes": "int64"})
    assert completions(graph, "M") == ["MATCH", "MEETS", "Member"] and completions(graph, "ni") == ["nickname"] and completions(graph, "mi") == ["minutes"] and completions(graph, "zz") == []
