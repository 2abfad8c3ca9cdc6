import pytest

from tests.graphs import rows, workers
from weftgraph.errors import GraphError, Invalid, ParseError
from weftgraph.graph import Config, Graph
from weftgraph.lang import parser as p
from weftgraph.lang.runner import execute, run_script, statements
from weftgraph.plans.compiler import Result, Stats
from weftgraph.plans.query import Node, Traverse


def got(df, *paths):
    return rows(Result(df, Stats()), *paths)


def test_patterns():
    s = p.parse('MATCH (a:User)-[e:KNOWS LEFT]->(b:User)<-[:MADE]-(c:Thing), (a)-[:LIKES]->(c) WHERE a.id = 1 AND (b.x >= 2.5 OR b.y <> "q") SELECT a, b.name AS n; // done')
    hops = [c for c in s.query.clauses if isinstance(c, Traverse)]
    assert hops[0] == Traverse(Node("a", "User"), "KNOWS", Node("b", "User"), "LEFT", "e")
    assert hops[1] == Traverse(Node("c", "Thing"), "MADE", Node("b", "User"))
    assert hops[2].source.alias == "a" and hops[2].target == Node("c")
    assert str(s.query.clauses[-1]) == 'WHERE (a.id = 1) AND ((b.x >= 2.5) OR (b.y != "q"))'
    assert [(i.path, i.name) for i in s.query.items] == [("a", None), ("b.name", "n")]


def test_precedence_and_negative_numbers():
    where = p.parse("MATCH (u:User) WHERE u.a = 1 OR u.b = 2 AND u.c = -3;").query.clauses[-1]
    assert str(where.expression) == "(u.a = 1) OR ((u.b = 2) AND (u.c = -3))"


@pytest.mark.parametrize("text", ["MATCH (u:User)", "MATCH u;", "SELECT 1;", "MATCH (u:User) WHERE u.a;", "CREATE NODE U (a);", "MATCH (u:User)-[K]->(v);", 'MATCH (u:User) WHERE u.a = "x;', "COMMIT; COMMIT;", "CREATE EDGE K FROM User() TO User(1);", "MATCH (u:User) WHERE u.a = 1 AND;"])
def test_bad_statements(text):
    with pytest.raises(ParseError):
        p.parse(text)


def test_statements_of_a_script():
    assert statements("-- note\nCREATE SCHEMA A\n (x: STRING);\n\n// more\nCOMMIT; // end\nSHOW EDGE TYPES;") == ["CREATE SCHEMA A\n (x: STRING);", "COMMIT; // end", "SHOW EDGE TYPES;"]


def test_run(spark, tmp_path):
    graph = Graph(spark, Config(path=str(tmp_path / "db")))
    said = []
    script = """
-- people
CREATE SCHEMA User (name: STRING, age: INT64, props: MAP);
CREATE SCHEMA Company (name: STRING, size: FLOAT64);
CREATE EDGE SCHEMA WORKS_AT (since: INT64);
CREATE NODE User (name = "Ann", age = 30) RETURN id;
CREATE NODE User (name: "Bob", age: 25);
CREATE NODE User (name = "Cid", age = 41);
CREATE NODE Company (name = "Acme", size = 1.5);
CREATE NODE Company (name = "Globex", size = 2.0);
CREATE UNIQUE EDGE WORKS_AT FROM (User{name="Ann"}) TO Company(0) WITH (since = 2020);
CREATE EDGE WORKS_AT FROM User(1) TO (Company{size = 2});
CREATE UNIQUE EDGE WORKS_AT FROM (User{name="Nobody"}) TO Company(0);
CREATE NODE User (name = "Dan");
NONSENSE;
UPDATE User(0) SET age = 31, props = {k: 1, s: "x"};
UPDATE User(0) SET props.k = 2;
UPDATE MATCH (u:User)-[e:WORKS_AT]->(c:Company) SET u.age = 50, e.since = 2000 WHERE c.name = "Globex";
SHOW EDGE TYPES;
SHOW EDGES WORKS_AT;
COMMIT;
"""
    done = run_script(graph, script, said.append)
    assert (done.executed, done.failed) == (16, 3)
    assert sum(s.startswith("Error") for s in said) == 3
    match = "MATCH (u:User)-[e:WORKS_AT LEFT]->(c:Company) SELECT u.name, u.age, c.name, e.since;"
    assert got(execute(graph, match)) == sorted([("Ann", 31, "Acme", 2020), ("Bob", 50, "Globex", 2000), ("Cid", 41, None, None)], key=repr)
    assert got(execute(graph, 'MATCH (u:User) WHERE u.props.k = 2 SELECT u.name;')) == [("Ann",)]
    assert execute(graph, "DELETE EDGE WORKS_AT FROM (User{name=\"Bob\"});") == 1
    assert execute(graph, "DELETE EDGE WORKS_AT TO Company(0);") == 1
    assert execute(graph, "DELETE (u:User) WHERE u.age > 40;") == 2
    assert execute(graph, "DELETE User(0);") == 1
    assert got(execute(graph, "MATCH (User);")) == []
    assert Graph.open(spark, graph.config).node_frame("User").count() == 3


def test_delete_by_path(spark):
    graph = workers(spark)
    assert execute(graph, 'DELETE (u:User)-[:WORKS_AT]->(c:Company) WHERE c.name = "TechCorp";') == 3
    assert graph.node_frame("User").count() == 8 and graph.node_frame("Company").count() == 2


def test_errors_in_statements(spark):
    graph = workers(spark)
    for text in ("MATCH (u:Nobody);", "MATCH (u:User) WHERE u.x = 1;", 'MATCH (u:User) WHERE u.age = "x";', "UPDATE (u:User) SET age = 1;", "DELETE User(99);", "CREATE NODE User (name = 1, age = 1, city = \"a\", salary = 1);", "MATCH (u:User) SELECT u.nothing;"):
        with pytest.raises(GraphError):
            execute(graph, text)
    with pytest.raises(Invalid):
        execute(graph, "CREATE UNIQUE EDGE K FROM (User{city=\"NYC\"}) TO Company(0);")


def test_streams(spark, tmp_path):
    from weftgraph.streaming.ingest import stream_edges, stream_nodes

    graph = Graph(spark)
    graph.create_schema("U", {"name": "string"})
    spark.createDataFrame([("a",), ("b",)], "name string").write.parquet(str(tmp_path / "n"))
    stream_nodes(graph, "U", spark.readStream.schema("name string").parquet(str(tmp_path / "n")), str(tmp_path / "c1")).awaitTermination(120)
    spark.createDataFrame([(0, 1)], "source_id long, target_id long").write.parquet(str(tmp_path / "e"))
    stream_edges(graph, "K", spark.readStream.schema("source_id long, target_id long").parquet(str(tmp_path / "e")), str(tmp_path / "c2")).awaitTermination(120)
    assert graph.node_frame("U").count() == 2 and graph.edge_frame("K").count() == 1


def test_csv(spark, tmp_path):
    from weftgraph.plans.query import Query
    from weftgraph.sources.files import edges_from_csv, nodes_from_csv

    (tmp_path / "u.csv").write_text("id,name,age\n0,a,1\n1,b,2\n")
    (tmp_path / "f.csv").write_text("src,dst\n0,1\n")
    graph = Graph(spark)
    nodes_from_csv(graph, "U", str(tmp_path / "u.csv"), "id long, name string, age long")
    edges_from_csv(graph, "F", str(tmp_path / "f.csv"), "src long, dst long", "U", "U")
    assert rows(graph.query(Query.match("u:U").traverse("u", "F", "v:U").select("u.name", "v.name"))) == [("a", "b")]
