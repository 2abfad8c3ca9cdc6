import operator

import pytest

from tests.graphs import rows, workers
from weftgraph.errors import Invalid, NotFound, TypeMismatch
from weftgraph.functions import maps
from weftgraph.graph import Graph
from weftgraph.lang.runner import execute
from weftgraph.plans.expressions import Comparison, Path
from weftgraph.plans.query import Item, Query, Where
from weftgraph.types import TAGS, tagged


@pytest.fixture(scope="module")
def graph(spark):
    return workers(spark)


def count(graph, query):
    return graph.query(query).df.count()


def test_comparisons_and_logic(graph):
    start = lambda: Query.match("u:User")
    age, city, pay = Comparison("u.age", ">", 40), Comparison("u.city", "=", "NYC"), Comparison("u.salary", ">", 100000)
    assert count(graph, start().where(age)) == 4
    assert count(graph, start().where(Comparison("u.age", ">", 30) & city)) == 3
    assert count(graph, start().where((city | Comparison("u.city", "=", "SF")) & pay)) == 4
    assert count(graph, start().where("u.city", "=", "NYC").or_where("u.city", "=", "SF").and_where("u.salary", ">", 100000)) == 4
    assert count(graph, start().where(city | (Comparison("u.city", "=", "SF") & pay))) == 5


def test_text_operators(graph):
    for op, value, want in (("CONTAINS", "ar", 1), ("STARTS_WITH", "H", 1), ("ENDS_WITH", "e", 5)):
        assert count(graph, Query.match("u:User").where("u.name", op, value)) == {"CONTAINS": 1, "STARTS_WITH": 1, "ENDS_WITH": 4}.get(op, want)


def test_stats(graph):
    got = graph.query(Query.match("u:User").where("u.age", ">", 35).traverse("u", "WORKS_AT", "c:Company").select("u.age", "u.city", "c.size").inline_where())
    assert got.df.count() == 1 and (got.stats.where_inlined, got.stats.where_post_processed) == (1, 0)
    got = graph.query(Query.match("u:User").traverse("u", "WORKS_AT", "c:Company").where("u.age", ">=", 35).and_where("c.size", ">", 1000))
    assert got.df.count() == 1 and (got.stats.where_inlined, got.stats.where_post_processed) == (0, 1)
    query = Query.match("u:User").where("u.age", ">=", 35).traverse("u", "WORKS_AT", "c:Company").where("c.size", ">", 1000).traverse("c", "EMPLOYS", "u2:User").where("u2.city", "=", "NYC").and_where("u.city", "=", "LA").inline_where()
    got = graph.query(query)
    assert got.df.count() == 0 and (got.stats.where_inlined, got.stats.where_post_processed) == (2, 1)


def test_pushed_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "u.parquet")
    spark.range(100).selectExpr("id", "id % 7 AS age", "'x' AS name").write.parquet(path)
    graph = Graph(spark)
    graph.use_nodes("User", spark.read.parquet(path))
    plan = graph.query(Query.match("u:User").where("u.age", ">", 3).select("u.id")).df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(age,3)" in plan and "name" not in plan.split("ReadSchema")[1]


def test_nulls(spark):
    graph = Graph(spark)
    graph.create_schema("U", {"name": "string", "age": "int32"})
    for name, age in (("a", 1), (None, 2), ("b", None)):
        graph.create_node("U", name=name, age=age)
    names = lambda q: {r[0] for r in rows(graph.query(q.select("u.id")))}
    assert names(Query.match("u:U").where("u.name", "=", None)) == {1}
    assert names(Query.match("u:U").where("u.name", "!=", None)) == {0, 2}
    assert names(Query.match("u:U").where("u.name", "!=", "a")) == {1, 2}
    assert names(Query.match("u:U").where("u.age", ">=", 1)) == {0, 1}


def test_errors(graph):
    for path, op, value, error in (("u.nothing", "=", 1, NotFound), ("x.age", "=", 1, NotFound), ("u.age", "=", "old", TypeMismatch), ("u.age", ">", None, TypeMismatch), ("u.age", "CONTAINS", "1", TypeMismatch), ("u.age", "=", True, TypeMismatch), ("u.name.first", "=", "a", Invalid)):
        with pytest.raises(error):
            graph.query(Query.match("u:User").where(path, op, value))
    with pytest.raises(Invalid):
        Query.match("u:User").and_where("u.age", ">", 1)
    with pytest.raises(Invalid):
        Comparison("u.age", "~", 1)


def test_text_of_expressions():
    both = Comparison("u.age", ">", 30) & Comparison("u.city", "=", "NYC")
    assert str(Where(Comparison("u.age", ">", 30))) == "WHERE u.age > 30"
    assert str(Where(both, True)) == 'WHERE (u.age > 30) AND (u.city = "NYC") (inlined)'


@pytest.fixture(scope="module")
def mapped(spark):
    graph = Graph(spark)
    graph.create_schema("M", {"name": "string", "props": "map"})
    graph.create_node("M", name="Anna", props={"score": tagged(42, "int32"), "city": "X"})
    graph.create_node("M", name="Ben", props={"score": 7, "ratio": 0.5})
    graph.create_node("M", name="Cid", props=None)
    return graph


def test_map_predicates(mapped):
    names = lambda q: {r[0] for r in rows(mapped.query(q.select("m.name")))}
    assert names(Query.match("m:M").where("m.props.score", ">", 10)) == {"Anna"}
    assert names(Query.match("m:M").where("m.props.score", "=", 7)) == {"Ben"}
    assert names(Query.match("m:M").where("m.props.city", "=", "X")) == {"Anna"}
    assert names(Query.match("m:M").where("m.props.city", "=", None)) == {"Ben", "Cid"}


def test_map_projection(mapped, spark):
    kind = lambda path: mapped.query(Query.match("m:M").select("m.name", path)).df.schema[path].dataType.simpleString()
    assert kind("m.props.ratio") == "double" and kind("m.props.city") == "string" and kind("m.props.none") == "void"
    assert kind("m.props.score") == "string"  # an int and a long
    assert rows(mapped.query(Query.match("m:M").select("m.name", "m.props.score"))) == sorted([("Anna", "42"), ("Ben", "7"), ("Cid", None)], key=repr)
    typed = mapped.query(Query.match("m:M").select("m.name", Item("m.props.score", "s", "int64")))
    assert rows(typed) == sorted([("Anna", None), ("Ben", 7), ("Cid", None)], key=repr)
    assert mapped.query(Query.match("m:M").select("m.props.ratio")).df.columns == ["m.props.ratio"]


def test_json_maps(spark):
    df = spark.createDataFrame([('{"a": 1, "b": 1.5, "c": true, "d": "x"}',), (None,), ("{}",)], "j string").select(maps.from_json("j").alias("m"))
    got = df.collect()
    assert {k: v.tag for k, v in got[0].m.items()} == {"a": TAGS["int64"], "b": TAGS["double"], "c": TAGS["bool"], "d": TAGS["string"]}
    assert (got[0].m["a"].i64, got[0].m["b"].f64, got[0].m["c"].b, got[0].m["d"].s) == (1, 1.5, True, "x")
    assert got[1].m is None and got[2].m == {}


def test_whole_numbers_in_maps_are_compared_exactly(spark):
    graph = Graph(spark)
    graph.create_schema("M", {"props": "map"})
    values = [2**53, 2**53 + 1, -(2**63), 2**63 - 1, 2, 3, -3, 2.5, 2.0**53, None, "x"]
    for v in values:
        graph.create_node("M", props={"k": v})
    tests = {"=": operator.eq, "!=": operator.ne, ">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}
    for bound in (2**53, 2**53 + 1, 2.5, -2.5, 2.0, 2**63 - 1, 1e30, -1e30, 3, float("inf")):
        for op, test in tests.items():
            got = sorted(r[0] for r in rows(graph.query(Query.match("m:M").where("m.props.k", op, bound).select("m.id"))))
            want = [i for i, v in enumerate(values) if (test(v, bound) if isinstance(v, (int, float)) else op == "!=")]
            drop = [8] if isinstance(bound, int) and abs(bound) >= 2**53 else []  # a double is compared as a double
            assert [i for i in got if i not in drop] == [i for i in want if i not in drop], (op, bound)


def test_fields_compared_with_fields(spark):
    graph = workers(spark)
    hop = lambda *where: Query.match("u:User").traverse("u", "FRIEND", "f:User").where(*where).select("u.id", "f.id")
    assert rows(graph.query(hop("u.age", ">", Path("f.age")))) == [(1, 3)]
    assert rows(graph.query(hop("u.city", "=", Path("f.city")))) == [(0, 1)]
    assert rows(graph.query(Query.match("u:User").where("u.salary", "<", Path("u.age")))) == []
    assert rows(graph.query(Query.match("u:User").where("u.name", "CONTAINS", Path("u.name")).and_where("u.id", "<", 2).select("u.id"))) == [(0,), (1,)]
    assert [r[:] for r in execute(graph, "MATCH (u:User)-[:FRIEND]->(f:User) WHERE f.age < u.age AND u.salary > 0 SELECT u.id, f.id;").collect()] == [(1, 3)]
    for where in (("u.name", ">", Path("f.age")), ("u.age", "CONTAINS", Path("f.age"))):
        with pytest.raises(TypeMismatch):
            graph.query(hop(*where))
    with pytest.raises(NotFound):
        graph.query(hop("u.age", "=", Path("x.age")))
