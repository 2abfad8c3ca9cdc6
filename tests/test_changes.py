import json

import pytest
from pyspark.sql import functions as F

from tests.graphs import rows, staff, versioned, workers
from weftgraph.errors import AlreadyExists, Invalid, NotFound, TypeMismatch
from weftgraph.graph import Config, Graph
from weftgraph.operators.temporal import ManualClock
from weftgraph.plans.query import Query, Update
from weftgraph.sources.printer import table
from weftgraph.sources.snapshot import restore, snapshots
from weftgraph.types import FieldType

T0, T1, T2, T3 = 1685577600000000000, 1688169600000000000, 1690848000000000000, 1693526400000000000


def values(graph, schema, *fields):
    return sorted((tuple(r) for r in graph.node_frame(schema).select("id", *fields).collect()), key=repr)


def test_update_by_id(spark):
    graph = workers(spark)
    assert graph.update(Update.on("User", 0).set("age", 31).set("city", "SF")).updated == 1
    assert graph.get_node("User", 0).age == 31
    missing = graph.update(Update.on("User", 99).set("age", 1))
    assert (missing.updated, missing.failed) == (0, 1)
    for schema, field in (("User", "nothing"), ("Nobody", "age")):
        with pytest.raises(NotFound):
            graph.update(Update.on(schema, 0).set(field, 1))
    assert graph.update(Update.on("User", 0).set("age", "old")).failed == 1
    with pytest.raises(Invalid):
        graph.update(Update.on("User", 0))


def test_update_by_pattern(spark):
    graph = workers(spark)
    assert graph.update(Update.match(Query.match("u:User").where("u.city", "=", "SF")).set("u.salary", 1)).updated == 3
    hop = Query.match("u:User").traverse("u", "WORKS_AT", "c:Company").where("c.name", "=", "TechCorp")
    assert graph.update(Update.match(hop).set("u.age", 1).set("c.size", 2)).updated == 3  # two users and one company
    assert [v for v in values(graph, "User", "age") if v[1] == 1] == [(0, 1), (1, 1)]
    assert graph.get_node("Company", 0).size == 2
    with pytest.raises(Invalid):
        Update.match(hop).set("age", 1)
    with pytest.raises(NotFound):
        graph.update(Update.match(hop).set("x.age", 1))


def test_update_counts_each_node_once(spark):
    graph = Graph(spark)
    graph.create_schema("U", {"tags": "array<string>"})
    for _ in range(3):
        graph.create_node("U", tags=["a"])
    graph.connect(0, "K", 1)
    graph.connect(0, "K", 2)
    got = graph.update(Update.match(Query.match("u:U").traverse("u", "K", "v:U")).append("u.tags", ["b", "c"]))
    assert got.updated == 1 and values(graph, "U", "tags") == [(0, ["a", "b", "c"]), (1, ["a"]), (2, ["a"])]


def test_update_edges(spark):
    graph = staff(spark)
    query = Query.match("u:User").traverse("u", "WORKS_AT", "c:Company", alias="e").where("u.name", "=", "Bob")
    assert graph.update(Update.match(query).set("e.role", "cto").set("u.employed", True)).updated == 2
    got = graph.query(Query.match("u:User").traverse("u", "WORKS_AT", "c:Company", alias="e").select("u.name", "u.employed", "e"))
    assert rows(got) == [("Alice", False, 2020, "eng"), ("Bob", True, 2021, "cto")]
    assert graph.update(Update.match(query).set("e.source_id", 3)).failed == 1


def test_arrays(spark):
    graph = Graph(spark)
    graph.create_schema("Item", {"name": "string", "tags": "array<string>", "scores": "array<int32>"})
    graph.create_node("Item", name="Alice", tags=["cpp"], scores=[90])
    graph.create_node("Item", name="Bob", tags=None, scores=[])
    graph.update(Update.on("Item", 0).append("tags", "go"))
    graph.update(Update.on("Item", 1).append("tags", ["x", "y"]))
    graph.update(Update.on("Item", 1).append("scores", []))
    graph.update(Update.on("Item", 0).set("scores", [1, 2]))
    assert values(graph, "Item", "tags", "scores") == [(0, ["cpp", "go"], [1, 2]), (1, ["x", "y"], [])]
    assert graph.update(Update.on("Item", 0).append("name", "x")).failed == 1
    assert graph.update(Update.on("Item", 0).append("scores", ["x"])).failed == 1


def test_maps(spark):
    graph = Graph(spark)
    graph.create_schema("M", {"name": "string", "props": "map"})
    graph.create_node("M", name="a", props={"k": 1})
    graph.create_node("M", name="b")
    graph.update(Update.on("M", 0).set("props.k", 2).set("props.z", "s"))
    graph.update(Update.on("M", 1).set("props.k", 0.5))
    deep = graph.update(Update.on("M", 0).set("props.k.x", 1))
    assert deep.failed == 1 and "one level" in deep.errors[0]
    got = {r.id: r.props for r in graph.node_frame("M").collect()}
    assert (got[0]["k"].i64, got[0]["z"].s, got[1]["k"].f64) == (2, "s", 0.5)
    graph.update(Update.on("M", 0).remove("props.z"))
    assert list(graph.get_node("M", 0).props) == ["k"]
    with pytest.raises(Invalid):
        Update.on("M", 0).remove("props")
    graph.update(Update.on("M", 0).set("props", {"only": True}))
    graph.update(Update.on("M", 1).set("props", {}))
    got = {r.id: r.props for r in graph.node_frame("M").collect()}
    assert list(got[0]) == ["only"] and got[1] == {}


def test_creation_is_checked(spark):
    graph = Graph(spark)
    graph.create_schema("U", {"name": "string!", "age": "int32", "code": "string(4)"})
    for bad, error in (({"name": None}, Invalid), ({}, Invalid), ({"name": "a", "age": "x"}, TypeMismatch), ({"name": "a", "id": 1}, Invalid), ({"name": "a", "other": 1}, NotFound), ({"name": "a", "code": "ééé"}, TypeMismatch), ({"name": "a", "age": 2**31}, TypeMismatch)):
        with pytest.raises(error):
            graph.create_node("U", **bad)
    assert graph.create_node("U", name="a") == 0 and graph.create_node("U", name="b") == 1
    with pytest.raises(Invalid):
        graph.connect(0, "K", 1, since=3)
    graph.create_edge_schema("K", {"since": "int64"})
    with pytest.raises(AlreadyExists):
        graph.create_edge_schema("K", {"since": "int64"})
    with pytest.raises(NotFound):
        graph.connect(0, "K", 1, other=3)
    with pytest.raises(TypeMismatch):
        graph.connect(0, "K", 1, since="x")
    with pytest.raises(Invalid):
        graph.create_schema("V", {"id": "int64"})
    with pytest.raises(NotFound):
        graph.get_node("U", 7)


def test_bulk_ids_are_dense(spark):
    graph = Graph(spark)
    graph.create_schema("U", {"n": "int64"})
    graph.create_node("U", n=-1)
    assert graph.create_nodes("U", spark.range(1000).repartition(7).withColumnRenamed("id", "n")) == 1000
    assert graph.create_node("U", n=-2) == 1001
    frame = graph.node_frame("U")
    assert frame.agg(F.min("id"), F.max("id"), F.countDistinct("id")).first()[:] == (0, 1001, 1002)
    assert graph.connect_many("K", frame.select(F.col("id").alias("source_id"), F.col("n").alias("target_id"))) == 1002
    assert graph.edge_types().collect()[0][:] == ("K", 1002)
    with pytest.raises(NotFound):
        graph.create_nodes("U", spark.range(3).withColumnRenamed("id", "other"))


def test_bulk_loads_of_aggregated_tables_lose_nothing(spark):
    """The rows come from shuffles, which read in other partitions when fewer columns are asked for."""
    graph, n = Graph(spark), 200_000
    graph.create_schema("U", {"key": "int64", "wide": "string", "n": "int64"})
    graph.create_edge_schema("K", {"wide": "string"})
    source = spark.range(2 * n).select((F.col("id") % n).alias("key"), F.repeat(F.col("id").cast("string"), 8).alias("wide"))
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        made = source.groupBy("key").agg(F.max("wide").alias("wide"), F.count("*").alias("n"))
        assert graph.create_nodes("U", made) == n
        joined = graph.node_frame("U").join(made.select("key", F.col("wide").alias("other")), "key")
        assert graph.connect_many("K", joined.select(F.col("id").alias("source_id"), F.col("key").alias("target_id"), F.col("other").alias("wide"))) == n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for frame, key in ((graph.node_frame("U"), "key"), (graph.edge_frame("K"), "target_id")):
        assert frame.count() == n
        got = frame.agg(F.count("wide"), F.countDistinct("id"), F.min("id"), F.max("id"), F.countDistinct(key), F.sum(F.crc32("wide"))).first()
        assert got[:5] == (n, n, 0, n - 1, n)
    assert graph.node_frame("U").filter("n <> 2").count() == 0
    pairs = graph.edge_frame("K").join(graph.node_frame("U"), F.col("source_id") == graph.node_frame("U")["id"])
    assert pairs.count() == n


def test_ids_go_on_above_those_registered(spark):
    graph = Graph(spark)
    graph.use_nodes("A", spark.createDataFrame([(0, "x")], "id long, name string"))
    graph.use_nodes("B", spark.createDataFrame([(7, "x"), (3, "y")], "id long, name string"))
    graph.use_nodes("C", spark.createDataFrame([], "id long, name string"))
    assert [graph.create_node(s, name="z") for s in "ABC"] == [1, 8, 0]
    assert graph.create_nodes("B", spark.createDataFrame([("q",)], "name string")) == 1 and graph.get_node("B", 9).name == "q"


def test_edges_without_ids(spark):
    """The example of the README, and parallel edges."""
    graph = Graph(spark, Config(versioning=True))
    graph.use_nodes("User", spark.createDataFrame([(1, "Ann", 40), (2, "Bob", 20)], "id long, name string, age int"))
    graph.use_edges("KNOWS", spark.createDataFrame([(1, 2, 2021)], "source_id long, target_id long, since int"), "User", "User")
    query = Query.match("u:User").where("u.age", ">", 30).traverse("u", "KNOWS", "f:User", "LEFT", alias="e").where("e.since", ">=", 2020).select("u.name", "f", "e.since")
    assert rows(graph.query(query)) == [("Ann", 2, "Bob", 20, 2021)]
    parallel = [(1, 2, y, {"a": y}) for y in (2019, 2022, 2020)] + [(2, 1, None, None)]
    graph.use_edges("P", spark.createDataFrame(parallel, "source_id long, target_id long, since int, more map<string,int>").repartition(3).drop("more"), "User", "User")
    both = lambda: rows(graph.query(Query.match("u:User").traverse("u", "P", "f:User", alias="e").select("u.id", "f.id", "e.since")))
    got = both()
    assert len(got) == 2 and got == both() and dict((r[0], r[2]) for r in got)[1] in (2019, 2020, 2022)
    assert graph.update(Update.match(Query.match("u:User").traverse("u", "P", "f:User", alias="e").where("e.since", "=", 2022)).set("e.since", 1)).updated == 1
    assert sorted(r.since for r in graph.edge_frame("P").filter("source_id = 1").collect()) == [1, 2019, 2020]
    assert graph.edge_frame("P").agg(F.countDistinct("id")).first()[0] == 4
    assert graph.delete_edges("KNOWS", ("User", F.col("id") == 1)) == 1


def test_json_of_edge_properties(spark):
    graph = Graph(spark)
    graph.create_edge_schema("K", {"since": "int64", "what": "string", "weight": "double", "tags": "array<string>", "props": "map"})
    graph.connect(0, "K", 1, since=2**60, what='say "hi"\n\\', weight=0.1, tags=["a", None], props={"x": 1, "y": 'q"', "z": True, "r": 0.25})
    graph.connect(0, "K", 2)
    told = graph.edges_as_json("K").orderBy("id").collect()
    assert json.loads(told[0].properties) == {"since": 2**60, "what": 'say "hi"\n\\', "weight": 0.1, "tags": ["a", None], "props": {"x": 1, "y": 'q"', "z": True, "r": 0.25}} and told[1].properties == "{}"
    graph.create_edge_schema("L", {"since": "int64", "what": "string", "weight": "double", "tags": "array<string>", "props": "map"})
    assert graph.connect_json("L", graph.edges_as_json("K")) == 2
    plain = lambda t: sorted((r.target_id, r.since, r.what, r.weight, r.tags, r.props and {k: v["i64"] if v["i64"] is not None else v["s"] or v["b"] or v["f64"] for k, v in r.props.items()}) for r in graph.edge_frame(t).collect())
    assert plain("L") == plain("K")


def test_update_node(spark):
    graph = workers(spark)
    assert graph.update_node("User", 0, "age", 31).updated == 1 and graph.update_node("User", 77, "age", 1).failed == 1
    assert graph.update_node_fields("User", 1, {"age": 36, "city": "LA"}).updated == 1
    assert values(graph, "User", "age", "city")[:2] == [(0, 31, "NYC"), (1, 36, "LA")]
    assert graph.update_node_fields("User", 1, {"age": "old", "city": "SF"}).failed == 1


def test_versions_of_bulk_nodes(spark):
    clock = ManualClock(T0)
    graph = Graph(spark, Config(versioning=True, clock=clock, checkpoint_every=2))
    graph.use_nodes("User", spark.createDataFrame([(i, f"n{i}", 25 + i) for i in range(4)], "id long, name string, age int"))
    at = lambda t, **kw: rows(graph.query(Query.match("u:User").as_of_valid_time(t).select("u.id", "u.age")))
    for k, now in enumerate((T1, T2, T2 + 1, T2 + 2, T3)):
        clock.now = now
        graph.update(Update.match(Query.match("u:User").where("u.id", "<", 2)).set("u.age", 50 + k))
    graph.create_nodes("User", spark.createDataFrame([("new", 1)], "name string, age int"))
    first = [(0, 25), (1, 26), (2, 27), (3, 28)]
    assert at(T0 - 1) == [] and at(T0) == first and at(T1 - 1) == first
    for k, now in enumerate((T1, T2, T2 + 1, T2 + 2)):
        assert at(now) == [(0, 50 + k), (1, 50 + k), (2, 27), (3, 28)]
    assert at(T3) == [(0, 54), (1, 54), (2, 27), (3, 28), (4, 1)]
    clock.now = T3 + 1
    graph.update_node("User", 2, "age", 27)  # changes nothing, and is a version all the same
    assert sorted(r[:] for r in graph.version_counts("User").collect()) == [(0, 6), (1, 6), (2, 2), (3, 1), (4, 1)]
    both = lambda v, t: rows(graph.query(Query.match("u:User").as_of(v, t).where("u.id", "=", 0).select("u.age")))
    assert both(T0, T3) == [(25,)] and both(T2, T2) == [(51,)] and both(T2, T1) == []
    assert rows(graph.query(Query.match("u:User").as_of_tx_time(T2).where("u.id", "=", 0).select("u.age"))) == [(51,)]
    graph.delete_node("User", 0)
    assert (0, 25) not in at(T0) and (0, 51) not in at(T2)


def test_edges_by_end_and_deletion(spark):
    graph = workers(spark)
    assert {r.target_id for r in graph.outgoing(0, "FRIEND").collect()} == {1, 2}
    assert {r.source_id for r in graph.incoming(2, "FRIEND").collect()} == {0, 1}
    assert graph.edges_of("FRIEND", spark.createDataFrame([(0,), (99,)], "id long")).count() == 1
    assert graph.delete_edges("FRIEND", ("User", F.col("id") == 0), ("User", F.col("id") == 1)) == 1
    assert graph.delete_edges("FRIEND", source=("User", F.col("name") == "Bob")) == 2
    assert graph.delete_edges("FRIEND", target=("User", F.col("id") == 4)) == 1
    assert graph.delete_edges("FRIEND") == 1 and graph.delete_edges("NONE") == 0
    assert graph.delete_matched(Query.match("u:User").where("u.age", ">", 50)) == 2
    assert graph.node_frame("User").count() == 8
    with pytest.raises(NotFound):
        graph.delete_node("User", 4)


def test_as_of(spark):
    clock = ManualClock(T0)
    graph = versioned(spark, clock)
    graph.create_node("User", name="a", age=25, active=True)
    for now, age in ((T1, 26), (T2, 27)):
        clock.now = now
        graph.update(Update.on("User", 0).set("age", age))
    at = lambda q: [r[0] for r in rows(graph.query(q.select("u.age")))]
    user = lambda: Query.match("u:User")
    assert at(user()) == [27]
    for t, want in ((T0, [25]), (T1, [26]), (T2, [27]), (T0 - 1, []), (T0 + 5, [25]), (T3, [27])):
        assert at(user().as_of_valid_time(t)) == want
    assert at(user().as_of(T0, T2)) == [25] and at(user().as_of(T0, T0)) == [25] and at(user().as_of(T2, T1)) == []
    assert at(user().as_of_tx_time(T1)) == [26]
    assert at(user().where("u.age", ">", 25).as_of_valid_time(T0)) == []


def test_versions_of_nulls_and_no_changes(spark):
    clock = ManualClock(T0)
    graph = versioned(spark, clock)
    graph.create_node("User", name="a", age=1)
    clock.now = T1
    graph.update(Update.on("User", 0).set("age", None).set("name", "b"))
    clock.now = T2
    graph.update(Update.on("User", 0).set("name", "b"))
    assert graph.version_counts("User").collect()[0][:] == (0, 3)
    assert graph.version_at("User", 0, T0).name == "a" and graph.version_at("User", 0, T0 - 1) is None
    got = graph.query(Query.match("u:User").as_of_valid_time(T1).select("u.name", "u.age"))
    assert rows(got) == [("b", None)]
    assert rows(graph.query(Query.match("u:User").as_of_valid_time(T0).select("u.name", "u.age"))) == [("a", 1)]


def test_without_versions_as_of_reads_the_present(spark):
    graph = workers(spark)
    graph.update(Update.on("User", 0).set("age", 99))
    assert (99,) in rows(graph.query(Query.match("u:User").as_of_valid_time(T0).select("u.age")))


def test_scans(spark):
    graph = workers(spark)
    assert [r.id for r in graph.scan_edges("FRIEND").collect()] == [0, 1, 2, 3, 4]
    assert list(graph.iter_values("Company", "size")) == [5000, 50, 10000] and graph.column("Company", "name").count() == 3
    graph.config = Config(chunk_size=4)
    assert [r.id for r in graph.scan("User").collect()] == list(range(10))
    assert [len(c) for c in graph.chunks("User")] == [4, 4, 2]
    assert graph.column_values("Company", "size") == [5000, 50, 10000]


def test_lineage_is_cut(spark):
    graph = Graph(spark, Config(checkpoint_every=3))
    graph.create_schema("U", {"n": "int64"})
    graph.create_node("U", n=0)
    for n in range(7):
        graph.update(Update.on("U", 0).set("n", n))
    assert graph.get_node("U", 0).n == 6


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "db")
    graph = Graph(spark, Config(path=path, shard_capacity=4))
    graph.create_schema("U", {"name": "string", "age": "int64", "tags": "array<string>", "props": "map"})
    graph.create_edge_schema("K", {"since": "int64"})
    for i in range(6):
        graph.create_node("U", name=f"n{i}", age=i, tags=["a", str(i)], props={"k": i, "x": "y"})
    graph.connect(0, "K", 1, since=5)
    first = graph.commit()
    again = Graph.open(spark, Config(path=path, shard_capacity=4))
    assert values(again, "U", "name", "tags", "props") == values(graph, "U", "name", "tags", "props")
    assert again.get_edge("K", 0).since == 5 and again.create_node("U", name="new") == 6 and again.connect(1, "K", 2) == 1
    saved = graph.edges["K"].saved
    graph.update(Update.on("U", 0).set("age", 50))
    graph.commit()
    assert graph.edges["K"].saved == saved  # unchanged tables are not written again
    assert Graph.open(spark, Config(path=path)).get_node("U", 0).age == 50
    graph.update(Update.match(Query.match("u:U").traverse("u", "K", "v:U", alias="e")).set("e.since", 6))
    graph.commit()
    assert Graph.open(spark, Config(path=path)).get_edge("K", 0).since == 6
    assert restore(spark, Config(path=path), first).get_node("U", 0).age == 0 and len(snapshots(spark, path)) == 3
    assert Graph.open(spark, Config(path=str(tmp_path / "none"))).catalog.nodes == {}
    with pytest.raises(Invalid):
        Graph(spark).commit()


@pytest.mark.parametrize("gone", [[], [0], [3], [0, 1, 2, 3], [1, 2, 5, 6, 9], list(range(10))])
def test_compaction(spark, gone):
    graph = Graph(spark, Config(shard_capacity=4))
    graph.create_schema("U", {"n": "int64"})
    graph.create_nodes("U", spark.range(10).withColumnRenamed("id", "n").coalesce(1))
    if gone:
        graph.delete_matched(Query.match("u:U").where("u.id", "<", -1).or_where("u.id", "=", gone[0])) if len(gone) == 1 else [graph.delete_node("U", i) for i in gone]
    graph.compact("U")
    left = [i for i in range(10) if i not in gone]
    want = [(k, len(c), c[0], c[-1]) for k, c in enumerate(left[i : i + 4] for i in range(0, len(left), 4))]
    assert sorted(r[:] for r in graph.shards("U").collect()) == want


def test_printer(spark):
    graph = workers(spark)
    text = table(graph.query(Query.match("u:User").where("u.age", ">", 50).select("u.id", "u.name")).df)
    assert '"Eve"' in text and text.endswith("2 rows")


def test_types():
    for text in ("int32", "int64", "float", "double", "bool", "string", "string(16)", "array<int32>", "map"):
        assert str(FieldType.parse(text)) == text
    assert FieldType.parse("FLOAT64").kind == "double"
    for bad in ("decimal", "array<map>", "array<array<int32>>"):
        with pytest.raises(Invalid):
            FieldType.parse(bad)
