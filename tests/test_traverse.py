import itertools
import random

import pytest
from pyspark.sql import functions as F

from tests.graphs import people, rows, staff
from weftgraph.errors import Invalid, NotFound, Unsupported
from weftgraph.graph import Graph
from weftgraph.plans.query import Query

UFC = ("u.name", "f.name", "c.name")


def test_scan(spark):
    assert people(spark).query(Query.match("u:users")).df.count() == 5


def test_two_inner_hops(spark):
    graph = people(spark, friend=[(0, 1)], works_at=[(1, 1)])
    got = graph.query(Query.match("u:users").traverse("u", "friend", "f:users").traverse("f", "works-at", "c:companies"))
    assert rows(got, *UFC) == [("alex", "bob", "google")]
    assert got.df.columns == ["u.id", "u.name", "u.age", "f.id", "f.name", "f.age", "c.id", "c.name", "c.size"]


def test_branches_multiply(spark):
    graph = people(spark, friend=[(0, 1), (0, 2)], works_at=[(0, 1)])
    query = Query.match("u:users").traverse("u", "friend", "f:users").traverse("u", "works-at", "c:companies")
    assert rows(graph.query(query), *UFC) == [("alex", "bob", "google"), ("alex", "jeff", "google")]


def test_last_hop_empty(spark):
    graph = people(spark, friend=[(0, 1), (1, 2)], works_at=[(1, 1)])
    query = Query.match("u:users").traverse("u", "friend", "f:users").traverse("f", "friend", "g:users").traverse("g", "works-at", "c:companies")
    assert graph.query(query).df.count() == 0


def test_two_paths_with_ends_fixed(spark):
    graph = people(spark, friend=[(0, 1), (0, 2)], works_at=[(0, 0), (1, 0), (2, 1)])
    query = Query.match("u:users").traverse("u", "friend", "f:users").traverse("u", "works-at", "c1:companies").where("c1.id", "=", 0).traverse("f", "works-at", "c2:companies").where("c2.id", "=", 0)
    assert rows(graph.query(query), "u.name", "f.name", "c1.name", "c2.name") == [("alex", "bob", "ibm", "ibm")]


def test_fan_out(spark):
    graph = people(spark, friend=[(0, 1), (0, 2), (0, 3)], works_at=[(0, 0), (0, 1)])
    assert graph.query(Query.match("u:users").traverse("u", "friend", "f:users").traverse("u", "works-at", "c:companies")).df.count() == 6


def test_left_second_hop(spark):
    graph = people(spark, friend=[(0, 1), (0, 2)], works_at=[(1, 1)])
    query = Query.match("u:users").traverse("u", "friend", "f:users").traverse("f", "works-at", "c:companies", "LEFT")
    assert rows(graph.query(query), *UFC) == [("alex", "bob", "google"), ("alex", "jeff", None)]


def test_right_second_hop_has_all_targets(spark):
    graph = people(spark, friend=[(0, 1), (0, 2)], works_at=[(1, 1), (2, 2), (3, 0)])
    query = Query.match("u:users").traverse("u", "friend", "f:users").traverse("f", "works-at", "c:companies", "RIGHT")
    assert {r[2] for r in rows(graph.query(query), *UFC)} == {"ibm", "google", "aws"}


def test_left_then_right_keeps_both_sides(spark):
    graph = people(spark, friend=[(0, 1), (0, 2)], works_at=[(1, 1), (4, 0)])
    query = Query.match("u:users").where("u.name", "=", "alex").traverse("u", "friend", "f:users", "LEFT").traverse("f", "works-at", "c:companies", "RIGHT")
    got = rows(graph.query(query), *UFC)
    assert ("alex", "bob", "google") in got and ("alex", "jeff", None) in got and (None, None, "aws") in got


def test_left_on_many_levels(spark):
    graph = people(spark, friend=[(0, 1), (0, 2), (0, 3)], works_at=[(1, 1)], likes=[(2, 0)])
    query = Query.match("u:users").traverse("u", "friend", "f:users", "LEFT").traverse("f", "works-at", "c:companies", "LEFT").traverse("f", "likes", "l:companies", "LEFT")
    got = rows(graph.query(query), "u.name")
    assert len(got) == 7 and len(set(got)) == 5


def test_left_within_a_schema(spark):
    graph = people(spark, manages=[(0, 1), (1, 2), (1, 3)])
    assert {r[0] for r in rows(graph.query(Query.match("m:users").traverse("m", "manages", "e:users", "LEFT")), "m.id")} == set(range(5))


def test_full_within_a_schema(spark):
    graph = people(spark, friend=[(0, 1), (0, 2)])
    got = rows(graph.query(Query.match("u:users").traverse("u", "friend", "f:users", "FULL")), "u.name", "f.name")
    assert got == sorted([("alex", "bob"), ("alex", "jeff"), ("bob", None), ("jeff", None), ("sam", None), ("matt", None), (None, "sam"), (None, "matt")], key=repr)


def test_parallel_edges_give_one_row(spark):
    graph = people(spark, friend=[(0, 1), (0, 1)])
    assert graph.query(Query.match("u:users").traverse("u", "friend", "f:users")).df.count() == 1


def test_last_parallel_edge_gives_the_properties(spark):
    graph = staff(spark)
    graph.connect(1, "WORKS_AT", 0, since=2023, role="cto")
    got = graph.query(Query.match("u:User").traverse("u", "WORKS_AT", "c:Company", alias="e").select("u.name", "e.role"))
    assert rows(got) == [("Alice", "eng"), ("Bob", "cto")]


def test_shared_alias_closes_a_triangle(spark):
    graph = people(spark, friend=[(0, 1), (0, 2)], works_at=[(0, 1), (2, 1), (1, 0)])
    query = Query.match("u:users").traverse("u", "friend", "f:users").traverse("f", "works-at", "c:companies").traverse("u", "works-at", "c")
    assert rows(graph.query(query), *UFC) == [("alex", "jeff", "google")]


def test_incoming(spark):
    graph = people(spark, works_at=[(0, 1), (2, 1)])
    assert rows(graph.query(Query.match("c:companies").traverse("u:users", "works-at", "c")), "c.name", "u.name") == [("google", "alex"), ("google", "jeff")]


def test_dangling_edge_leads_nowhere(spark):
    graph = people(spark, friend=[(0, 1), (0, 2)])
    graph.delete_node("users", 1)
    assert rows(graph.query(Query.match("u:users").traverse("u", "friend", "f:users")), "u.name", "f.name") == [("alex", "jeff")]
    left = graph.query(Query.match("u:users").traverse("u", "friend", "f:users", "FULL"))
    assert ("alex", None) not in rows(left, "u.name", "f.name")


def test_where_after_left(spark):
    """Filtered after the hop, a source whose targets all fail goes; filtered in the hop, it stays unmatched."""
    edges = [(0, 1), (0, 2), (1, 3)]
    base = Query.match("u:users").traverse("u", "friend", "f:users", "LEFT").where("f.id", "=", 2).select("u.id", "f.id")
    assert rows(people(spark, friend=edges).query(base)) == sorted([(0, 2), (2, None), (3, None), (4, None)], key=repr)
    inlined = Query.match("u:users").traverse("u", "friend", "f:users", "LEFT").where("f.id", "=", 2).inline_where().select("u.id", "f.id")
    assert rows(people(spark, friend=edges).query(inlined)) == sorted([(0, 2), (1, None), (2, None), (3, None), (4, None)], key=repr)
    assert rows(people(spark, friend=edges).query(base.mode("ansi"))) == [(0, 2)]


def test_select(spark):
    graph = people(spark, friend=[(0, 1), (0, 2)], works_at=[(1, 1)])
    base = lambda: Query.match("u:users").traverse("u", "friend", "f:users")
    assert graph.query(base().select("u", "f")).df.columns == ["u.id", "u.name", "u.age", "f.id", "f.name", "f.age"]
    assert graph.query(base().select("f.age", "u.name")).df.columns == ["u.name", "f.age"]  # in order of the pattern
    for bad in ("u.nothing", "x", "x.name"):
        with pytest.raises(NotFound):
            graph.query(base().select(bad))


def test_edge_alias(spark):
    graph = staff(spark)
    base = Query.match("u:User").traverse("u", "WORKS_AT", "c:Company", alias="e").where("e.since", ">=", 2021)
    assert rows(graph.query(base.select("u.name", "e.since", "e.role", "c.name"))) == [("Bob", "Acme", 2021, "pm")] or rows(graph.query(base.select("u.name", "e.since", "e.role", "c.name")), "u.name", "e.since", "e.role", "c.name") == [("Bob", 2021, "pm", "Acme")]
    assert graph.query(Query.match("u:User").traverse("u", "WORKS_AT", "c:Company", alias="e").select("e")).df.columns == ["e.since", "e.role"]
    with pytest.raises(Invalid):
        graph.query(Query.match("u:User").traverse("u", "WORKS_AT", "c:Company", alias="u"))
    with pytest.raises(Invalid):
        people(spark, friend=[(0, 1)]).query(Query.match("u:users").traverse("u", "friend", "f:users", alias="e"))


def test_alias_errors(spark):
    graph = people(spark, friend=[(0, 1)])
    with pytest.raises(NotFound):
        graph.query(Query.match("u:nobody"))
    with pytest.raises(NotFound):
        graph.query(Query.match("u:users").where("x.age", ">", 1))
    with pytest.raises(Invalid):
        graph.query(Query.match("u:users").traverse("u", "friend", "u:companies"))
    with pytest.raises(Invalid):
        graph.query(Query.match("u:users").traverse("a:users", "friend", "b:users"))
    with pytest.raises(Unsupported):
        graph.query(Query.match("u:users").traverse("u", "friend", "f:users").traverse("u", "friend", "f", "FULL"))


def expected(n, m, edges, first, second, how1, how2):
    """Two hops a->b->c over plain Python sets: a and b of one size, c another, all schemas different."""
    out = []
    pairs = [(a, b) for a in range(n) for b in range(n) if (a, b) in first]
    rows1 = list(pairs)
    if how1 in ("LEFT", "FULL"):
        rows1 += [(a, None) for a in range(n) if not any(p[0] == a for p in pairs)]
    if how1 in ("RIGHT", "FULL"):
        rows1 += [(None, b) for b in range(n) if not any(p[1] == b for p in pairs)]
    hit = set()
    for a, b in rows1:
        found = [c for c in range(m) if (b, c) in second]
        hit |= set(found)
        out += [(a, b, c) for c in found]
        if not found and how2 != "INNER":
            out.append((a, b, None))
    if how2 in ("RIGHT", "FULL"):
        out += [(None, None, c) for c in range(m) if c not in hit]
    return sorted(out, key=repr)


@pytest.mark.parametrize("how1,how2", list(itertools.product(("INNER", "LEFT", "RIGHT", "FULL"), repeat=2)))
def test_random_graphs(spark, how1, how2):
    rng = random.Random(f"{how1}{how2}")
    n, m = 5, 4
    first = {(a, b) for a in range(n) for b in range(n) if rng.random() < 0.25}
    second = {(b, c) for b in range(n) for c in range(m) if rng.random() < 0.3}
    graph = Graph(spark)
    for name, count in (("A", n), ("B", n), ("C", m)):
        graph.use_nodes(name, spark.createDataFrame([(i, str(i)) for i in range(count)], "id long, name string"))
    for name, pairs in (("AB", first), ("BC", second)):
        graph.use_edges(name, spark.createDataFrame(sorted(pairs) * 2, "source_id long, target_id long"))
    query = Query.match("a:A").traverse("a", "AB", "b:B", how1).traverse("b", "BC", "c:C", how2).select("a.id", "b.id", "c.id")
    assert rows(graph.query(query)) == expected(n, m, None, first, second, how1, how2)


@pytest.mark.parametrize("seed", range(4))
def test_random_within_a_schema(spark, seed):
    rng = random.Random(seed)
    n = 7
    edges = {(a, b) for a in range(n) for b in range(n) if rng.random() < 0.2}
    graph = Graph(spark)
    graph.use_nodes("N", spark.createDataFrame([(i, str(i)) for i in range(n)], "id long, name string"))
    graph.use_edges("E", spark.createDataFrame(sorted(edges), "source_id long, target_id long"))
    sources = {a for a, _ in edges}
    kept = [(a, b) for a, b in edges if b not in sources]
    right = [(None, b) for b in range(n) if b not in sources and b not in {t for _, t in kept}]
    left = [(a, None) for a in range(n) if a not in sources]
    for how, want in (("RIGHT", kept + right), ("FULL", kept + right + left)):
        got = graph.query(Query.match("a:N").traverse("a", "E", "b:N", how).select("a.id", "b.id"))
        assert rows(got) == sorted(want, key=repr)
    incoming = graph.query(Query.match("b:N").traverse("a:N", "E", "b", "FULL").select("a.id", "b.id"))
    assert sorted(((r[1], r[0]) for r in rows(incoming)), key=repr) == sorted(kept + right + left, key=repr)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("first", ["INNER", "LEFT"])
def test_random_within_a_schema_on_a_later_hop(spark, seed, first):
    """The sources are those of the rows so far; a row whose node is the source of no match stays alone."""
    rng = random.Random(f"{seed}{first}")
    n = 6
    one, two = ({(a, b) for a in range(n) for b in range(n) if rng.random() < share} for share in (0.25, 0.2))
    graph = Graph(spark)
    graph.use_nodes("N", spark.createDataFrame([(i, str(i)) for i in range(n)], "id long, name string"))
    graph.use_edges("A", spark.createDataFrame(sorted(one) * 2, "source_id long, target_id long"))
    graph.use_edges("B", spark.createDataFrame(sorted(two) * 2, "source_id long, target_id long"))
    prefix = sorted(one) + ([(a, None) for a in range(n) if a not in {x for x, _ in one}] if first == "LEFT" else [])
    pairs = [(a, b, c) for a, b in prefix for x, c in two if x == b]
    sources = {b for _, b, _ in pairs}
    kept = [p for p in pairs if p[2] not in sources]
    alone = [(a, b, None) for a, b in prefix if b not in sources]
    far = [(None, None, c) for c in range(n) if c not in sources and c not in {p[2] for p in kept}]
    for how in ("RIGHT", "FULL"):
        got = graph.query(Query.match("a:N").traverse("a", "A", "b:N", first).traverse("b", "B", "c:N", how).select("a.id", "b.id", "c.id"))
        assert rows(got) == sorted(kept + alone + far, key=repr)


def test_parallel_edges_after_any_hop(spark):
    """Parallel edges with and without properties, on every kind of hop and on a hop between known nodes."""
    graph = Graph(spark)
    for name in "AB":
        graph.use_nodes(name, spark.createDataFrame([(i, str(i)) for i in range(3)], "id long, name string"))
    edges = [(k, k % 2, k // 2 % 2, f"p{k}") for k in range(8)] + [(9, 0, 7, "far")]
    graph.use_edges("E", spark.createDataFrame(edges, "id long, source_id long, target_id long, p string"))
    best = {(0, 0): "p4", (1, 0): "p5", (0, 1): "p6", (1, 1): "p7"}
    for how, more in (("INNER", []), ("LEFT", [(2, None, None)]), ("RIGHT", [(None, 2, None)]), ("FULL", [(2, None, None), (None, 2, None)])):
        told = Query.match("a:A").traverse("a", "E", "b:B", how, alias="e").select("a.id", "b.id", "e.p")
        assert rows(graph.query(told)) == sorted([(*k, v) for k, v in best.items()] + more, key=repr), how
        plain = Query.match("a:A").traverse("a", "E", "b:B", how).select("a.id", "b.id")
        assert rows(graph.query(plain)) == sorted([*best, *(m[:2] for m in more)], key=repr), how
    closed = Query.match("a:A").traverse("a", "E", "b:B").traverse("a", "E", "b", alias="e").select("a.id", "b.id", "e.p")
    assert rows(graph.query(closed)) == sorted((*k, v) for k, v in best.items())


def test_a_selective_hop_shuffles_no_edge_table(spark):
    graph = Graph(spark)
    graph.use_nodes("A", spark.range(100).select("id", F.col("id").cast("string").alias("name")))
    edges = spark.range(1000).select((F.col("id") % 100).alias("source_id"), (F.col("id") % 7).alias("target_id"), F.col("id").alias("w"))
    graph.use_edges("E", edges)
    df = graph.query(Query.match("a:A").where("a.id", "=", 3).traverse("a", "E", "b:A").select("a.id", "b.id")).df
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("Aggregate") < plan.index("_near#")  # parallel edges are made one above the join with the rows so far
    assert df.count() == 7
