"""Small graphs that the tests share."""

from weftgraph.graph import Config, Graph


def people(spark, friend=(), works_at=(), likes=(), manages=()):
    graph = Graph(spark)
    graph.create_schema("users", {"name": "string", "age": "int64"})
    graph.create_schema("companies", {"name": "string", "size": "int64"})
    for name, age in (("alex", 25), ("bob", 31), ("jeff", 33), ("sam", 21), ("matt", 40)):
        graph.create_node("users", name=name, age=age)
    for name, size in (("ibm", 1000), ("google", 3000), ("aws", 5000)):
        graph.create_node("companies", name=name, size=size)
    for kind, pairs in (("friend", friend), ("works-at", works_at), ("likes", likes), ("manages", manages)):
        for a, b in pairs:
            graph.connect(a, kind, b)
    return graph


def workers(spark):
    """Ten users, three companies, FRIEND and WORKS_AT."""
    graph = Graph(spark)
    graph.create_schema("User", {"name": "string", "age": "int32", "city": "string", "salary": "int32"})
    graph.create_schema("Company", {"name": "string", "size": "int32", "city": "string"})
    rows = (
        ("Alice", 25, "NYC", 80000), ("Bob", 35, "NYC", 120000), ("Charlie", 45, "SF", 150000), ("Diana", 30, "LA", 60000), ("Eve", 55, "NYC", 200000),
        ("Frank", 22, "SF", 50000), ("Grace", 38, "LA", 90000), ("Henry", 60, "NYC", 180000), ("Ivy", 28, "SF", 75000), ("Jack", 42, "LA", 110000),
    )
    for name, age, city, salary in rows:
        graph.create_node("User", name=name, age=age, city=city, salary=salary)
    for name, size, city in (("TechCorp", 5000, "NYC"), ("StartupInc", 50, "SF"), ("BigCorp", 10000, "LA")):
        graph.create_node("Company", name=name, size=size, city=city)
    for kind, pairs in (("FRIEND", ((0, 1), (0, 2), (1, 2), (1, 3), (2, 4))), ("WORKS_AT", ((0, 0), (1, 0), (2, 1)))):
        for a, b in pairs:
            graph.connect(a, kind, b)
    return graph


def staff(spark):
    """Edges with properties."""
    graph = Graph(spark)
    graph.create_schema("User", {"name": "string", "age": "int32", "employed": "bool"})
    graph.create_schema("Company", {"name": "string", "size": "int32"})
    graph.create_edge_schema("WORKS_AT", {"since": "int64", "role": "string"})
    for name, age in (("Alice", 30), ("Bob", 25), ("Charlie", 40)):
        graph.create_node("User", name=name, age=age, employed=False)
    for name in ("Acme", "Globex"):
        graph.create_node("Company", name=name, size=0)
    graph.connect(0, "WORKS_AT", 0, since=2020, role="eng")
    graph.connect(1, "WORKS_AT", 0, since=2021, role="pm")
    return graph


def rows(result, *paths):
    """The rows of a result as sorted tuples of the columns named."""
    df = result.df
    got = df.select(*(f"`{p}`" for p in paths or df.columns)).collect()
    return sorted((tuple(r) for r in got), key=repr)


def versioned(spark, clock):
    graph = Graph(spark, Config(versioning=True, clock=clock))
    graph.create_schema("User", {"name": "string", "age": "int32", "active": "bool"})
    return graph
