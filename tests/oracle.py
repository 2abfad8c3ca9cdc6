"""Compares a registered query with its DuckDB SQL."""

import duckdb

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def compare(spark, query, sql):
    db = duckdb.connect()
    for t in TABLES.split():
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = query(spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*(f"`{c}`" for c in columns)).collect()]
    want = db.sql(sql)
    assert sorted(want.columns) == columns
    order = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    assert order(got) == order(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    return len(got)
