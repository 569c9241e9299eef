"""Runs a query and its SQL side by side."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    return x


def difference(spark, query, sql, sf_dir):
    """None if both give the same columns and rows, else a description."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    order = sorted(names)
    expected = sorted((tuple(plain(r[names.index(n)]) for n in order) for r in want.fetchall()), key=repr)
    df = query(spark, sf_dir)
    if sorted(df.columns) != order:
        return f"columns {sorted(df.columns)} for {order}"
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*[f"`{n}`" for n in order]).collect()), key=repr)
    if got != expected:
        a, b = [x for x in got if x not in set(expected)], [x for x in expected if x not in set(got)]
        return f"{len(got)} rows for {len(expected)}; only Spark {a[:3]}; only SQL {b[:3]}"
    return None
