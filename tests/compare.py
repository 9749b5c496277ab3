"""Compare a Spark result with DuckDB SQL on the same Parquet tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return None if v != v else round(float(v), 6)
    if hasattr(v, "item"):
        return plain(v.item())
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(plain(r[i]) for i in order) for r in data], key=repr)


def same(df, con, sql):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows([c[0] for c in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
