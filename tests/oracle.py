"""Runs a query's SQL in DuckDB over the same Parquet tables and compares all rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v + 0.0:.9g}")
    return v if isinstance(v, (bool, int, str, type(None))) else (tuple(map(plain, v)) if isinstance(v, (list, tuple)) else float(v) if hasattr(v, "as_tuple") else str(v))


def assert_same(frame, sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(frame.columns)
    order = sorted(names)
    rows = lambda it: sorted((tuple(plain(r[k]) for k in order) for r in it), key=str)
    assert rows(frame.collect()) == rows(dict(zip(names, r, strict=True)) for r in cur.fetchall())
