"""Compare a query with its SQL in DuckDB over the same files."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return x


def same(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            path = f"{path}/*.parquet" if os.path.isdir(path) else path
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    want = found.fetchall()
    assert sorted(df.columns) == sorted(names)
    key = lambda row: [(x is None, str(x)) for x in row]
    got = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=key)
    order = [names.index(c) for c in sorted(names)]
    want = sorted((tuple(plain(r[i]) for i in order) for r in want), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == b
