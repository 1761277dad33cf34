"""Runs registered queries against their DuckDB statements and compares whole results."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v + 0.0)
        return repr(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """(spark rows, sql rows, names equal, first differing rows)."""
    mine = [tuple(r) for r in df.collect()]
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = result.fetchall()
    same_names = sorted(names) == sorted(df.columns)
    a, b = canonical(mine, df.columns), canonical(theirs, names)
    diff = None
    if a != b:
        sa, sb = set(a), set(b)
        diff = ([x for x in a if x not in sb][:2], [x for x in b if x not in sa][:2])
    return len(mine), len(theirs), same_names, diff
