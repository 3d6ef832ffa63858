"""Compare a query with its SQL in DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame):
    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "null"
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    return sorted(tuple(plain(x) for x in r) for r in frame)


def compare(spark, d, query, sql):
    found = query(spark, d)
    names = sorted(found.columns)
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = db.execute(sql)
    order = [x[0] for x in want.description]
    assert sorted(order) == names
    a = rows_of(tuple(r[n] for n in names) for r in found.collect())
    b = rows_of(tuple(r[order.index(n)] for n in names) for r in want.fetchall())
    assert len(a) == len(b)
    assert a == b
    return len(a)
