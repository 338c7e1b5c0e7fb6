"""Rows of a query and of its SQL in DuckDB, made comparable."""

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def text(v):
    if v is None or v != v:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(float(v) + 0.0)
    return str(v)


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(text(r[i]) for i in order) for r in rows)


def of_sql(sql, folder=FOLDER):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = con.execute(sql)
    return comparable([d[0] for d in got.description], got.fetchall())


def of_query(spark, query, folder=FOLDER):
    df = query(spark, folder)
    return comparable(df.columns, [tuple(r) for r in df.collect()])
