"""A Spark result and a DuckDB result as sorted rows of normalised values."""

import duckdb

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def norm(v):
    if v is None:
        return (0, "")
    return (1, repr(round(v, 9)) if isinstance(v, float) else str(v))


def rows_of_spark(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(map(norm, r)) for r in df.select(*columns).collect())


def rows_of_duckdb(c, sql):
    rel = c.sql(sql)
    columns = sorted(rel.columns)
    order = [list(rel.columns).index(x) for x in columns]
    return columns, sorted(tuple(norm(r[i]) for i in order) for r in rel.fetchall())
