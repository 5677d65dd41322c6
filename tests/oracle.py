"""Compare a Spark query with its SQL, run by DuckDB over the same files."""

import math
from pathlib import Path

import duckdb


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


def rows_of(relation, columns):
    return sorted((tuple(norm(v) for v in r) for r in relation), key=str)


def same(spark, folder, query, sql):
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = query(spark, folder)
    columns = sorted(df.columns)
    rel = con.sql(sql)
    assert sorted(rel.columns) == columns
    want = rows_of(con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({sql.strip()})").fetchall(), columns)
    got = rows_of(df.select(*[f"`{c}`" for c in columns]).collect(), columns)
    assert got == want
