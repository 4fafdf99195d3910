"""Runs queries beside their SQL in DuckDB: row counts, column names, and values without regard to order."""

import datetime
import decimal
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x + 0.0:.5f}"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, int):
        return f"{float(x):.5f}"
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return str(x)


def differences(spark, folder, name, run, sql):
    """An empty text if all agree."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    df = run(spark, folder)
    if sorted(columns) != sorted(df.columns):
        return f"{name}: columns {sorted(df.columns)}, SQL {sorted(columns)}"
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    a, b = sorted(tuple(map(plain, r)) for r in got), sorted(tuple(map(plain, r)) for r in want)
    if a != b:
        mine, theirs = set(a), set(b)
        odd = [x for x in a if x not in theirs][:2], [x for x in b if x not in mine][:2]
        return f"{name}: {len(a)} rows, SQL {len(b)}; {odd}"
    return ""
