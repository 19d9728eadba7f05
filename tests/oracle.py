"""Side-by-side comparison of a Spark query with its SQL in DuckDB."""

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return str([_plain(v) for v in value])
    return repr(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        tuple(str(_plain(row[i])) for i in order) for row in rows)


def compare(spark, con, function, sql, sf_dir):
    """None when equal, else a description of the first difference."""
    df = function(spark, sf_dir)
    got_columns, got = normal(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want_columns, want = normal([d[0] for d in result.description], result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if not got:
        return "no rows"
    if got != want:
        only_got = sorted(set(got) - set(want))[:3]
        only_want = sorted(set(want) - set(got))[:3]
        return f"{len(got)} vs {len(want)} rows\n spark only: {only_got}\n  duckdb only: {only_want}"
    return None
