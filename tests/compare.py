"""Runs queries beside their SQL on one folder of tables."""

import glob
import math
import os

import duckdb


def duck(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 7) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


def same(df, con, sql):
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    want, got = rows(names, out.fetchall()), rows(df.columns, df.collect())
    assert sorted(names) == sorted(df.columns), (names, df.columns)
    if len(want) != len(got):
        return f"{len(got)} rows, SQL {len(want)}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w and not all(a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-6 + 5e-6 * abs(a)) for a, b in zip(g, w, strict=True))]
    return f"{len(bad)} rows differ: {bad[:2]}" if bad else ""
