"""Spark and DuckDB side by side."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return con


def same_rows(df, sql, sf_dir):
    con = duck(sf_dir)
    cols = sorted(df.columns)
    rel = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({sql.strip().rstrip(';')}) q")
    key = lambda r: tuple("" if x is None else f"{x:.9g}" if isinstance(x, float) and not math.isnan(x) else str(x) for x in r)
    want = sorted(map(key, rel.fetchall()))
    got = sorted(key(tuple(r)) for r in df.select(cols).collect())
    assert len(got) == len(want), (len(got), len(want))
    diff = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not diff, diff[:3]
    return len(got)
