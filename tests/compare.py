"""Rows of a Spark query against rows of SQL in DuckDB, over the same Parquet tables."""

from __future__ import annotations

import glob
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if v is None:
        return ("", "")
    if isinstance(v, bool):
        return ("b", str(v))
    if isinstance(v, float):
        return ("n", "nan" if math.isnan(v) else f"{v + 0.0:.4f}")
    if isinstance(v, int):
        return ("n", f"{v:.4f}")
    try:
        from decimal import Decimal

        if isinstance(v, Decimal):
            return ("n", f"{float(v):.4f}")
    except ImportError:
        pass
    return ("s", str(v))


def duck_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    import duckdb

    c = duckdb.connect()
    c.execute("SET threads=4")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({(glob.glob(p + '/*.parquet') if os.path.isdir(p) else p)!r})")
    r = c.execute(sql)
    return [x[0] for x in r.description], r.fetchall()


def differences(df, sql: str, sf_dir: str) -> str:
    """Empty if the rows agree."""
    names, want = duck_rows(sql, sf_dir)
    cols = sorted(names)
    if sorted(df.columns) != cols:
        return f"columns {sorted(df.columns)} and {cols}"
    order = [names.index(c) for c in cols]
    a = sorted(tuple(_norm(v) for v in r) for r in df.select(*(f"`{c}`" for c in cols)).collect())
    b = sorted(tuple(_norm(r[k]) for k in order) for r in want)
    if len(a) != len(b):
        return f"{len(a)} rows and {len(b)}"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if any(p != q and not (p[0] == q[0] == "n" and abs(float(p[1]) - float(q[1])) < 2e-4 * max(1.0, abs(float(p[1])))) for p, q in zip(x, y, strict=True))]
    return f"{len(bad)} rows differ, such as {bad[0]}" if bad else ""
