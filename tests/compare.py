"""Run a registered query on Spark and its SQL twin on DuckDB and compare the rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if hasattr(value, "asDict"):
        return {k: _plain(v) for k, v in value.asDict().items()}
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(repr(_plain(r[i])) for i in order) for r in rows))


def compare(spark_df, con, sql: str) -> str | None:
    """None if both sides hold the same rows, else what differs."""
    got = spark_df.collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    bad = [n for n, t in types.items() if "HUGEINT" in t.upper() or "DECIMAL" in t.upper()]
    if bad:
        return f"SQL column types: { {n: types[n] for n in bad} }"
    odd = [(n, t) for n, t in spark_df.dtypes if (t in ("bigint",)) != (types[n].upper() in ("NUMBER", "BIGINT"))]
    if odd and any(t in ("int", "bigint") for _, t in odd):
        odd = [(n, t, types[n]) for n, t in odd]
    a, b = rows_of(spark_df.columns, [tuple(r) for r in got]), rows_of(names, want)
    if a == b:
        return None
    sa, sb = set(a), set(b)
    return (f"rows {len(a)} vs {len(b)}; columns {sorted(names)}\n only spark: {sorted(sa - sb)[:4]}\n"
            f" only sql: {sorted(sb - sa)[:4]}")
