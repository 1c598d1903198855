"""Run registered queries in Spark and their SQL in DuckDB and compare all values."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return f"b{v}"
    if isinstance(v, int):
        return f"i{v}"
    if isinstance(v, float):
        return f"f{v + 0.0!r}"
    if isinstance(v, dt.datetime):
        return f"t{v}"
    if isinstance(v, dt.date):
        return f"d{v}"
    return f"{type(v).__name__}:{v}"


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_value(row[i]) for i in order) for row in rows)


def compare(df, con, sql: str) -> str | None:
    """None if columns and all values are the same, otherwise what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = _rows(names, result.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(expected):
        return f"{len(got)} rows != {len(expected)}"
    differing = [(g, e) for g, e in zip(got, expected) if g != e]
    if differing:
        return f"{len(differing)} of {len(got)} rows differ, first: {differing[0]}"
    return None


def main(sf_dir: str, only: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from recurra.session import local_session

    spark, con = local_session(), connect(sf_dir)
    sql, bad = entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if only and name not in only:
            continue
        started = time.time()
        try:
            if name in sql:
                problem = compare(run(spark, sf_dir), con, sql[name])
                status = "ok" if problem is None else f"DIFF {problem}"
            else:
                status = f"rows {run(spark, sf_dir).count()}"
        except Exception as error:  # report every query, then fail
            status = f"ERROR {str(error)[:600]}"
        bad += not status.startswith(("ok", "rows"))
        print(f"{name:28s} {time.time() - started:6.1f}s {status}", flush=True)
    missing = set(sql) - set(entry.queries())
    print("failed:", bad, "sql without query:", missing)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
