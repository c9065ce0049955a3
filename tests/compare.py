"""Run named queries in Spark and DuckDB and compare them row by row.

    python -m tests.compare [sf folder] [name ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

from driftloom.plans.adapters import BASE_TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(normal(r[i]) for i in order) for r in rows)


KINDS = {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "BOOLEAN": "boolean",
         "TIMESTAMP": "timestamp_ntz", "DATE": "date", "FLOAT": "float"}


def compare(spark, con, sf_dir: str, fn, sql: str) -> str:
    """Empty text when equal, else what differs."""
    df = fn(spark, sf_dir)
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    kinds = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in res.description}
    want = rows_of(names, res.fetchall())
    got = rows_of(df.columns, df.collect())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if got != want:
        only_got, only_want = list((got - want).items())[:2], list((want - got).items())[:2]
        return f"rows {sum(got.values())} vs {sum(want.values())}\n  spark {only_got}\n  sql   {only_want}"
    types = {n: t for n, t in df.dtypes if t != kinds[n]}
    if types:
        return "types " + ", ".join(f"{n}: {t} != {kinds[n]}" for n, t in types.items())
    return "" if sum(got.values()) else "no rows"


def main() -> None:
    import __spark_entry__ as entry
    from driftloom.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8",
                          spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, sf_dir, fn, oracles[name])
            else:
                n = fn(spark, sf_dir).count()
                problem = "" if n else "no rows"
                name += f" (rows only, {n})"
        except Exception as exc:  # keep going: report every query
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.2f}s {problem}", flush=True)
    print(f"{bad} problem(s)")


if __name__ == "__main__":
    main()
