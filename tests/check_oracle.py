"""Run registered queries beside their SQL twins: ``python -m tests.check_oracle [sf] [name ...]``."""

from __future__ import annotations

import datetime
import math
import sys
import tempfile
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def compare(spark, folder: str, name: str, plan, sql: str | None, con=None) -> tuple[bool, str]:
    start = time.time()
    df = plan(spark, folder)
    got = df.collect()
    took = time.time() - start
    if sql is None:
        return True, f"rows only: {len(got)} rows, {took:.1f}s"
    con = con or duck(folder)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} against {sorted(names)}"
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
            "date": "DATE"}
    off = [f"{f}:{t}/{types[f]}" for f, t in df.dtypes if same.get(t) != types[f]]
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        extra = [r for r in a if r not in set(b)][:3]
        lack = [r for r in b if r not in set(a)][:3]
        return False, f"{len(a)} rows against {len(b)}\n   spark {extra}\n   sql   {lack}"
    return not off, f"{len(a)} rows, {took:.1f}s" + (f" TYPES {off}" if off else "") + (" EMPTY" if not a else "")


def main() -> int:
    from tidewell.session import build_session

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = build_session("check", "local[8]", **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-", dir="/tmp"), "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    plans, sqls = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[2:]
    names = [n for n in plans if not wanted or n in wanted or any(w.endswith("*") and n.startswith(w[:-1]) for w in wanted)]
    con, bad = duck(folder), 0
    for n in names:
        try:
            ok, note = compare(spark, folder, n, plans[n], sqls.get(n), con)
        except Exception as e:  # noqa: BLE001 - report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + n + ": " + note, flush=True)
    print(f"{len(names)} queries, {bad} failed, {len(sqls)} with SQL")
    return bad


if __name__ == "__main__":
    sys.exit(main())
