"""Runs a registered query on Spark and its SQL twin on DuckDB and compares them like the driver does."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _value(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(repr(_value(row[i])) for i in order) for row in rows))


UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


def compare(spark, con, sf_dir: str, run, sql: str) -> tuple[bool, str]:
    df = run(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = [node for node in UNWANTED if node in plan]
    if found:
        return False, f"plan holds {found}"
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}"
    kinds = {n: type(v).__name__ for row in want[:50] for n, v in zip(names, row) if v is not None}
    mine = {n: type(v).__name__ for row in got[:50] for n, v in zip(df.columns, row) if v is not None}
    bad = {n: (mine[n], kinds[n]) for n in kinds if n in mine and mine[n] != kinds[n]}
    if bad:
        return False, f"types {bad}"
    a, b = _rows(df.columns, got), _rows(names, want)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        return False, f"{len(diff)} rows differ, first: {sorted(names)}\n   spark {diff[0][0]}\n   duck  {diff[0][1]}"
    return True, f"{len(got)} rows"


def main(sf: str, wanted: list[str]) -> int:
    import __spark_entry__ as entry
    from agropanel.session import local_session

    spark = local_session()
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    runs, sqls = entry.queries(), entry.oracle_sql()
    failed = []
    for name, run in runs.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in sqls:
                ok, text = compare(spark, con, sf_dir, run, sqls[name])
            else:
                ok, text = True, f"{run(spark, sf_dir).count()} rows (no SQL)"
        except Exception as error:
            ok, text = False, f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - start:6.2f}s {text}", flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)
    return len(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "0.01", sys.argv[2:]))
