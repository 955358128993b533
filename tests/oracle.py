"""Run registered queries next to their SQL in DuckDB: ``python tests/oracle.py [names or prefixes] [--sf DIR]``."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def database(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float) and not math.isfinite(v):
        return str(v)
    if isinstance(v, (int, float)) or v.__class__.__name__ == "Decimal":
        return repr(float(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted("|".join(canonical(r[i]) for i in order) for r in rows)


def compare(con, df, sql):
    rel = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in rel.description], rel.fetchall())
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; first got {got[:2]} want {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[:2]}" if bad else ""


def main(argv):
    from talkgrid.session import local_session
    import __spark_entry__ as entry
    sf = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    spark = local_session()
    con = database(sf)
    queries, sqls = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(n.startswith(a) for a in argv)]
    failed = 0
    for n in names:
        t = time.time()
        try:
            df = queries[n](spark, sf)
            if n in sqls:
                problem = compare(con, df, sqls[n])
                count = ""
            else:
                count = f" rows={df.count()}"
                problem = ""
        except Exception as exc:  # noqa: BLE001
            problem, count = f"{type(exc).__name__}: {str(exc)[:700]}", ""
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {n} {time.time() - t:.1f}s{count} {problem}", flush=True)
    print(f"{len(names)} queries, {failed} failed, {sum(n in sqls for n in names)} with SQL")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
