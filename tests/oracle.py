"""Run registered queries beside their SQL and compare.  ``python tests/oracle.py [sf] [name...]``"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, float(v))
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return (0, "") if math.isnan(f) else (1, f + 0.0)
    return (2, str(v))


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(canon(r[i]) for i in order) for r in rows]
    # sort on values cut to a few digits so that last-digit noise does not reorder rows
    key = lambda r: tuple((a, round(b, 4) if a == 1 else b) for a, b in r)
    return [cols[i] for i in order], sorted(out, key=lambda r: [(a, str(b) if a == 2 else b if a == 1 else "") for a, b in key(r)])


def same(a, b, tol=1e-9):
    if a[0] != b[0]:
        return False
    if a[0] == 1:
        return abs(a[1] - b[1]) <= tol * max(1.0, abs(a[1]), abs(b[1]))
    return a == b


def compare(cols_a, rows_a, cols_b, rows_b):
    ca, a = table(cols_a, rows_a)
    cb, b = table(cols_b, rows_b)
    if ca != cb:
        return f"columns {ca} / {cb}"
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}; first only-left {next((r for r in a if r not in set(b)), None)} right {next((r for r in b if r not in set(a)), None)}"
    near = 0
    for x, y in zip(a, b):
        if x != y:
            if not all(same(i, j) for i, j in zip(x, y)):
                if not all(same(i, j, 2e-6) for i, j in zip(x, y)):
                    return f"values {ca}: {x} / {y}"
            near += 1
    return f"near:{near}" if near else ""


def check(spark, con, sf_dir, name):
    import __spark_entry__ as e

    df = e.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    sql = e.oracle_sql().get(name)
    if not sql:
        return len(rows), "rows-only"
    cur = con.execute(sql)
    return len(rows), compare(df.columns, rows, [d[0] for d in cur.description], cur.fetchall())


if __name__ == "__main__":
    from skyloom.session import session
    import __spark_entry__ as e

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    d = f"/root/testdata/sf{sf}"
    names = sys.argv[2:] or list(e.queries())
    if len(names) == 1 and names[0].startswith("q_"):
        names = [n for n, q in e.REGISTRY.items() if q.build.__module__.endswith(names[0])]
    spark = session("local[8]", 8, **{"spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    con = connect(d)
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            k, msg = check(spark, con, d, n)
        except Exception as ex:  # noqa: BLE001
            k, msg = -1, f"{type(ex).__name__}: {str(ex)[:400]}"
        ok = msg in ("", "rows-only") or msg.startswith("near")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {n} rows={k} {time.time()-t0:.1f}s {msg}", flush=True)
    print("bad", bad)
