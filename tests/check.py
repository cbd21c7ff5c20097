"""Run registered queries next to their SQL twins in DuckDB:  python tests/check.py [names...]"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def spark_session(cpus=8, **conf):
    from pyspark.sql import SparkSession

    b = (SparkSession.builder.master(f"local[{cpus}]").appName("check").config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
         .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true"))
    for k, v in conf.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def duck(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return repr(round(float(v), 6) + 0.0)
    return str(v)


def table(cols, rows):
    idx = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in idx], sorted((tuple(norm(r[i]) for i in idx) for r in rows), key=repr)


def compare(spark, con, folder, name):
    import __spark_entry__ as e

    t0 = time.time()
    df = e.queries()[name](spark, folder)
    rows = df.collect()
    t1 = time.time()
    got = table(df.columns, rows)
    sql = e.oracle_sql().get(name)
    if sql is None:
        return "rows-only", len(rows), t1 - t0, ""
    cur = con.execute(sql)
    want = table([d[0] for d in cur.description], cur.fetchall())
    if got == want:
        return ("ok" if rows else "EMPTY"), len(rows), t1 - t0, ""
    if got[0] != want[0]:
        return "FAIL", len(rows), t1 - t0, f"columns {got[0]} vs {want[0]}"
    w, g = set(want[1]), set(got[1])
    extra = [r for r in got[1] if r not in w][:3]
    miss = [r for r in want[1] if r not in g][:3]
    return "FAIL", len(rows), t1 - t0, f"{len(got[1])} vs {len(want[1])}\n   spark {extra}\n   sql   {miss}"


if __name__ == "__main__":
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    import __spark_entry__ as e

    names = [n for n in e.queries() if not sys.argv[1:] or any(n.startswith(a) for a in sys.argv[1:])]
    spark, con = spark_session(), duck(folder)
    bad = 0
    for n in names:
        try:
            st, k, sec, msg = compare(spark, con, folder, n)
        except Exception as ex:  # noqa: BLE001
            st, k, sec, msg = "ERROR", 0, 0, str(ex)[:900]
        bad += st in ("FAIL", "ERROR")
        print(f"{st:9} {k:7} {sec:6.2f}s {n} {msg}", flush=True)
    print("bad:", bad, "of", len(names))
