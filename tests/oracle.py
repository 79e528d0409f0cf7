"""Runs registered queries and their SQL side by side: python tests/oracle.py [--sf DIR] [NAME...]."""

import math
import os
import sys
import tempfile
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int) or type(v).__name__ == "Decimal":
        return float(f"{float(v):.9g}") if type(v).__name__ == "Decimal" else v
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(str(plain(r[i])) for i in order) for r in rows)


def compare(spark, con, sf, name, query, sql):
    df = query(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"{sum(got[1].values())} rows, no SQL"
    cur = con.execute(sql)
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got == want:
        return None
    if got[0] != want[0]:
        return f"columns {got[0]} against {want[0]}"
    return f"{sum(got[1].values())} against {sum(want[1].values())} rows; only here {list((got[1] - want[1]).items())[:3]}; only in SQL {list((want[1] - got[1]).items())[:3]}"


if __name__ == "__main__":
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    args = sys.argv[1:]
    sf = args.pop(args.index("--sf") + 1) if "--sf" in args else "/root/testdata/sf0.01"
    names = [a for a in args if a != "--sf"]
    os.environ.setdefault("TZ", "UTC")
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp()).getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con, sqls = connect(sf), e.oracle_sql()
    for name, q in e.queries().items():
        if names and name not in names or not names and (name.startswith("op") and name[2].isdigit() or name == "pipeline"):
            continue
        began = time.time()
        try:
            said = compare(spark, con, sf, name, q, sqls.get(name))
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:400]}"
        print(f"{'ok  ' if said is None else 'note' if 'no SQL' in said else 'BAD '} {name} {time.time() - began:.1f} s {said or ''}", flush=True)
