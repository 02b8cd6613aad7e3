"""Run registered queries next to their oracles and report differences.

usage: python -m checks.compare [--sf DIR] [--only name,name] [--cpus N] [--shuffle]

With --shuffle nothing is broadcast by size, so every large join takes the way it takes at scale.
"""

from __future__ import annotations

import argparse
import math
import time
from decimal import Decimal

import duckdb
from pyspark.sql import SparkSession

from checks.catalog import CHECKS
from tradewind.operators import skew
from tradewind.session import build_session

VIEWS = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6))
    if isinstance(value, Decimal):
        return format(value, "f")
    if isinstance(value, dict):
        return str(sorted(value.items()))
    if hasattr(value, "asDict"):
        return str({k: _plain(v) for k, v in value.asDict().items()})
    if isinstance(value, list):
        return str([_plain(v) for v in value])
    return str(value)


def _rows(columns, rows):
    names = sorted(columns)
    places = [columns.index(n) for n in names]
    return names, sorted(tuple(_plain(r[i]) for i in places) for r in rows)


def compare(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, int, float, float]:
    entry = CHECKS[name]
    start = time.time()
    df = entry.run(spark, sf_dir)
    got = df.collect()
    spent = time.time() - start
    if entry.sql is None:
        return "rows only", len(got), spent, 0.0
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for view in VIEWS:
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM read_parquet('{sf_dir}/{view}.parquet')")
    start = time.time()
    cursor = con.execute(entry.sql)
    columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    oracle_spent = time.time() - start
    con.close()
    a_names, a = _rows(df.columns, got)
    b_names, b = _rows(columns, expected)
    if a_names != b_names:
        return f"COLUMNS {a_names} != {b_names}", len(got), spent, oracle_spent
    if a != b:
        extra = [r for r in a if r not in set(b)][:2]
        missing = [r for r in b if r not in set(a)][:2]
        return f"VALUES {len(a)} / {len(b)} rows; extra {extra}; missing {missing}", len(got), spent, oracle_spent
    return "ok", len(got), spent, oracle_spent


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--only", default="")
    parser.add_argument("--cpus", type=int, default=8)
    parser.add_argument("--shuffle", action="store_true")
    args = parser.parse_args()
    settings = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    if args.shuffle:
        skew.fits_broadcast = lambda *_: False
        settings["spark.sql.autoBroadcastJoinThreshold"] = "-1"
    spark = build_session("checks", f"local[{args.cpus}]", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    wanted = [n for n in args.only.split(",") if n] or list(CHECKS)
    bad = 0
    for name in wanted:
        try:
            verdict, rows, spent, oracle_spent = compare(spark, args.sf, name)
        except Exception as error:  # noqa: BLE001
            verdict, rows, spent, oracle_spent = f"ERROR {str(error)[:600]}", 0, 0.0, 0.0
        bad += verdict not in ("ok", "rows only")
        note = " (EMPTY)" if rows == 0 and verdict == "ok" else ""
        print(f"{name:36s} {rows:8d} rows {spent:6.2f}s oracle {oracle_spent:5.2f}s {verdict}{note}", flush=True)
    print(f"{len(wanted)} queries, {bad} bad")
    spark.stop()


if __name__ == "__main__":
    main()
