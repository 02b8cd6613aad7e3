"""Headline queries on one machine; prints one JSON line.

BENCH_SF_DIR names the folder of test tables, BENCH_CPUS the number of local threads. The star schema
is written first and timed as a query of its own; the reports then read it, as they would read a
warehouse. Every query runs once, or BENCH_RUNS times, of
which the fastest counts.
"""

from __future__ import annotations

import json
import os
import time

from checks import star
from checks.catalog import CHECKS
from tradewind.session import build_session

QUERIES = [
    "growth_report_platform",
    "growth_report_filtered",
    "best_seller_report",
    "best_seller_page_by_units",
    "best_seller_positions",
    "top_categories_by_amount",
    "price_bands",
    "analysis_bundle",
    "latest_rows_per_key",
    "older_against_latest",
    "star_join",
    "growth_per_period",
    "adjusted_fact_delta",
    "products_p11",
    "upserted_products",
    "built_facts_p12",
    "deduplicated_sales",
    "sold_texts",
    "page_links",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(2 * cpus),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    start = time.perf_counter()
    for name in star.BUILDERS:
        star.stored(spark, sf_dir, name)
    times["star_schema_load"] = round(time.perf_counter() - start, 3)
    for name in QUERIES:
        spent = []
        for _ in range(runs):
            start = time.perf_counter()
            CHECKS[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - start)
            spark.catalog.clearCache()
        times[name] = round(min(spent), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
