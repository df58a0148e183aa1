"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose data
and cores. Every query runs in full into a sink that discards its rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tenderloom.plans.inputs import Inputs
from tenderloom.plans.registry import QUERIES, presentable
from tenderloom.session import build_session

HEADLINE = (
    "price_for_demand",
    "recommend_order",
    "tier_lookup",
    "best_contract_price",
    "best_tiered_price",
    "article_catalog",
    "search_articles",
    "integrity_report",
    "price_insights",
    "category_price_insights",
    "merge_products",
    "rank_suppliers",
    "cheaper_alternatives",
    "contract_vs_market",
    "cost_rfq",
    "audit_ean_catalog",
    "name_search",
    "similar_names",
    "enrich_procurement",
    "facet_aggregate",
    "facet_percentile",
    "service_health",
    "usage_rollup",
    "flatten_logs",
    "mine_pages",
    "stream_service_health",
)


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        shuffle_partitions=int(cpus),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One small query loads classes, so the first timing is not the JVM's start.
    QUERIES["contract_overview"](Inputs(spark, path)).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        presentable(QUERIES[name](Inputs(spark, path))).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(path.rstrip("/")),
                "cpus": int(cpus),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
