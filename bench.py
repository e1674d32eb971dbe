"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from basalt.plans import catalogue
from basalt.session import session

HEADLINE = (
    "revenue_by_nation_top10", "top_products", "monthly_revenue", "revenue_by_region", "top3_products_nation_month", "cumulative_revenue",
    "revenue_share", "monthly_orders_aov", "category_quarter_growth", "top10_customers", "weekend_share", "discount_leakage",
    "customer_pareto", "basket_distribution", "join_point_in_time", "current_vs_history", "refund_rate_month", "fact_sales",
    "three_models", "topn_per_group", "reconcile_sales",
)


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", 8, **{"spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: catalogue.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
    run(HEADLINE[0])  # compile and warm up once
    times = {}
    for name in HEADLINE:
        best = []
        for _ in range(2):
            began = time.perf_counter()
            run(name)
            best.append(time.perf_counter() - began)
        times[name] = round(min(best), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
