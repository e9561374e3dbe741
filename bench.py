"""Time the headline queries and print one JSON line.

Each query is run to the end (every row computed, none kept), once to warm up and once
timed. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores.
"""

from __future__ import annotations

import json
import os
import time

from patronage.catalog import QUERIES
from patronage.session import build_session

HEADLINE = (
    "rfm_base", "dedup_shipments", "net_revenue", "score_rank", "score_ntile", "score_fitted", "score_nested",
    "customer_segments", "segment_summary", "rf_matrix", "value_classes", "concentration", "top_share",
    "by_attribute", "top_customers", "purchase_gaps", "monthly_snapshots", "trailing_snapshots", "migration",
    "monthly_migration", "stream_indicators",
)


def run(spark, name: str, directory: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "patronage-bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    for name in HEADLINE:
        run(spark, name, directory)
    seconds = {name: round(run(spark, name, directory), 3) for name in HEADLINE}
    result = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
