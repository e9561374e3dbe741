"""Time the operators on a skewed table made for the purpose, and print one JSON line.

One customer has a third of the purchases, one transaction id a tenth of them, one amount half.
SKEW_ROWS (24 million), SKEW_CUSTOMERS (2 million), BENCH_CPUS and SKEW_PARTITIONS (64) set the size.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from patronage.operators import history, hygiene, indicators, reports, scoring
from patronage.session import build_session, materialize

AS_OF = "2024-01-01"


def skewed(spark: SparkSession, rows: int, customers: int) -> DataFrame:
    """The same rows on every run: everything follows from the row number."""
    return spark.range(rows).selectExpr(
        f"CASE WHEN id % 3 = 0 THEN 0 ELSE pmod(xxhash64(id), {customers}) END AS customer_id",
        "CASE WHEN id % 10 = 1 THEN -1 ELSE id END AS txn_id",
        "CAST(timestamp_seconds(1546300800 + pmod(xxhash64(id, 'ts'), 157766400)) AS timestamp_ntz) AS ts",
        "CAST(CASE WHEN id % 2 = 0 THEN 10 ELSE pmod(xxhash64(id, 'amount'), 1000000) / 100 END AS decimal(18,2)) AS amount",
    )


def main() -> None:
    cpus, partitions = os.environ.get("BENCH_CPUS", "8"), os.environ.get("SKEW_PARTITIONS", "64")
    spark = build_session(
        "patronage-skew", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": partitions, "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("OFF")
    purchases = materialize(skewed(spark, int(os.environ.get("SKEW_ROWS", 24_000_000)), int(os.environ.get("SKEW_CUSTOMERS", 2_000_000))))
    seconds: dict[str, float] = {}

    def timed(name: str, step):
        start = time.perf_counter()
        found = step()
        if found is not None:
            found.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 2)

    base: list[DataFrame] = []

    def write_base(unique: bool) -> None:
        base.append(materialize(indicators.rfm_base(hygiene.clean_purchases(purchases, AS_OF, unique=unique), AS_OF), "base"))

    timed("indicators with deduplication, written", lambda: write_base(False))
    timed("indicators, ids declared unique, written", lambda: write_base(True))
    timed("rank scores", lambda: scoring.score_rank(base[1]))
    timed("equal-size scores", lambda: scoring.score_ntile(base[1]))
    timed("ABC classes", lambda: reports.value_classes(base[1]))
    timed("top shares", lambda: reports.top_share(base[1]))
    timed("concentration curve", lambda: reports.pareto(base[1]))
    timed("purchase gaps", lambda: indicators.purchase_gaps(purchases))
    timed("month-by-month migration, 7 dates", lambda: history.migration_series(purchases, "2023-06-01", "2023-12-01"))
    spark.stop()
    print(json.dumps({"metric": "seconds on a skewed table", "value": round(sum(seconds.values()), 2), "unit": "sec", "steps": seconds}))


if __name__ == "__main__":
    main()
