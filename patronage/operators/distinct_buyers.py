"""Exact numbers of distinct buyers over any mix of periods and slices, from bitmaps that merge.

Counts of distinct customers do not add up; bitmaps of their ids do. Purchases are reduced once to a
bitmap for each finest slice and block of 32,768 ids (4 KB each); any coarser slice or longer period is the union of those.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def buyer_bitmaps(purchases: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., block, buyers): one row for each finest slice and block of ids. Customers are made distinct first, which is combined
    before the shuffle, so one who buys without end costs a row per task. Refunds are no purchases; a null id is no buyer."""
    buyers = purchases.where("amount >= 0 AND customer_id IS NOT NULL").select(*by, "customer_id").distinct()
    bit = F.bitmap_bit_position("customer_id")
    return buyers.groupBy(*by, F.bitmap_bucket_number("customer_id").alias("block")).agg(F.bitmap_construct_agg(bit).alias("buyers"))


def distinct_buyers(bitmaps: DataFrame, by: Sequence[str], sets: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """Buyers at every level: (by..., level, customers); reads bitmaps only.

    ``sets`` are the grouping sets, by default every combination of ``by``. ``level`` tells which columns are rolled up, as
    ``grouping_id`` does; NULL in a column that is not is a slice of its own.
    """
    spark = bitmaps.sparkSession
    columns = ", ".join(by)
    levels = [[*subset] for subset in sets] if sets is not None else [[c for n, c in enumerate(by) if mask >> n & 1] for mask in range(1 << len(by))]
    grouped = ", ".join(f"({', '.join([*level, 'block'])})" for level in levels)
    used, kinds = {c for level in levels for c in level}, dict(bitmaps.dtypes)
    grouping = " + ".join(f"{f'CAST(grouping({c}) AS BIGINT)' if c in used else '1L'} * {1 << (len(by) - 1 - n)}" for n, c in enumerate(by))
    told = ", ".join(c if c in used else f"CAST(NULL AS {kinds[c]}) AS {c}" for c in by)
    return spark.sql(
        f"""
        WITH merged AS (
            SELECT {told}, {grouping} AS level, block, bitmap_or_agg(buyers) AS buyers
            FROM {{bitmaps}} GROUP BY GROUPING SETS ({grouped}))
        SELECT {columns}, level, sum(bitmap_count(buyers)) AS customers FROM merged GROUP BY {columns}, level
        """,
        bitmaps=bitmaps,
    )
