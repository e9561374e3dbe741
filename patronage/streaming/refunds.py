"""Refunds in streams: each is matched with its sale as both come in, or told as late.

Sales and refunds are two streams joined on the transaction. State is bounded by two delays: sales wait for refunds as long
as a refund may take (``within``), refunds wait for their sale until the watermark has passed them. What was matched and
what was not is appended to a table, each refund once; how much of a refund its sale still covers is
worked out when that table is read, by the same rule as in a batch.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.operators.refunds import BEYOND, PURCHASE, WITHOUT, taken_back
from patronage.sources.purchases import MONEY
from patronage.streaming.state import state_as_base


def match_refunds(purchases: DataFrame, within: str = "60 days", repeat_within: str = "2 days") -> DataFrame:
    """Every refund of a stream of valid purchases and refunds, with its sale (``sale_ts``, ``sale_amount``) or NULL.

    A refund belongs to the sale of the same transaction and customer that is at most ``within`` older. Repeats of sales
    and refunds that come at most ``repeat_within`` late are dropped; later ones are too late for the watermark and
    are dropped as well. A matched refund comes out at once, an unmatched one when the watermark has passed it.
    """
    late = purchases.withWatermark("ts", repeat_within)
    sales = (
        late.where("amount >= 0").dropDuplicatesWithinWatermark(["txn_id"])
        .select(F.col("txn_id").alias("sale_txn"), F.col("customer_id").alias("sale_customer"), F.col("ts").alias("sale_ts"), F.col("amount").alias("sale_amount"))
    )
    refunds = late.where("amount < 0").dropDuplicatesWithinWatermark(list(PURCHASE)).select(*PURCHASE)
    fits = F.expr(f"txn_id = sale_txn AND customer_id = sale_customer AND ts >= sale_ts AND ts <= sale_ts + INTERVAL {within}")
    joined = refunds.join(sales, fits, "left_outer")
    naive = {name: F.col(name).cast("timestamp_ntz") for name in ("ts", "sale_ts")}
    return joined.withColumns(naive).select(*PURCHASE, "sale_ts", "sale_amount")


def accepted_refunds(matched: DataFrame) -> DataFrame:
    """Refunds of a written table of matches that their sales cover, cut to what each sale had left."""
    found = taken_back(matched.where("sale_ts IS NOT NULL")).where("accepted > 0")
    return found.select("customer_id", "txn_id", "ts", (-F.col("accepted")).cast(MONEY).alias("amount"))


def late_refunds(matched: DataFrame) -> DataFrame:
    """Refunds without a sale, and what of the others lies beyond their sale, with a reason."""
    alone = matched.where("sale_ts IS NULL").select(*PURCHASE, F.lit(WITHOUT).alias("reason"))
    beyond = taken_back(matched.where("sale_ts IS NOT NULL")).withColumn("amount", (F.col("amount") + F.col("accepted")).cast(MONEY))
    return alone.unionByName(beyond.where("amount < 0").select(*PURCHASE, F.lit(BEYOND).alias("reason")))


def net_base(state: DataFrame, matched: DataFrame, as_of: str | dt.date) -> DataFrame:
    """The batch layout of the indicators: running sales less accepted refunds. Refunds are summed before the join."""
    taken = accepted_refunds(matched).groupBy("customer_id").agg(F.sum("amount").alias("taken"))
    net = state.join(taken, "customer_id", "left").withColumn("monetary", (F.col("monetary") + F.coalesce("taken", F.lit(0))).cast("decimal(38,2)"))
    return state_as_base(net, as_of)
