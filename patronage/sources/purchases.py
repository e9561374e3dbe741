"""Sources: anything that records purchases becomes the canonical purchases table.

    customer_id BIGINT, txn_id BIGINT, ts TIMESTAMP_NTZ, amount DECIMAL(18,2)

The readers only select, cast and filter, so column pruning and predicates reach the
Parquet scan.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def purchases_from(
    df: DataFrame,
    customer_id: str | Column,
    txn_id: str | Column,
    ts: str | Column,
    amount: str | Column,
) -> DataFrame:
    """Map any table or stream to purchases.

    What is no id, time or money value (NaN, other text, too large) becomes NULL here and is
    reported by the validity check instead of failing the job.
    """
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(
        as_column(customer_id).try_cast("bigint").alias("customer_id"),
        as_column(txn_id).try_cast("bigint").alias("txn_id"),
        as_column(ts).try_cast("timestamp_ntz").alias("ts"),
        as_column(amount).try_cast(MONEY).alias("amount"),
    )


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def purchases_from_orders(
    spark: SparkSession, directory: str, statuses: Iterable[str] | None = None
) -> DataFrame:
    """One purchase per order; optionally only orders in the given statuses."""
    orders = table(spark, directory, "orders")
    if statuses is not None:
        orders = orders.where(F.col("o_orderstatus").isin(*statuses))
    return purchases_from(orders, "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


def purchase_events(events: DataFrame) -> DataFrame:
    """The purchase events of an event table or stream."""
    bought = events.where(F.col("event_type") == "purchase")
    return purchases_from(bought, "user_id", "event_id", "ts", "value")


def purchases_from_events(spark: SparkSession, directory: str) -> DataFrame:
    return purchase_events(table(spark, directory, "events"))


def _was_returned() -> Column:
    """A line without a return flag was not returned."""
    return F.col("l_returnflag").eqNullSafe("R")


def _discounted() -> Column:
    one = F.lit(1).cast("decimal(4,2)")
    return F.col("l_extendedprice").cast(MONEY) * (one - F.col("l_discount").cast("decimal(4,2)"))


def _billed_orders(spark: SparkSession, directory: str) -> DataFrame:
    """Each order with what its lines are worth: ``sold`` all of them, ``kept`` those not returned.

    Lines are summed per order before the join, which therefore moves one row per order
    and shares the aggregate's partitioning.
    """
    sums = table(spark, directory, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(_discounted()).alias("sold"),
        F.sum(F.when(~_was_returned(), _discounted())).alias("kept"),
        F.max(F.when(_was_returned(), F.col("l_shipdate"))).alias("returned_at"),
    )
    orders = table(spark, directory, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    worth = {name: F.coalesce(name, F.lit(0)).cast(MONEY) for name in ("sold", "kept")}
    return orders.join(sums, "o_orderkey", "left").withColumns(worth)


def purchases_from_lines(spark: SparkSession, directory: str, returned: bool = True) -> DataFrame:
    """One purchase per order, worth its discounted line items.

    ``returned=False`` leaves returned lines out of the amount. An order without any
    line left is still a purchase, worth zero: the customer did buy, so R and F keep it.
    """
    billed = _billed_orders(spark, directory)
    return purchases_from(billed, "o_custkey", "o_orderkey", "o_orderdate", "sold" if returned else "kept")


def purchases_and_refunds(spark: SparkSession, directory: str) -> DataFrame:
    """Each order as a purchase of all its lines, and what was returned of it as one refund.

    Feeds the ``net`` option. The refund is a negative amount under the same transaction,
    dated by the last returned line; the two add up to the lines that were kept.
    """
    billed = _billed_orders(spark, directory)
    sale = F.struct(F.col("o_orderdate").alias("ts"), F.col("sold").alias("amount"))
    refund = F.struct(F.col("returned_at").alias("ts"), (F.col("kept") - F.col("sold")).cast(MONEY).alias("amount"))
    parts = F.when(F.col("returned_at").isNotNull() & (F.col("kept") < F.col("sold")), F.array(sale, refund))
    rows = billed.select("o_custkey", "o_orderkey", F.explode(F.coalesce(parts, F.array(sale))).alias("part"))
    return purchases_from(rows, "o_custkey", "o_orderkey", "part.ts", "part.amount")


def purchases_and_line_refunds(spark: SparkSession, directory: str) -> DataFrame:
    """Each order as a purchase of all its lines, and every returned line as a refund of its own, at list price.

    List prices can exceed what was paid, and lines can be dated before their order: refunds that need to be settled.
    """
    sales = purchases_from(_billed_orders(spark, directory), "o_custkey", "o_orderkey", "o_orderdate", "sold")
    orders = table(spark, directory, "orders").select("o_custkey", "o_orderkey")
    returned = table(spark, directory, "lineitem").where(_was_returned()).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return sales.unionByName(purchases_from(returned, "o_custkey", "o_orderkey", "l_shipdate", -F.col("l_extendedprice").cast(MONEY)))
