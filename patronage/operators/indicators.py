"""Recency, frequency and monetary value of every customer."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronage.functions.columns import days_since, money, total

NEVER = "never_purchased"


def indicator_aggregates() -> list[Column]:
    """Last purchase, number of purchases and revenue; a refund only counts in the last."""
    bought = F.col("amount") >= 0
    return [
        F.to_date(F.max(F.when(bought, F.col("ts")))).alias("last_purchase"),
        F.count(F.when(bought, 1)).alias("frequency"),
        total(F.col("amount")).alias("monetary"),
    ]


def rfm_base(purchases: DataFrame, as_of: str | dt.date) -> DataFrame:
    """The three indicators in one aggregation, one row per customer who bought.

    Expects the output of ``clean_purchases`` for the same ``as_of``. All three are
    combined before the shuffle, so a customer with a third of all purchases costs one
    row per task. A customer with refunds only has not bought and is left out.
    """
    return (
        purchases.groupBy("customer_id")
        .agg(*indicator_aggregates())
        .where("frequency > 0")
        .withColumn("recency_days", days_since(as_of, F.col("last_purchase")))
        .select("customer_id", "last_purchase", "recency_days", "frequency", "monetary")
    )


def relative_base(purchases: DataFrame, as_of: str | dt.date) -> DataFrame:
    """The indicators with "how often" as a rate and "how much" as an average, in the same layout.

    ``frequency`` is purchases per million days since the first one and ``monetary`` the average
    purchase in whole cents, both rounded down, so every scorer takes them as they are.
    """
    bought = F.when(F.col("amount") >= 0, F.col("ts"))
    tenure = F.greatest(days_since(as_of, F.col("first_purchase")), F.lit(1))
    cents = F.expr("CAST(CAST(monetary * 100 AS DECIMAL(36,0)) AS BIGINT) div frequency")
    return (
        purchases.groupBy("customer_id")
        .agg(*indicator_aggregates(), F.to_date(F.min(bought)).alias("first_purchase"))
        .where("frequency > 0")
        .withColumn("recency_days", days_since(as_of, F.col("last_purchase")))
        .withColumn("tenure", tenure)
        .withColumn("monetary", (cents.cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast("decimal(38,2)"))
        .withColumn("frequency", F.expr("frequency * 1000000 div tenure"))
        .select("customer_id", "last_purchase", "recency_days", "frequency", "monetary")
    )


def with_non_buyers(customers: DataFrame, segments: DataFrame) -> DataFrame:
    """Every customer, those without purchases in a group of their own and without scores.

    Buyers whom the customer table does not know are kept as well.
    """
    return (
        customers.select("customer_id")
        .join(segments, "customer_id", "full_outer")
        .withColumn("frequency", F.coalesce("frequency", F.lit(0).cast("bigint")))
        .withColumn("monetary", F.coalesce("monetary", money(0)))
        .withColumn("segment", F.coalesce("segment", F.lit(NEVER)))
        .withColumn("value_tier", F.coalesce("value_tier", F.lit("none")))
    )


def non_buyers(customers: DataFrame, purchases: DataFrame) -> DataFrame:
    """Customers without any purchase."""
    return customers.select("customer_id").join(
        purchases.select("customer_id").distinct(), "customer_id", "left_anti"
    )


def purchase_rate(purchases: DataFrame, as_of: str | dt.date) -> DataFrame:
    """Frequency as a rate: purchases per day since the first one. Refunds are no purchases."""
    return (
        purchases.where("amount >= 0").groupBy("customer_id")
        .agg(
            F.to_date(F.min("ts")).alias("first_purchase"),
            F.count("*").alias("frequency"),
        )
        .withColumn("tenure_days", days_since(as_of, F.col("first_purchase")))
        .withColumn("purchases_per_day", F.col("frequency").cast("double") / F.col("tenure_days"))
    )


def purchase_gaps(purchases: DataFrame) -> DataFrame:
    """Days between consecutive purchase days: total, number, shortest and longest.

    Purchases are reduced to (customer, day) before the window, which so sees at most one
    row per day of the observation period however much a customer buys. Refunds are no
    purchases.
    """
    in_order = Window.partitionBy("customer_id").orderBy("day")
    return (
        purchases.where("amount >= 0").select("customer_id", F.to_date("ts").alias("day"))
        .distinct()
        .withColumn("gap", F.date_diff("day", F.lag("day").over(in_order)).cast("bigint"))
        .groupBy("customer_id")
        .agg(
            F.coalesce(F.sum("gap"), F.lit(0)).cast("bigint").alias("sum_gap"),
            F.count("gap").alias("n_gaps"),
            F.min("gap").alias("shortest_gap"),
            F.max("gap").alias("longest_gap"),
        )
    )


