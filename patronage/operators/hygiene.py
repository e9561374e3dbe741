"""Input hygiene: validity, repeated transactions, observation window."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.functions.columns import midnight
from patronage.operators.refunds import settle_refunds


def reject_reason(net: bool = False) -> Column:
    """Why a row cannot be used, or NULL. Negative amounts are refunds, kept with ``net``."""
    reason = (
        F.when(F.col("customer_id").isNull(), "missing customer")
        .when(F.col("txn_id").isNull(), "missing transaction")
        .when(F.col("ts").isNull(), "missing time")
        .when(F.col("amount").isNull(), "missing amount")
    )
    return reason if net else reason.when(F.col("amount") < 0, "negative amount")


def split_valid(purchases: DataFrame, net: bool = False) -> tuple[DataFrame, DataFrame]:
    """The usable rows, and the others with the reason each was rejected."""
    judged = purchases.withColumn("reason", reject_reason(net))
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def reject_summary(purchases: DataFrame, net: bool = False) -> DataFrame:
    """How many rows passed and how many failed for each reason."""
    return (
        purchases.select(F.coalesce(reject_reason(net), F.lit("valid")).alias("outcome"), "amount")
        .groupBy("outcome")
        .agg(F.count("*").alias("n_rows"), F.sum("amount").cast("decimal(38,2)").alias("amount"))
    )


def dedup(purchases: DataFrame) -> DataFrame:
    """One row per transaction: the earliest, then lowest customer, then lowest amount.

    Refunds under the id of their purchase are transactions of their own, as many as differ in time, amount or customer. A
    minimum over a struct picks the same row on every run and is combined before the
    shuffle, so a transaction repeated without end still sends one row per task.
    """
    refund = F.when(F.col("amount") < 0, F.struct("customer_id", "ts", "amount"))
    return (
        purchases.groupBy("txn_id", refund.alias("refund"))
        .agg(F.min(F.struct("ts", "customer_id", "amount")).alias("first"))
        .select("first.customer_id", "txn_id", "first.ts", "first.amount")
    )


def observe(purchases: DataFrame, as_of: str | dt.date, start: str | dt.date | None = None) -> DataFrame:
    """The observation window ``start <= ts < as_of``."""
    seen = purchases.where(F.col("ts") < midnight(as_of))
    return seen if start is None else seen.where(F.col("ts") >= midnight(start))


def clean_purchases(
    purchases: DataFrame,
    as_of: str | dt.date,
    start: str | dt.date | None = None,
    net: bool = False,
    unique: bool = False,
    settled: bool = False,
) -> DataFrame:
    """Valid, deduplicated purchases inside the window.

    The upper bound is applied before deduplication and reaches the scan: the earliest
    copy of a transaction survives, and it cannot be cut off by an upper bound that a
    later copy passes. The lower bound could change the survivor, so it comes after.
    ``unique=True`` states that transaction ids do not repeat and saves that shuffle.
    ``net=True`` keeps every refund; ``settled=True`` those parts of them that their sales cover.
    """
    valid, _ = split_valid(purchases, net or settled)
    if settled:
        seen = settle_refunds(observe(valid, as_of))[0]
    elif unique:
        return observe(valid, as_of, start)
    else:
        seen = dedup(observe(valid, as_of))
    return seen if start is None else seen.where(F.col("ts") >= midnight(start))
