"""Refunds set against the sales they belong to, a sale at most once over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from patronage.functions.columns import TOTAL_MONEY
from patronage.sources.purchases import MONEY

PURCHASE = ("customer_id", "txn_id", "ts", "amount")
WITHOUT, OTHER, BEFORE, BEYOND = "refund without sale", "refund by another customer", "refund before sale", "refund beyond sale"


def unique_rows(purchases: DataFrame) -> DataFrame:
    """One sale per transaction, the earliest, then lowest customer, then lowest amount, and its refunds without repeats.

    ``refund`` is NULL for the sale, else a struct of time, customer and amount: only rows that agree in these and the transaction
    repeat each other, so a transaction may have any number of partial refunds. Combined before the shuffle.
    """
    row = F.struct("ts", "customer_id", "amount")
    found = purchases.where("amount IS NOT NULL").groupBy("txn_id", F.when(F.col("amount") < 0, row).alias("refund")).agg(F.min(row).alias("first"))
    return found.select("first.customer_id", "txn_id", "first.ts", "first.amount", "refund")


def in_order(*order: str) -> WindowSpec:
    """The rows of a transaction up to each; a window holds those of one transaction."""
    return Window.partitionBy("txn_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def taken_back(refunds: DataFrame, sale_amount: str = "sale_amount", order: tuple[str, ...] = ("ts", "customer_id", "amount"), counts: Column | None = None) -> DataFrame:
    """Refunds of known sales with ``accepted``, the part of each that its sale still covers.

    In order of time, each refund takes up the interval of the sale between the running totals before and after it; what
    lies beyond the sale's amount is not accepted. Rows for which ``counts`` is not true take up nothing.
    """
    own, whole = (-F.col("amount")).cast(TOTAL_MONEY), F.col(sale_amount).cast(TOTAL_MONEY)
    own = own if counts is None else F.when(counts, own).otherwise(F.lit(0).cast(TOTAL_MONEY))
    after = F.sum(own).over(in_order(*order))
    rows = refunds.withColumn("after__", after.cast(TOTAL_MONEY)).withColumn("before__", (F.col("after__") - own).cast(TOTAL_MONEY))
    accepted = F.least("after__", whole) - F.least("before__", whole)
    return rows.withColumn("accepted", accepted.cast(MONEY)).drop("after__", "before__")


def why_unmatched() -> Column:
    return (
        F.when(F.col("sale_ts").isNull(), WITHOUT)
        .when(F.col("sale_customer") != F.col("customer_id"), OTHER)
        .when(F.col("ts") < F.col("sale_ts"), BEFORE)
    )


def settle_refunds(purchases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sales and the refunds that they cover, and what is left of refunds, with a reason.

    Expects valid rows, negative amounts being refunds under the id of their sale. A refund that no sale precedes, or that
    another customer made, is rejected whole; one that exceeds what is left of its sale is cut, and the rest is
    rejected. Accepted and rejected parts add up to all refunds. The purchases are read once: each transaction's sale and then its
    refunds pass by in the order that removing repeats has sorted them into, without a join.
    """
    sale = F.first(F.when(F.col("refund").isNull() & F.col("txn_id").isNotNull(), F.struct("ts", "customer_id", "amount"))).over(in_order("refund"))
    known = unique_rows(purchases).withColumn("sale", sale).select(
        *PURCHASE, "refund", F.col("sale.customer_id").alias("sale_customer"), F.col("sale.ts").alias("sale_ts"), F.col("sale.amount").alias("sale_amount")
    )
    is_refund = F.col("refund").isNotNull()
    judged = taken_back(known.withColumn("reason", why_unmatched()), order=("refund",), counts=is_refund & F.col("reason").isNull())
    kept = F.when(is_refund, -F.col("accepted")).otherwise(F.col("amount")).cast(MONEY)
    settled = judged.where(~is_refund | (F.col("accepted") > 0)).select("customer_id", "txn_id", "ts", kept.alias("amount"))
    left = judged.where(is_refund).withColumn("amount", (F.col("amount") + F.col("accepted")).cast(MONEY)).where("amount < 0")
    return settled, left.select(*PURCHASE, F.coalesce("reason", F.lit(BEYOND)).alias("reason"))
