"""Monthly history that is kept up to date: a new month reads that month's purchases, not all of them.

A spell is a time of unchanged indicators of one customer (see ``history``). Closed spells are never touched again; the open spell of
each customer is one row of a table that is replaced with every month, and only then pointed at. A month that fails
halfway, or is added twice, changes nothing.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from patronage.functions.columns import TOTAL_MONEY, day_of, midnight
from patronage.operators.history import unfold
from patronage.operators.indicators import indicator_aggregates
from patronage.streaming.state_table import current, publish

OPEN = f"customer_id bigint, from_no int, last_purchase date, frequency bigint, monetary {TOTAL_MONEY}"
CLOSED = f"{OPEN}, to_no int"


def month_after(day: dt.date, months: int) -> dt.date:
    number = day.year * 12 + day.month - 1 + months
    return dt.date(number // 12, number % 12 + 1, 1)


class KeptHistory:
    """Spells below ``path``, for snapshots at month starts from ``first`` on."""

    def __init__(self, spark: SparkSession, path: str, first: str | dt.date) -> None:
        self.spark, self.path, self.first = spark, path, day_of(first)
        if self.first.day != 1:
            raise ValueError("first must be a month start")

    def last(self) -> int | None:
        """The number of the last snapshot that is kept, 0 being the first."""
        return current(self.spark, f"{self.path}/open", StructType.fromDDL(OPEN))[0]

    def add_month(self, purchases: DataFrame, as_of: str | dt.date) -> None:
        """Add the snapshot at ``as_of``, the month start after the last one.

        ``purchases`` are clean; those of the month before ``as_of`` are read (for the first snapshot all before it). The filter
        on time reaches the scan. Each customer is one row on either side of the one join.
        """
        day, schema = day_of(as_of), StructType.fromDDL(OPEN)
        last, kept = current(self.spark, f"{self.path}/open", schema)
        no = 0 if last is None else last + 1
        if last is not None and day == month_after(self.first, last):
            return  # added before
        if day != month_after(self.first, no):
            raise ValueError(f"the next snapshot is that of {month_after(self.first, no)}")
        fresh = purchases.where(F.col("ts") < midnight(day))
        if no:
            fresh = fresh.where(F.col("ts") >= midnight(month_after(day, -1)))
        new = fresh.groupBy("customer_id").agg(*indicator_aggregates())
        new = new.select("customer_id", *[F.col(c).alias(f"new_{c}") for c in ("last_purchase", "frequency", "monetary")])
        both = kept.drop("batch_id").join(new, "customer_id", "full_outer")
        changed = F.col("new_frequency").isNotNull()
        closed = both.where(changed & F.col("from_no").isNotNull()).select(*schema.fieldNames(), F.lit(no).alias("to_no"))
        closed.write.mode("overwrite").parquet(f"{self.path}/closed/until={no}")
        zero = F.lit(0)
        following = both.select(
            "customer_id", F.when(changed, no).otherwise(F.col("from_no")).cast("int").alias("from_no"),
            F.greatest("last_purchase", "new_last_purchase").alias("last_purchase"),
            (F.coalesce("frequency", zero) + F.coalesce("new_frequency", zero)).alias("frequency"),
            (F.coalesce("monetary", zero) + F.coalesce("new_monetary", zero)).cast(TOTAL_MONEY).alias("monetary"),
        )
        publish(following, f"{self.path}/open", no)

    def spells(self) -> DataFrame:
        """All spells up to the last snapshot, as ``history.unfold`` takes them."""
        last, kept = current(self.spark, f"{self.path}/open", StructType.fromDDL(OPEN))
        open_ones = kept.drop("batch_id").withColumn("to_no", F.lit(0 if last is None else last + 1))
        if last is None:
            return open_ones
        closed = self.spark.read.schema(StructType.fromDDL(CLOSED)).parquet(f"{self.path}/closed")
        return open_ones.unionByName(closed.where(F.col("to_no") <= last).select(*open_ones.columns))

    def snapshots(self) -> DataFrame:
        """The indicators of every customer at every month start that is kept."""
        return unfold(self.spells(), self.first)
