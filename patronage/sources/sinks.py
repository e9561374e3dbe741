"""Sinks: dated snapshots and dashboard tables as Parquet."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.functions.columns import date_literal, day_of


def write_snapshot(df: DataFrame, path: str, as_of: str | dt.date | None = None) -> None:
    """Write one partition per ``as_of`` date, replacing only the dates being written.

    Writing a date twice leaves one copy, so a failed job can simply run again. With
    ``as_of`` the whole frame is that date's snapshot, and replaces it even when empty;
    otherwise the frame has the column, and dates without rows stay as they are. Rows of a date are
    brought together first, in as many tasks as their size asks for, so a date gets few files.
    """
    if as_of is not None:
        df.drop("as_of").write.mode("overwrite").parquet(f"{path}/as_of={day_of(as_of).isoformat()}")
        return
    (
        df.hint("rebalance", "as_of").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("as_of")
        .parquet(path)
    )


def read_snapshots(spark: SparkSession, path: str, as_of: str | dt.date | None = None) -> DataFrame:
    """Read snapshots back; with ``as_of`` only that date's files are touched."""
    snapshots = spark.read.parquet(path).withColumn("as_of", F.col("as_of").cast("date"))
    return snapshots if as_of is None else snapshots.where(F.col("as_of") == date_literal(as_of))


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int = 64) -> None:
    """Write a snapshot as a table whose files are dealt and sorted by customer; a table of that name is replaced.

    Two snapshots with the same number of buckets are compared bucket by bucket, without moving any customer. Rows are dealt
    before they are written, so a bucket is one file.
    """
    dealt = df.repartition(buckets, "customer_id")
    dealt.write.mode("overwrite").bucketBy(buckets, "customer_id").sortBy("customer_id").option("path", path).saveAsTable(table)


def publish(tables: dict[str, DataFrame], path: str) -> dict[str, str]:
    """Write each result table below ``path`` for a dashboard to read."""
    written = {}
    for name, df in tables.items():
        written[name] = f"{path}/{name}"
        df.write.mode("overwrite").parquet(written[name])
    return written
