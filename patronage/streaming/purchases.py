"""Purchases as a stream: running indicators, periods, sessions and repeated events.

Structured Streaming tracks lateness on TIMESTAMP columns only, while purchases carry a
TIMESTAMP_NTZ. The conversion is read as UTC, so these functions work on a session in
UTC; ``utc_session`` gives one that shares the context of any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from patronage.functions.columns import total
from patronage.operators.hygiene import split_valid
from patronage.session import scratch_path
from patronage.sources.purchases import purchase_events


def utc_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose time zone is UTC.

    Sessions of one customer are merged before the shuffle, so a customer with a third of
    all events sends sessions rather than events.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    for key in ("spark.sql.shuffle.partitions", "spark.checkpoint.dir"):
        if spark.conf.get(key, None) is not None and session.conf.isModifiable(key):
            session.conf.set(key, spark.conf.get(key))
    session.conf.set("spark.sql.session.timeZone", "UTC")
    return session


def purchase_stream(spark: SparkSession, path: str, files_per_batch: int | None = None, net: bool = False) -> DataFrame:
    """Valid purchases, and with ``net`` refunds, from a folder (or a pattern of files) that event files arrive in."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    valid, _ = split_valid(purchase_events(reader.parquet(path)), net)
    return valid.withColumn("ts", F.col("ts").cast("timestamp"))


def once_each(purchases: DataFrame, repeat_within: str | None) -> DataFrame:
    """Drop repeated transactions.

    ``repeat_within`` states the longest delay (such as ``"2 days"``) between copies of
    one transaction; ids older than that are forgotten, and events later than that are
    dropped. With ``None`` every id is remembered for ever, so state grows with the purchases, and no
    event is ever too late.
    """
    if repeat_within is None:
        return purchases.dropDuplicates(["txn_id"])
    return purchases.withWatermark("ts", repeat_within).dropDuplicatesWithinWatermark(["txn_id"])


def running_indicators(purchases: DataFrame) -> DataFrame:
    """Last purchase, frequency and revenue so far: one row of state per customer, kept for
    ever by design. Recency is not stored because it changes by itself."""
    return purchases.groupBy("customer_id").agg(
        F.max("ts").cast("timestamp_ntz").alias("last_ts"),
        F.count("*").alias("frequency"),
        total(F.col("amount")).alias("monetary"),
    )


def _allow_lateness(purchases: DataFrame, lateness: str | None) -> DataFrame:
    """Spark lets a stream state its lateness once; ``once_each`` may have done so."""
    return purchases if lateness is None else purchases.withWatermark("ts", lateness)


def purchases_per_period(
    purchases: DataFrame, period: str = "7 days", slide: str | None = None, lateness: str | None = "1 day"
) -> DataFrame:
    """Purchases and revenue per tumbling (or sliding) period, emitted once it is closed: periods
    that are still open when the input ends are not told.

    Pass ``lateness=None`` after ``once_each(..., repeat_within)``, whose delay then
    decides. The window becomes two plain columns; all customers share a period, and the
    counts are combined before the shuffle.
    """
    return (
        _allow_lateness(purchases, lateness)
        .groupBy(F.window("ts", period, slide) if slide else F.window("ts", period))
        .agg(F.count("*").alias("purchases"), total(F.col("amount")).alias("revenue"))
        .select(
            F.col("window.start").cast("timestamp_ntz").alias("period_start"),
            F.col("window.end").cast("timestamp_ntz").alias("period_end"),
            "purchases",
            "revenue",
        )
    )


def buying_sessions(
    purchases: DataFrame, gap: str = "12 hours", lateness: str | None = "1 day"
) -> DataFrame:
    """Runs of purchases by one customer with at most ``gap`` between them, emitted once closed."""
    return (
        _allow_lateness(purchases, lateness)
        .groupBy("customer_id", F.session_window("ts", gap))
        .agg(F.count("*").alias("purchases"), total(F.col("amount")).alias("revenue"))
        .select(
            "customer_id",
            F.col("session_window.start").cast("timestamp_ntz").alias("session_start"),
            F.col("session_window.end").cast("timestamp_ntz").alias("session_end"),
            "purchases",
            "revenue",
        )
    )


def append_to(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write finished rows to a Parquet table, each exactly once."""
    return (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def drain(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over everything that is there now and return its finished rows."""
    spark = stream.sparkSession
    path, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-progress")
    append_to(stream, path, checkpoint).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
