"""Customer state kept by a stream: a log of changed rows, read as the latest row each.

A micro-batch writes only the customers it changed, under its batch number. Replaying a
batch after a failure overwrites the same partition, so the log never counts twice.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from patronage.functions.columns import day_of, days_since
from patronage.operators.scoring import score_rank
from patronage.operators.segments import assign_segments
from patronage.streaming.state_table import StateTable, current, publish, published, side_of

CUSTOMER_STATE = "customer_id bigint, last_ts timestamp_ntz, frequency bigint, monetary decimal(38,2)"
STATE = "customer_id bigint, last_ts timestamp_ntz, frequency bigint, monetary decimal(38,2), batch_id bigint"


def write_batch(changed: DataFrame, batch_id: int, path: str) -> None:
    """Store the customers changed by one micro-batch; repeating it changes nothing."""
    (
        changed.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(path)
    )


def latest_state(spark: SparkSession, path: str, through: int | None = None, since: int = 0) -> DataFrame:
    """Each customer's newest row, combined before the shuffle; optionally as of a batch, and
    from a batch on that has a row for every customer."""
    log = spark.read.schema(STATE).parquet(path).where(F.col("batch_id") >= since)
    if through is not None:
        log = log.where(F.col("batch_id") <= through)
    return (
        log.groupBy("customer_id")
        .agg(F.max(F.struct("batch_id", "last_ts", "frequency", "monetary")).alias("s"))
        .select("customer_id", "s.last_ts", "s.frequency", "s.monetary")
    )


def compact(spark: SparkSession, path: str, through: int, target: str) -> None:
    """Rewrite the log up to a batch as one row per customer, in a new place.

    Later batches can be appended there; the old log stays until nobody reads it.
    """
    write_batch(latest_state(spark, path, through), through, target)


def state_as_base(state: DataFrame, as_of: str | dt.date) -> DataFrame:
    """The batch layout of the indicators, with recency worked out at reading time."""
    return state.select(
        "customer_id",
        F.to_date("last_ts").alias("last_purchase"),
        days_since(as_of, F.to_date("last_ts")).alias("recency_days"),
        "frequency",
        "monetary",
    )


def keep_state(indicators: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Follow a stream of running indicators into a state log."""
    return follow(indicators, lambda df, batch_id: write_batch(df, batch_id, path), checkpoint, **trigger)


def state_table(spark: SparkSession, path: str, every: int = 20) -> StateTable:
    """The same state in a table whose size is bounded by the customers, not by the batches."""
    return StateTable(spark, path, CUSTOMER_STATE, ["customer_id"], every)


def keep_segments(
    indicators: DataFrame, as_of: str | dt.date | None, state_path: str, segments_path: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Score all customers again after every micro-batch.

    Ranks need the whole population, which a streaming plan cannot order; each batch
    therefore updates the state and runs the ordinary batch scoring over it. Scores are as of
    the day after the newest purchase, or of ``as_of`` if that is later, so recency is
    never negative. State and segments are each written whole, to the one of two sides that nobody reads, and then
    published; ``latest_segments`` reads them. A batch that only moved the watermark writes nothing.
    """
    def rescore(changed: DataFrame, batch_id: int) -> None:
        spark = changed.sparkSession
        table = state_table(spark, state_path, every=1)  # scoring passes over all customers, so each batch has its snapshot
        table.write(changed, batch_id)
        written = table.changes(batch_id)
        if written is None or written.isEmpty():
            return
        table.compact(batch_id)
        _, state = current(spark, f"{state_path}/snapshot", table.schema)
        newest = state.agg(F.to_date(F.max("last_ts"))).first()[0]
        if newest is None:
            return
        day = newest + dt.timedelta(days=1)
        base = state_as_base(state, day if as_of is None else max(day, day_of(as_of)))
        publish(assign_segments(score_rank(base)), segments_path, batch_id)

    return follow(indicators, rescore, checkpoint, **trigger)


def latest_segments(spark: SparkSession, path: str) -> DataFrame:
    """What the last batch scored, with its ``batch_id``."""
    last = published(spark, path)
    if last is None:
        raise ValueError(f"no batch has been scored in {path}")
    return spark.read.parquet(f"{path}/side-{side_of(spark, path, last)}")


def follow(
    indicators: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, **trigger
) -> StreamingQuery:
    return (
        indicators.writeStream.outputMode("update")
        .foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


