"""Stream state in a table of bounded size: a snapshot, the changes since, and a pointer to the snapshot.

A batch writes the customers it changed into one of a fixed number of slots, which go round; every so many batches a
snapshot of all customers goes to one of two sides, and only when it is complete does the pointer name it. The
side and the slots that are written next are never the ones a reader needs, so a batch that fails
halfway, or runs again, changes nothing that is read, and files never become more than the slots
hold. Nothing has to be deleted.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructType

SIDES = 2


def put(rows: DataFrame, path: str, batch_id: int, slots: int) -> None:
    """Write a batch's rows into its slot, in place of what an earlier batch (or this one, before) left there."""
    (
        rows.withColumns({"batch_id": F.lit(batch_id).cast("bigint"), "slots": F.lit(slots), "slot": F.lit(batch_id % slots)})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("slots", "slot")
        .parquet(path)
    )


def held(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """Everything in the slots, with ``batch_id``; None if nothing was ever written."""
    full = StructType([*schema, *StructType().add("batch_id", LongType()).add("slots", LongType()).add("slot", LongType())])
    try:
        return spark.read.schema(full).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def published(spark: SparkSession, path: str) -> int | None:
    """The batch that the pointer names; None if there is none yet."""
    rows = held(spark, f"{path}/pointer", StructType())
    return None if rows is None else rows.agg(F.max("batch_id")).first()[0]


def publish(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write a complete table to the free side, then point at it. Does nothing if it, or a later one, is already there."""
    spark, last = rows.sparkSession, published(rows.sparkSession, path)
    if last is not None and last >= batch_id:
        return
    number = 0 if last is None else side_of(spark, path, last) + 1
    written = rows.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    written.write.mode("overwrite").parquet(f"{path}/side-{number % SIDES}")
    put(spark.range(1).select(F.lit(number % SIDES).alias("side")).coalesce(1), f"{path}/pointer", batch_id, SIDES)


def side_of(spark: SparkSession, path: str, batch_id: int) -> int:
    rows = held(spark, f"{path}/pointer", StructType().add("side", IntegerType()))
    return rows.where(F.col("batch_id") == batch_id).first()["side"]


def current(spark: SparkSession, path: str, schema: StructType) -> tuple[int | None, DataFrame]:
    """The published table, with ``batch_id``, and the batch it is of; empty if there is none."""
    full = StructType([*schema]).add("batch_id", LongType())
    last = published(spark, path)
    if last is None:
        return None, spark.createDataFrame([], full)
    return last, spark.read.schema(full).parquet(f"{path}/side-{side_of(spark, path, last)}")


class StateTable:
    """The newest row of each key. ``schema`` has the key columns and all others; a snapshot is written ``every`` batches."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: list[str], every: int = 20) -> None:
        self.spark, self.path, self.keys, self.every = spark, path, keys, every
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def merge(self, changed: DataFrame, batch_id: int) -> None:
        """Take in the rows that one batch changed. A batch that runs again changes nothing."""
        self.write(changed, batch_id)
        if batch_id % self.every == self.every - 1:
            self.compact(batch_id)

    def write(self, changed: DataFrame, batch_id: int) -> None:
        put(changed.select(*self.schema.fieldNames()), f"{self.path}/changes", batch_id, 2 * self.every)

    def compact(self, batch_id: int) -> None:
        """Publish a snapshot as of a batch."""
        publish(self.read(batch_id), f"{self.path}/snapshot", batch_id)

    def changes(self, batch_id: int) -> DataFrame | None:
        """What one of the last batches changed."""
        rows = held(self.spark, f"{self.path}/changes", self.schema)
        return None if rows is None else rows.where(F.col("batch_id") == batch_id).select(*self.schema.fieldNames())

    def read(self, through: int | None = None) -> DataFrame:
        """The newest row of each key, combined before the shuffle; optionally as of a batch that the last snapshot does not pass."""
        base, snapshot = current(self.spark, f"{self.path}/snapshot", self.schema)
        if base is not None and through is not None and through < base:
            raise ValueError(f"batch {through} is older than the snapshot, which is of batch {base}")
        rows = held(self.spark, f"{self.path}/changes", self.schema)
        if rows is not None:
            since = rows.where(F.col("batch_id") > (-1 if base is None else base)).drop("slots", "slot")
            snapshot = snapshot.unionByName(since if through is None else since.where(F.col("batch_id") <= through))
        others = [name for name in self.schema.fieldNames() if name not in self.keys]
        newest = snapshot.groupBy(*self.keys).agg(F.max(F.struct("batch_id", *others)).alias("newest"))
        return newest.select(*[F.col(name) if name in self.keys else F.col(f"newest.{name}").alias(name) for name in self.schema.fieldNames()])

    def follow(self, changes: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Keep up with a stream of changed rows in update mode."""
        return (
            changes.writeStream.outputMode("update")
            .foreachBatch(self.merge)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
