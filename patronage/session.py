"""Session helpers: where shared scratch tables live and how to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Whether shuffle files go when the query that wrote them ends, and not when the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "patronage", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; settings passed in win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # quantiles for every month of some years at once, without falling back to a sort
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "512",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session without the setting (a test) gets a folder of its own;
    on a cluster a machine-local folder would be lost with its executor.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="patronage-")
        spark.conf.set(CHECKPOINT_DIR, root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path for one table below the shared folder."""
    return f"{scratch_dir(spark)}/patronage/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table", shuffles_go: bool = False) -> DataFrame:
    """Write ``df`` once and read it back.

    Used where several passes follow over a result that is expensive to compute. A
    written table outlives lost executors, is read column by column, and gives Catalyst
    its real size for join planning. With ``shuffles_go`` the shuffle files behind it are removed at once.
    """
    conf, path = df.sparkSession.conf, scratch_path(df.sparkSession, label)
    before = conf.get(SHUFFLES_GO)
    conf.set(SHUFFLES_GO, str(shuffles_go or before == "true").lower())
    try:
        df.write.parquet(path)
    finally:
        conf.set(SHUFFLES_GO, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Removes the files of a table that ``materialize`` wrote and nothing reads any more."""
    files = table.inputFiles()
    if files:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small_table(spark: SparkSession, rows: list, schema: StructType) -> DataFrame:
    """A local relation (no scan, no job) from a few rows held by the driver.

    Decimals are rounded half up to the scale of their column.
    """
    names = schema.fieldNames()
    records = [row if isinstance(row, dict) else dict(zip(names, row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(records, schema=to_arrow_schema(schema)), schema)
