"""Session defaults and the size limits operators check before they choose a strategy.

Every limit is a Spark conf key, so a cluster can set it without code changes.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Rows one window partition may hold before ranking switches to range partitions.
WINDOW_ROWS = ("plumbline.window.maxRows", 2_000_000)
# Bytes a table may take to be sent to every executor.
BROADCAST_BYTES = ("plumbline.broadcast.maxBytes", 64 << 20)
# Rows per packed block in block-wise vector joins.
BLOCK_ROWS = ("plumbline.block.rows", 2048)
# Leaf pivots of exact nearest-neighbour joins: their number, and the bytes they may take on the driver and in a broadcast.
MAX_PIVOTS = ("plumbline.knn.maxPivots", 16_384)
PIVOT_BYTES = ("plumbline.knn.pivotBytes", 32 << 20)
# Bytes of vectors of one group that a task may hold to fit its model by itself.
FIT_BYTES = ("plumbline.fit.maxBytes", 64 << 20)
# Distinct groups that may carry their own D x D statistics in one task.
GRAM_GROUPS = ("plumbline.gram.maxGroups", 64)


def limit(spark: SparkSession, key: tuple[str, int]) -> int:
    """Value of a size limit: the session's conf if set, else the default."""
    return int(spark.conf.get(key[0], str(key[1])))


def build_session(app: str = "plumbline", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the operators are tuned for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    defaults.update({k: str(v) for k, v in conf.items()})
    for key, value in defaults.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and read it back.

    The folder is the cluster's `spark.checkpoint.dir`. Only a local session
    without one (tests) gets a folder of its own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per Spark context."""
    context = spark.sparkContext
    if getattr(context, "_plumbline_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="spark-")
    archive = shutil.make_archive(os.path.join(folder, "plumbline"), "zip", root, "plumbline")
    context.addPyFile(archive)
    context._plumbline_shipped = True


def small_table(spark: SparkSession, rows: list[dict], schema: list[tuple[str, str]]) -> DataFrame:
    """A local table whose size is bounded by the caller, without an RDD of Python objects."""
    types = {
        "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(),
        "array<double>": pa.list_(pa.float64()),
    }
    return spark.createDataFrame(pa.Table.from_pylist(rows, pa.schema([(n, types[t]) for n, t in schema])))


def work_folder(spark: SparkSession, name: str) -> str:
    """A new sub-folder of the shared checkpoint folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
