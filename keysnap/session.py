"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# One writer per file and slice: copies are side effects, so no second attempt runs beside the
# first. Times in names are UTC.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.speculation": "false",
    # Jobs of several tables share the cores evenly.
    "spark.scheduler.mode": "FAIR",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
}


def build_session(master: str | None = None, app: str = "keysnap", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor can reach.

    Where it is unset a local session gets a temporary folder; a cluster session gets an error,
    as a machine's own folder is not shared.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="keysnap-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/keysnap/{label}-{uuid.uuid4().hex}"


def local_frame(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    """A few rows as a local relation: it needs no tasks, and the planner knows its size."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(schema)
    table = pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=arrow)
    return spark.createDataFrame(table, schema)


def tasks(spark: SparkSession, parallelism: int | None) -> int:
    """Tasks for work on files: as asked for, or one for each core."""
    return parallelism or spark.sparkContext.defaultParallelism


def cut(df: DataFrame) -> DataFrame:
    """Computes ``df`` now and keeps it in the shared folder, which outlives lost executors.

    Plans built on the result do not repeat its work or its side effects.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()
