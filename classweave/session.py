"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def build_session(app_name: str = "classweave", master: str | None = None,
                  **settings: str) -> SparkSession:
    """A session with the settings this package relies on.

    Shuffle partitions are left to adaptive execution, which starts wide and
    coalesces, unless the caller passes a number.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for name, value in settings.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine.
    """
    context = spark.sparkContext
    configured = context.getConf().get(CHECKPOINT_SETTING) or spark.conf.get(
        CHECKPOINT_SETTING, None
    )
    if configured:
        configured = _resolved(spark, configured).rstrip("/")
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError(
                f"set {CHECKPOINT_SETTING} to a folder all executors share"
            )
        context.setCheckpointDir(tempfile.mkdtemp(prefix="classweave-"))
    return context.getCheckpointDir().rstrip("/")


def _resolved(spark: SparkSession, path: str) -> str:
    """The address with its store's name, unless that is the local file system.

    An address without one means the cluster's default store to Spark; whoever
    opens files beside Spark must find the same place.
    """
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    full = store.makeQualified(place).toString()
    return path if full.startswith("file:") else full


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(
        spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def new_folder(spark: SparkSession, purpose: str) -> str:
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a result feeds several later jobs: it is computed once, its
    lineage ends here, and a lost executor costs a re-read, not a recompute.
    """
    spark = df.sparkSession
    path = new_folder(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
