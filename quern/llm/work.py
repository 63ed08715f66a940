"""The shared folder for written intermediates, and sizes that Catalyst knows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only a session in local mode may do without the setting; it gets a new
    temporary folder once.
    """
    base = spark.conf.get(_SETTING, None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"{_SETTING} must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set(_SETTING, base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Bounds the Arrow batches that Python gets, in bytes, unless the session has a bound of its own: texts may be long."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting, None) in (None, "67108864", "67108864b", "64m", "64MB"):
        spark.conf.set(setting, str(size))
