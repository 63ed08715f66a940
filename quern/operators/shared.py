"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only a session in local mode may do without, and gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of its own: computed once, with known size, its lineage cut."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` written in ranges of an order, with ``_part``, which rises with it: what is needed for sums and ranks over all rows without one task that sees them all."""
    return written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Bounds the Arrow batches that Python gets, in bytes, unless the session has a bound of its own: texts may be long."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting, None) in (None, "67108864", "67108864b", "64m", "64MB"):
        spark.conf.set(setting, str(size))


def growing(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast: what grows with the input isn't sent through the driver, however small its compressed form looks to Catalyst."""
    return df.hint("merge")
