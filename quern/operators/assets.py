"""Content-addressed assets and packages: ids, caps, manifests, and what holds between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import ids
from quern.operators.shared import ranged


def stored(assets: DataFrame) -> DataFrame:
    """One row for each blob: (sha256, byte_size, blob_path, assets): equal bytes are stored once."""
    return assets.groupBy("sha256").agg(F.min("byte_size").alias("byte_size"), F.count("*").alias("assets")).withColumn("blob_path", ids.blob_path("sha256"))


def running_total(items: DataFrame, order: str, size: str, cap: int, key: str) -> DataFrame:
    """Items with the running total of their key and whether it went over the cap; importers stop at the first that does.

    Sums are over ranges of the order first, so that a key with most of the items is no single task's.
    """
    r = ranged(items, key, order)
    parts = r.groupBy(key, "_part").agg(F.sum(size).alias("_sum"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    parts = parts.select(F.col(key).alias("_key"), F.col("_part").alias("_at"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    w = Window.partitionBy("_part", key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = r.withColumn("_own", F.sum(size).over(w)).join(parts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_at")))
    return j.withColumn("running", F.col("_base") + F.col("_own")).withColumn("over", F.col("running") > cap).select(*items.columns, "running", "over")


def merged(old: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The union of two manifests by key, and the keys whose rows differ between them."""
    names = [c for c in old.columns if c != key]
    side = lambda df, k: df.select(key, F.struct(*names).alias(k))
    both = side(old, "a").join(side(new, "b"), key, "full_outer")
    conflict = both.where("a is not null and b is not null and not (a <=> b)").select(key)
    return both.select(key, F.coalesce("a", "b").alias("x")).select(key, "x.*"), conflict


def bijection(left: DataFrame, right: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """(keys, fault) where rows don't pair: missing-left, missing-right, or different-<column>."""
    l = left.select(*keys, F.struct(*compare).alias("l"))
    r = right.select(*keys, F.struct(*compare).alias("r"))
    fault = F.when(F.col("l").isNull(), F.array(F.lit("missing-left"))).when(F.col("r").isNull(), F.array(F.lit("missing-right"))).otherwise(F.filter(F.array(*(F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(f"different-{c}")) for c in compare)), lambda x: x.isNotNull()))
    return l.join(r, keys, "full_outer").select(*keys, F.explode(fault).alias("fault"))


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key), key, "left_anti")


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side only, with ``side``."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).union(right.exceptAll(left).withColumn("side", F.lit("right")))


def repeats(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("times")).where("times > 1")


def blob_faults(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(asset_id, fault): manifest rows (asset_id, sha256, byte_size, relative_path) held against files (path, content)."""
    real = files.select(F.col("path").alias("relative_path"), F.sha2("content", 256).alias("real"), F.length("content").cast("long").alias("size"))
    j = manifest.join(real, "relative_path", "left")
    fault = F.when(~ids.relative_path_ok("relative_path"), "path").when(F.col("relative_path") != ids.blob_path("sha256"), "path-of-digest").when(F.col("real").isNull(), "missing").when(F.col("real") != F.col("sha256"), "digest").when(F.col("size") != F.col("byte_size"), "size")
    return j.select("asset_id", fault.alias("fault")).where("fault is not null")


def package_faults(items: DataFrame) -> DataFrame:
    """(package_id, item_id, fault): repeated ids or paths, unsafe paths and ids, transcripts that aren't items."""
    by = lambda c: F.count("*").over(Window.partitionBy("package_id", c))
    there = items.select("package_id", F.col("path").alias("transcript_path"), F.lit(True).alias("_there")).distinct()
    j = items.withColumn("_ids", by("item_id")).withColumn("_paths", by("path")).join(there, ["package_id", "transcript_path"], "left")
    checks = [("item-id-repeats", F.col("_ids") > 1), ("path-repeats", F.col("_paths") > 1), ("unsafe-path", ~ids.relative_path_ok("path")), ("bad-item-id", ~ids.opaque_id_ok("item_id")), ("transcript-missing", F.col("transcript_path").isNotNull() & F.col("_there").isNull())]
    return j.select("package_id", "item_id", F.explode(F.filter(F.array(*(F.when(bad, F.lit(n)) for n, bad in checks)), lambda x: x.isNotNull())).alias("fault"))
