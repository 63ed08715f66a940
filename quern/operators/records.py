"""Records: identity, dedup on write, paths, receipts and their rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import ids, text, urls


def identified(items: DataFrame) -> DataFrame:
    """Items (platform, source_url, title, body, ...) with safe_url, content_hash and slug added, and the title made safe."""
    return items.withColumns({"safe_url": urls.sanitize("source_url"), "content_hash": text.content_hash("body"), "title": text.redact(F.coalesce("title", F.lit("")))}).withColumn("slug", text.slugify(F.coalesce(F.nullif("title", F.lit("")), "safe_url")))


def outcomes(items: DataFrame, arrival: str, existing: DataFrame | None = None) -> DataFrame:
    """Identified items with ``outcome``: empty, duplicate or written.

    A duplicate has the safe URL and the body hash of an item that arrived before, or of a row of ``existing`` (platform, safe_url,
    content_hash), whose hashes must have been taken from the stored bytes. One body from two URLs is kept twice.
    """
    w = Window.partitionBy("platform", "safe_url", "content_hash").orderBy(arrival)
    out = items.withColumn("_nth", F.row_number().over(w))
    known = F.lit(False)
    if existing is not None:
        mark = existing.select("platform", "safe_url", "content_hash").distinct().withColumn("_known", F.lit(True))
        out = out.join(mark, ["platform", "safe_url", "content_hash"], "left")
        known = F.col("_known").isNotNull()
    outcome = F.when(text.strip(F.coalesce("body", F.lit(""))) == "", "empty").when(known | (F.col("_nth") > 1), "duplicate").otherwise("written")
    return out.withColumn("outcome", outcome).drop("_nth", "_known")


def paths(written: DataFrame, arrival: str, existing: DataFrame | None = None) -> DataFrame:
    """Written items with ``path``: platform/slug.md for the first of a slug, then with 8, 12, ... characters of the hash.

    Every item's candidates are claimed in order of length; whoever arrived first gets each.
    Colliding hashes of 8 characters are rare, so two rounds settle nearly all and the full hash the rest.
    """
    candidates = [F.concat("platform", F.lit("/"), "slug", F.lit(".md"))] + [F.concat("platform", F.lit("/"), "slug", F.lit("-"), F.substring("content_hash", 1, n), F.lit(".md")) for n in (8, 12, 64)]
    out = written.withColumn("path", F.lit(None).cast("string"))
    for k, c in enumerate(candidates):
        first = F.row_number().over(Window.partitionBy(F.col("path").isNull(), c).orderBy(arrival)) == 1
        if k == 0 and existing is not None:
            out = out.join(existing.select(F.col("path").alias("_taken")).distinct(), c == F.col("_taken"), "left")
            first = first & F.col("_taken").isNull()
        out = out.withColumn("path", F.when(F.col("path").isNotNull(), F.col("path")).when(first if k < len(candidates) - 1 else F.lit(True), c)).drop("_taken")
    return out


def markdown(items: DataFrame) -> Column:
    """The record as Markdown with a front matter of fixed order, its values as JSON strings, which YAML reads."""
    front = ["platform", "source_url", "title", "author", "date", "scraped_at", "content_hash"]
    values = {"source_url": F.col("safe_url")}
    lines = [F.concat(F.lit(f"{k}: "), ids.json_string(F.coalesce(values.get(k, F.col(k) if k in items.columns else F.lit("")), F.lit("")))) for k in front]
    heading = F.when(F.col("title") != "", F.concat(F.lit("# "), "title", F.lit("\n\n"))).otherwise("")
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), heading, text.strip("body"), F.lit("\n"))


def rollup(attempts: DataFrame, *keys: str) -> DataFrame:
    """Counts of outcomes and the status for each key: complete without failures, else partial where anything was written or repeated, else failed."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    c = attempts.groupBy(*keys).agg(n("written").alias("written"), n("duplicate").alias("duplicates"), n("empty").alias("empty"), n("failed").alias("failed"))
    return c.withColumn("status", F.when(F.col("failed") == 0, "complete").when(F.col("written") + F.col("duplicates") > 0, "partial").otherwise("failed"))


def latest(receipts: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The newest row of each key, by partial aggregation."""
    return receipts.groupBy(key).agg(F.max_by(F.struct(*receipts.columns), F.struct(at, tie)).alias("r")).select("r.*")


def reusable(receipts: DataFrame, records: DataFrame, files: DataFrame) -> DataFrame:
    """(fingerprint, run_id, reusable): whether every record of a receipt still has the hash of its file; one without records is."""
    r = records.join(files.select("path", F.col("record_hash").alias("_now")), "path", "left")
    good = r.groupBy("run_id").agg(F.bool_and(F.coalesce(F.col("record_hash") == F.col("_now"), F.lit(False))).alias("same"))
    return receipts.join(good, "run_id", "left").select("fingerprint", "run_id", F.coalesce("same", F.lit(True)).alias("reusable"))


def waits(requests: DataFrame, host: str, at: str, interval: float, *ties: str) -> DataFrame:
    """Requests with ``wait``: seconds until ``interval`` has passed since the host's last one."""
    last = F.lag(at).over(Window.partitionBy(host).orderBy(at, *ties))
    gap = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(last.cast("timestamp"))) / 1e6
    return requests.withColumn("wait", F.coalesce(F.greatest(F.lit(0.0), F.lit(float(interval)) - gap), F.lit(0.0)))


def discussion(items: DataFrame, key: str, position: str, author: str, body: str, most: int) -> DataFrame:
    """(key, text): the first item of each key as the story, then the first ``most`` others as a list with authors; empty ones are dropped after counting."""
    rows = items.where(F.col(position) <= most).select(key, F.struct(F.col(position).alias("p"), F.col(author).alias("a"), text.strip(F.coalesce(F.col(body), F.lit(""))).alias("b")).alias("x"))
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    story = F.try_element_at(F.transform(F.filter("xs", lambda x: x["p"] == 0), lambda x: x["b"]), F.lit(1))
    said = F.filter("xs", lambda x: (x["p"] > 0) & (x["b"] != "") & (x["b"] != "[deleted]"))
    lines = F.array_join(F.transform(said, lambda x: F.concat(F.lit("- **"), x["a"], F.lit("**: "), x["b"])), "\n")
    return g.select(key, text.body_of(story, F.when(F.size(said) > 0, F.concat(F.lit("## Comments\n\n"), lines))).alias("text"))
