"""Collecting whole sites from fetched pages: frontier, articles, outcomes and receipts of all runs at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text, urls
from quern.operators import frontier as crawl
from quern.operators import records
from quern.operators.shared import growing, written
from quern.sources import adapters


@dataclass
class Collected:
    """``entries`` of the frontiers, ``items`` with outcome and path, and what a receipt is made of: ``runs``, ``pages``, ``events``."""

    entries: DataFrame
    items: DataFrame
    runs: DataFrame
    pages: DataFrame
    events: DataFrame


def run_id(seed: str = "seed") -> F.Column:
    return F.substring(F.sha2(seed, 256), 1, 16)


def collect_sites(seeds: DataFrame, fetched: DataFrame, policy: crawl.CrawlPolicy = crawl.CrawlPolicy(), robots: DataFrame | None = None, existing: DataFrame | None = None, at: str = "1970-01-01T00:00:00Z") -> Collected:
    """One run for each seed (seed, canonical) over ``fetched`` (url, canonical; html), all with the time ``at``.

    Pages are taken in as the frontier orders them; each becomes an article, whose outcome is of its own run: written, duplicate (as ``existing`` (platform, safe_url, content_hash) has it), or empty. A page that couldn't be fetched is failed.
    """
    pages = fetched.groupBy("url").agg(F.max("html").alias("html")).withColumn("content_type", F.lit("text/html"))
    # what runs count of a page is taken from its HTML once, whatever number of runs reaches it
    own = pages.withColumns({"links": text.page_links("html"), "bytes": F.octet_length("html")})
    facts = records.identified(adapters.article(own, keep=("url", "links", "bytes")))
    facts = written(facts.select("url", "links", "bytes", "platform", "safe_url", "content_hash", (text.strip("body") == "").alias("_empty")), "facts")
    entries = written(crawl.frontier(seeds, facts.select("url", "links"), policy, robots), "entries").withColumn("run_id", run_id())
    done = entries.where("status = 'done'").select("run_id", F.col("canonical_url").alias("url"), "depth", "seq")
    known = F.lit(False)
    if existing is not None:
        mark = existing.select("platform", "safe_url", "content_hash").distinct().withColumn("_known", F.lit(True))
        facts, known = facts.join(growing(mark), ["platform", "safe_url", "content_hash"], "left"), F.col("_known").isNotNull()
    outcome = F.when(F.col("_empty"), "empty").when(known, "duplicate").otherwise("written")
    path = F.concat("platform", F.lit("/"), "run_id", F.lit("/"), "content_hash", F.lit(".md"))
    page = done.join(growing(facts.withColumn("outcome", outcome).drop("links", "_empty", "_known")), "url").withColumn("path", F.when(F.col("outcome") != "empty", path))
    size = page.groupBy("run_id").agg(F.sum("bytes").alias("total_bytes"))
    item = records.identified(adapters.article(done.join(growing(pages), "url"), keep=("run_id", "url", "depth", "seq")))
    item = item.join(growing(page.select("run_id", "url", "outcome", "path")), ["run_id", "url"]).select(*item.columns, "outcome", "path").withColumn("scraped_at", F.lit(at))
    page = page.select("run_id", "url", "depth", "outcome", "path", F.when(F.col("path").isNotNull(), F.col("content_hash")).alias("record_hash"))
    none = F.lit(None).cast("string")
    page = page.unionByName(entries.where("status = 'failed'").select("run_id", F.col("canonical_url").alias("url"), "depth", F.lit("failed").alias("outcome"), none.alias("path"), none.alias("record_hash")))
    counts = page.groupBy("run_id").agg(*(F.count_if(F.col("outcome") == o).alias(n) for o, n in (("written", "written"), ("duplicate", "duplicates"), ("empty", "empty"), ("failed", "failed"))), F.count("path").alias("_paths"))
    waiting = entries.groupBy("run_id", "seed").agg(F.count_if(F.col("status") == "done").alias("fetched_pages"), F.bool_or(F.col("status") == "queued").alias("_waiting"))
    run = growing(waiting).join(growing(counts), "run_id", "left").join(growing(size), "run_id", "left").fillna(0)
    status = F.when(F.col("failed") == 0, "complete").when(F.col("_paths") > 0, "partial").otherwise("failed")
    run = run.select("run_id", "seed", F.lit(at).alias("created_at"), status.alias("status"), "written", "duplicates", "empty", "failed", "fetched_pages", "total_bytes", (~F.col("_waiting")).alias("frontier_exhausted"), F.col("_waiting").alias("page_limit_reached"))
    ledger = crawl.events(entries).withColumn("run_id", run_id()).join(growing(entries.select("run_id", "canonical_url", "skip_reason")), ["run_id", "canonical_url"])
    return Collected(entries, item, run, page, ledger.select("run_id", "event_index", "canonical_url", "status", "skip_reason"))
