"""Breadth-first frontiers: one for each seed, all seeds at once, a level at a time.

A level is a few joins and windows partitioned by seed; the driver only loops
over levels. Order within a level is explicit (the page's place, then the link's),
so that what counts as the first sight of a URL doesn't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import urls
from quern.functions.exact import robots_rules
from quern.operators.shared import growing, written


@dataclass(frozen=True)
class CrawlPolicy:
    """Bounds of a crawl."""

    max_pages: int = 25
    max_depth: int = 1
    max_frontier_entries: int = 1000
    max_links_per_page: int = 500
    max_total_bytes: int = 50 << 20
    allowed_origins: tuple[str, ...] = ()
    allow_patterns: tuple[str, ...] = ()
    deny_patterns: tuple[str, ...] = ()
    tracking: tuple[str, ...] = urls.TRACKING
    agent: str = "quern"
    robots_fail_closed: bool = True

    def __post_init__(self) -> None:
        if min(self.max_pages, self.max_frontier_entries, self.max_links_per_page, self.max_total_bytes) < 1 or self.max_depth < 0:
            raise ValueError("crawl limits must be positive, and the depth not negative")


ENTRY = ("seed", "canonical_url", "depth", "status", "parent_url", "skip_reason", "seq")


def skip_reason(p: CrawlPolicy, robots: bool = False) -> Column:
    """Why an entry isn't queued; null where it is. Checks come in a fixed order."""
    origin = urls.origin("canonical_url")
    inside = (origin == urls.origin("seed")) | (origin.isin(*p.allowed_origins) if p.allowed_origins else F.lit(False))
    c = F.when(F.col("depth") > p.max_depth, "max_depth").when(~inside, "cross_origin").when(~urls.policy_allows("canonical_url", p.allow_patterns, p.deny_patterns), "policy_denied")
    return c.when(F.col("robots") == "unavailable", "robots_unavailable").when(F.col("robots") == "disallowed", "robots_disallowed") if robots else c


def robots_verdict(entries: DataFrame, robots: DataFrame, p: CrawlPolicy) -> DataFrame:
    """``entries`` with ``robots``: allowed, disallowed, or unavailable, by what each origin answered (origin, status, body).

    404 and 410 allow all; another error, or no answer, is unavailable where the policy fails closed, and else allows. Rules are
    parsed once for an origin and compared in generated code.
    """
    answer = robots.groupBy(F.col("origin").alias("_origin")).agg(F.max_by(F.struct("status", "body"), F.struct("status", "body")).alias("_a"))
    answer = answer.select("_origin", F.col("_a.status").alias("_status"), robots_rules(F.when(F.col("_a.status") < 400, F.coalesce("_a.body", F.lit("")) ), F.lit(p.agent)).alias("_rules"))
    path = F.expr("substring(canonical_url, length(_own) + 1)")
    first = F.get(F.filter("_rules", lambda r: (r["path"] == "*") | path.startswith(r["path"])), 0)["allow"]
    failed = F.lit("unavailable" if p.robots_fail_closed else "allowed")
    verdict = F.when(F.col("_status").isin(404, 410), "allowed").when(F.col("_rules").isNull(), failed).when(F.coalesce(first, F.lit(True)), "allowed").otherwise("disallowed")
    own = entries.withColumn("_own", urls.origin("canonical_url"))
    return own.join(growing(answer), F.col("_own") == F.col("_origin"), "left").withColumn("robots", verdict).drop("_own", "_origin", "_status", "_rules")


def frontier(seeds: DataFrame, pages: DataFrame, policy: CrawlPolicy = CrawlPolicy(), robots: DataFrame | None = None) -> DataFrame:
    """(seed, canonical_url, depth, status, parent_url, skip_reason, seq) of all entries of all seeds (seed, canonical).

    ``pages`` (url, links) are what can be fetched, by canonical URL. A queued URL that isn't among them fails.
    Each seed takes ``max_pages`` pages at most, in order of discovery; what stays after that is queued. A link is taken in where
    it is safe and unseen; links beyond ``max_links_per_page`` are not looked at, and entries
    beyond ``max_frontier_entries`` are not kept. ``robots`` (origin, status, body) are the answers of the origins; without them none is asked. Seeds are judged like links.
    """
    judged = (lambda e: robots_verdict(e, robots, policy)) if robots is not None else (lambda e: e)
    entry = judged(seeds.where("seed is not null").select("seed", F.col("seed").alias("canonical_url"), F.lit(0).alias("depth")).distinct())
    entry = entry.select("seed", "canonical_url", "depth", F.lit(None).cast("string").alias("parent_url"), skip_reason(policy, robots is not None).alias("skip_reason"), F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("taken"))
    known = written(pages.select(F.col("url").alias("canonical_url"), "links").dropDuplicates(["canonical_url"]), "known")  # every level reads it
    done = written(entry, "frontier")
    level = done
    for depth in range(policy.max_depth + 1):
        fetch = level.where(f"skip_reason is null and taken < {policy.max_pages}").join(growing(known), "canonical_url")
        link = fetch.select("seed", F.col("canonical_url").alias("parent_url"), "seq", F.posexplode(F.slice("links", 1, policy.max_links_per_page)).alias("at", "link"))
        link = urls.resolved(link, "parent_url", "link", "canonical_url", policy.tracking).where("canonical_url is not null")
        first = link.groupBy("seed", "canonical_url").agg(F.min(F.struct(F.col("seq").alias("page"), "at", "parent_url")).alias("x")).select("seed", "canonical_url", "x.*")
        new = first.join(growing(done.select("seed", "canonical_url")), ["seed", "canonical_url"], "left_anti").withColumn("depth", F.lit(depth + 1))
        so_far = done.groupBy("seed").agg(F.count("*").alias("entries"), F.count_if(F.col("skip_reason").isNull()).alias("queued"))
        in_order = Window.partitionBy("seed").orderBy("page", "at")
        new = new.join(growing(so_far), "seed").withColumn("nth", F.row_number().over(in_order)).where(f"nth + entries <= {policy.max_frontier_entries}")
        new = judged(new).withColumn("skip_reason", skip_reason(policy, robots is not None))
        new = new.withColumn("seq", (F.col("nth") + F.col("entries") - 1).cast("long"))
        taken = F.col("queued") + F.count_if(F.col("skip_reason").isNull()).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
        level = written(new.withColumn("taken", F.coalesce(taken, F.col("queued")).cast("long")).select(*done.columns), "frontier")
        if level.isEmpty():
            break
        done = done.unionByName(level)
    there = known.select("canonical_url", F.lit(True).alias("there"))
    status = F.when(F.col("skip_reason").isNotNull(), "skipped").when(F.col("taken") >= policy.max_pages, "queued").when(F.col("there"), "done").otherwise("failed")
    return done.join(growing(there), "canonical_url", "left").withColumn("status", status).select(*ENTRY)


def events(entries: DataFrame) -> DataFrame:
    """(seed, canonical_url, event_index, status): the append-only ledger of the entries: each one's discovery, and for fetched ones the start and the end."""
    fetched = F.col("status").isin("done", "failed")
    states = F.when(fetched, F.array(F.lit("queued"), F.lit("in_progress"), F.col("status"))).otherwise(F.array("status"))
    return entries.select("seed", "canonical_url", "seq", F.posexplode(states).alias("step", "status")).select("seed", "canonical_url", (F.col("seq") * 3 + F.col("step")).alias("event_index"), "status")


def latest_status(ledger: DataFrame) -> DataFrame:
    """(seed, canonical_url, status) after the last event of each."""
    return ledger.groupBy("seed", "canonical_url").agg(F.max_by("status", "event_index").alias("status"))


def byte_budget(fetches: DataFrame, key: str, order: str, size: str, total: int, page: int) -> DataFrame:
    """Fetches (key, order, size) with ``outcome`` and ``spent``, taken in order for each key.

    A page over ``page`` bytes, or over what is left, fails and spends nothing, and the crawl goes on; nothing is
    fetched once nothing is left. No sum over ranges can tell this: each key's rows are gone through in order, batch by batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, spent = object(), 0
        for b in batches:
            outcome, after = [], []
            for k, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if k != now:
                    now, spent = k, 0
                fits = n is not None and n <= min(page, total - spent)
                outcome.append("exhausted" if spent >= total else "fetched" if fits else "too_large")
                spent += n if outcome[-1] == "fetched" else 0
                after.append(spent)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(outcome, pa.string()), pa.array(after, pa.int64())], names=[key, order, size, "outcome", "spent"])

    src = fetches.select(key, order, F.col(size).cast("long").alias(size))
    return src.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, src.schema.add("outcome", "string").add("spent", "long"))
