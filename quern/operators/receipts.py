"""Receipts of site runs and package imports: their JSON form, and every rule that one breaks.

A run is a row of ``runs`` (run_id, created_at, seed, status, written, duplicates, empty, failed, fetched_pages, total_bytes,
frontier_exhausted, page_limit_reached) with its ``pages`` (run_id, url, depth, outcome, path, record_hash) and ``events`` (run_id,
event_index, canonical_url, status, skip_reason). Rules are aggregates joined by run, so that all runs are judged at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import ids, text, urls
from quern.operators.shared import growing

OUTCOMES = ("written", "duplicate", "empty", "failed")
STATES = ("queued", "in_progress", "done", "failed", "skipped")
REASONS = ("max_depth", "cross_origin", "policy_denied", "robots_disallowed", "robots_unavailable", "frontier_limit")


def _named(rules: list[tuple[str, Column]]) -> Column:
    return F.explode(F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(n)) for n, bad in rules)), lambda x: x.isNotNull()))


def site_faults(runs: DataFrame, pages: DataFrame, events: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(run_id, rule) of all broken rules; none for a sound receipt. ``files`` (path, record_hash) are hashes taken from the stored bytes."""
    n = lambda o: F.count_if(F.col("outcome") == o).alias(f"n_{o}")
    page = pages.groupBy("run_id").agg(
        *(n(o) for o in OUTCOMES), F.count("*").alias("n_pages"), F.count("path").alias("n_paths"),
        F.bool_or(~F.coalesce(F.col("outcome").isin(*OUTCOMES), F.lit(False))).alias("bad_outcome"), F.bool_or(F.coalesce(F.col("depth") < 0, F.lit(True))).alias("bad_depth"), F.bool_or(urls.safety_reason("url").isNotNull()).alias("bad_url"),
        F.bool_or(F.col("path").isNull() & F.col("record_hash").isNotNull()).alias("hash_alone"), F.bool_or(F.col("path").isNotNull() & ~ids.digest_ok("record_hash")).alias("bad_hash"), F.bool_or(F.col("path").isNotNull() & ~ids.relative_path_ok("path")).alias("bad_path"),
    )
    last = events.groupBy("run_id", "canonical_url").agg(F.max_by("status", "event_index").alias("status"))
    pending = last.groupBy("run_id").agg(F.bool_or(F.col("status").isin("queued", "in_progress")).alias("pending"))
    event = events.groupBy("run_id").agg(
        F.bool_or(~F.coalesce(F.col("status").isin(*STATES), F.lit(False))).alias("bad_state"), F.bool_or(~F.coalesce(F.col("skip_reason").isin(*REASONS), F.lit(True))).alias("bad_reason"), F.bool_or((F.col("status") == "skipped") != F.col("skip_reason").isNotNull()).alias("skip_mixed"),
    )
    shut = events.where("skip_reason = 'robots_unavailable'").select("run_id", F.col("canonical_url").alias("url")).distinct()
    shut = shut.join(growing(pages.where("outcome = 'failed'").select("run_id", "url")), ["run_id", "url"], "left_anti").select("run_id").distinct().withColumn("shut", F.lit(True))
    j = growing(runs)
    for part in (page, event, pending, shut):
        j = j.join(growing(part), "run_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    expected = F.when(zero("n_failed") == 0, "complete").when(zero("n_paths") > 0, "partial").otherwise("failed")
    rules = [
        ("run-id", ~F.coalesce(F.col("run_id").rlike("^[a-f0-9]{16}$"), F.lit(False))), ("created-at", ~text.timestamp_valid("created_at")), ("seed", ~F.col("seed").eqNullSafe(urls.canonicalize("seed"))), ("status", ~F.col("status").eqNullSafe(expected)),
        *((f"count-{c}", ~F.col(c).eqNullSafe(zero(f"n_{o}"))) for c, o in (("written", "written"), ("duplicates", "duplicate"), ("empty", "empty"), ("failed", "failed"))),
        ("fetched-pages", F.col("fetched_pages") > zero("n_pages")), ("negative", F.least("fetched_pages", "total_bytes") < 0),
        *((f"page-{x}", F.col(x.replace("-", "_"))) for x in ("bad-outcome", "bad-depth", "bad-url", "hash-alone", "bad-hash", "bad-path")),
        ("no-events", F.col("bad_state").isNull()), *((f"event-{x}", F.col(x.replace("-", "_"))) for x in ("bad-state", "bad-reason", "skip-mixed")),
        ("robots-unavailable", F.col("shut")), ("exhausted-and-limited", F.col("frontier_exhausted") & F.col("page_limit_reached")), ("exhausted-but-pending", F.col("frontier_exhausted") & F.col("pending")), ("limited-but-done", F.col("page_limit_reached") & ~F.coalesce("pending", F.lit(False))),
    ]
    out = j.select("run_id", _named(rules).alias("rule"))
    if files is not None:
        own = pages.where("path is not null").join(growing(files.select("path", F.col("record_hash").alias("now"))), "path", "left")
        changed = F.when(F.col("now").isNull(), "record-missing").when(F.col("now") != F.col("record_hash"), "record-changed")
        out = out.union(own.select("run_id", changed.alias("rule")).where("rule is not null").distinct())
    return out


def site_receipts(runs: DataFrame, pages: DataFrame, events: DataFrame) -> DataFrame:
    """(run_id, receipt): each run with its pages and events as one JSON text."""
    p = pages.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in pages.columns if c != "run_id"]))).alias("pages"))
    e = events.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("event_index", *[c for c in events.columns if c not in ("run_id", "event_index")]))).alias("frontier_events"))
    j = runs.join(p, "run_id", "left").join(e, "run_id", "left").withColumn("contract", F.lit("provenance-site-acquisition.v1"))
    return j.select("run_id", F.to_json(F.struct(*sorted(j.columns)), {"ignoreNullFields": "false"}).alias("receipt"))


def import_faults(items: DataFrame, imported: DataFrame, blobs: DataFrame, declared_bytes: DataFrame) -> DataFrame:
    """(package_id, item_id, fault): manifest items against imported assets, their stored blobs, and declared totals.

    ``items`` (package_id, item_id, sha256, byte_size, mime, title), ``imported`` (package_id, item_id, asset_id, sha256, byte_size,
    media_type, alt), ``blobs`` (sha256 of the stored bytes), ``declared_bytes`` (package_id, total).
    """
    keys = ["package_id", "item_id"]
    i = items.select(*keys, F.struct("sha256", "byte_size", F.lower("mime").alias("mime"), text.redact(F.coalesce("title", F.lit(""))).alias("title")).alias("i"))
    a = imported.select(*keys, F.struct("asset_id", "sha256", "byte_size", "media_type", "alt").alias("a"))
    stored = blobs.select(F.col("sha256").alias("_blob")).distinct()
    j = i.join(a, keys, "full_outer").join(stored, F.col("a.sha256") == F.col("_blob"), "left")
    both = F.col("i").isNotNull() & F.col("a").isNotNull()
    asset = ids.asset_id("a.sha256", F.col("package_id"), F.col("item_id"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    rules = [
        ("not-imported", F.col("a").isNull()), ("not-in-manifest", F.col("i").isNull()), ("digest", both & (F.col("a.sha256") != F.col("i.sha256"))), ("size", both & (F.col("a.byte_size") != F.col("i.byte_size"))), ("media-type", both & ~F.col("a.media_type").eqNullSafe(F.col("i.mime"))),
        ("title", both & ~F.col("a.alt").eqNullSafe(F.col("i.title"))), ("asset-id", F.col("a").isNotNull() & (F.col("a.asset_id") != asset)), ("blob-missing", F.col("a").isNotNull() & F.col("_blob").isNull()),
    ]
    total = imported.groupBy("package_id").agg(F.sum("byte_size").alias("sum"))
    wrong = declared_bytes.join(total, "package_id", "left").where(~F.col("total").eqNullSafe(F.coalesce("sum", F.lit(0)).cast("long")))
    return j.select(*keys, _named(rules).alias("fault")).union(wrong.select("package_id", F.lit(None).cast("string"), F.lit("total-bytes")))


BROWSER_OUTCOMES = ("written", "duplicate", "empty")


def browser_faults(receipts: DataFrame, files: DataFrame | None = None, known_assets: DataFrame | None = None) -> DataFrame:
    """(run_id, rule) of all rules that receipts of rendered pages break.

    ``receipts`` (run_id, file_name, created_at, outcome, requested_url, final_url, title, status_code, content_type, request_count, network_bytes, source_profile,
    source_primitive, record_path, record_hash, asset_ids). ``files`` (path, record_hash) are hashes of the stored records, ``known_assets`` (asset_id) the manifest's.
    """
    absent = F.col("record_path").isNull()
    url = lambda c: urls.safety_reason(c).isNotNull() | ~F.col(c).eqNullSafe(urls.sanitize(c))
    rules = [
        ("run-id", ~F.coalesce(F.col("run_id").rlike("^[a-f0-9]{16}$"), F.lit(False))), ("file-name", ~F.coalesce(F.endswith("file_name", F.concat(F.lit("-"), "run_id", F.lit(".json"))), F.lit(False))), ("created-at", ~text.timestamp_valid("created_at")),
        ("requested-url", url("requested_url")), ("final-url", url("final_url")), ("title", F.col("title").isNull()), ("content-type", F.col("content_type").isNull()), ("source-primitive", F.coalesce("source_primitive", F.lit("")) == ""),
        ("source-profile", ~F.col("source_profile").eqNullSafe(F.lit("browser"))), ("status-code", ~F.coalesce(F.col("status_code").between(100, 599), F.lit(False))), ("request-count", F.coalesce("request_count", F.lit(0)) < 1), ("network-bytes", F.coalesce("network_bytes", F.lit(-1)) < 0),
        ("outcome", ~F.coalesce(F.col("outcome").isin(*BROWSER_OUTCOMES), F.lit(False))), ("record-of-outcome", absent != F.col("outcome").eqNullSafe(F.lit("empty"))), ("record-hash", F.when(absent, F.col("record_hash").isNotNull()).otherwise(~ids.digest_ok("record_hash"))),
        ("record-path", ~absent & ~ids.relative_path_ok("record_path")), ("asset-ids", F.col("asset_ids").isNull() | (F.size(F.array_distinct("asset_ids")) < F.size("asset_ids")) | F.exists("asset_ids", lambda x: ~F.coalesce(x.rlike("^asset-[a-f0-9]{64}$"), F.lit(False)))),
    ]
    out = receipts.select("run_id", _named(rules).alias("rule"))
    if files is not None:
        own = receipts.where("record_path is not null").select("run_id", "record_path", "record_hash").join(files.select(F.col("path").alias("record_path"), F.col("record_hash").alias("_now")), "record_path", "left")
        changed = F.when(F.col("_now").isNull(), "record-missing").when(~F.col("_now").eqNullSafe(F.col("record_hash")), "record-changed")
        out = out.union(own.select("run_id", changed.alias("rule")).where("rule is not null"))
    if known_assets is not None:
        named = receipts.select("run_id", F.explode("asset_ids").alias("asset_id"))
        out = out.union(named.join(known_assets.select("asset_id").distinct(), "asset_id", "left_anti").select("run_id", F.lit("asset-unknown")).distinct())
    return out


def browser_receipts(rendered: DataFrame) -> DataFrame:
    """(run_id, file_name, receipt): receipts of rendered pages as JSON, with URLs made safe; a row that would break a rule is an error.

    ``rendered`` has the columns of ``browser_faults``' receipts but for file_name, which comes of the time and the run.
    """
    r = rendered.withColumns({"requested_url": urls.sanitize("requested_url"), "final_url": urls.sanitize("final_url"), "file_name": F.concat(text.timestamp_name("created_at"), F.lit("-"), "run_id", F.lit(".json")), "source_profile": F.lit("browser")})
    bad = browser_faults(r).groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_set("rule")), ", ").alias("_bad"))
    fields = sorted(c for c in r.columns if c != "file_name")
    body = F.to_json(F.struct(F.lit("provenance-browser-run.v1").alias("contract"), *fields), {"ignoreNullFields": "false"})
    checked = F.when(F.col("_bad").isNotNull(), F.raise_error(F.concat(F.lit("invalid browser receipt: "), "_bad")).cast("string")).otherwise(body)
    return r.join(bad, "run_id", "left").select("run_id", "file_name", checked.alias("receipt"))
