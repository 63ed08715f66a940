"""Operators on small tables: outcomes, frontiers, policies, assets, evidence, files, adapters, streams."""

from __future__ import annotations

import glob
import hashlib
import math
import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quern.operators import assets, collect, evidence, frontier, policy, receipts, records
from quern.sources import files
from quern.streaming import records as streams

ITEM = "platform string, source_url string, title string, author string, date string, body string, n int"


def items(spark, rows):
    return spark.createDataFrame([("web", u, t, "", "", b, n) for n, (u, t, b) in enumerate(rows)], ITEM)


def written(spark, rows, existing=None):
    return records.outcomes(records.identified(items(spark, rows)), "n", existing)


def test_outcomes_need_url_and_body(spark):
    rows = [("https://a.example/?utm_source=x", "T", "body"), ("https://a.example/?utm_source=x#f", "T", " body "), ("https://b.example/", "T", "body"), ("https://a.example/", "T", "  "), ("https://a.example/", "T", None)]
    assert [r.outcome for r in written(spark, rows).orderBy("n").collect()] == ["written", "duplicate", "written", "empty", "empty"]
    known = written(spark, rows[:1]).select("platform", "safe_url", "content_hash")
    assert [r.outcome for r in written(spark, rows[:1], known).collect()] == ["duplicate"]


def test_paths_of_colliding_slugs(spark):
    done = written(spark, [("https://a.example/", "Same", "1"), ("https://b.example/", "Same", "2"), ("https://c.example/", "Other", "3")])
    got = {r.n: r.path for r in records.paths(done, "n").collect()}
    assert got[0] == "web/same.md" and re.fullmatch("web/same-[0-9a-f]{8}.md", got[1]) and got[2] == "web/other.md"


def test_markdown_round_trip_and_tampering(spark, tmp_path):
    done = records.paths(written(spark, [("https://a.example/", "A: title", "Body\n\nmore"), ("https://b.example/", "", "two")]), "n").withColumn("scraped_at", F.lit("2026-01-01T00:00:00Z"))
    files.write_markdown(done, str(tmp_path))
    got = files.read_markdown(spark, str(tmp_path)).orderBy("body").collect()
    assert [(r.title, r.body, r.fault) for r in got] == [("A: title", "Body\n\nmore", None), ("", "two", None)]
    for p in glob.glob(f"{tmp_path}/web/a-title.md"):
        with open(p, "a") as f:
            f.write("tampered")
    (tmp_path / "plain.md").write_text("no front matter")
    assert sorted(str(r.fault) for r in files.read_markdown(spark, str(tmp_path)).collect()) == ["None", "content-hash", "no-front-matter"]


def site(spark, links):
    return spark.createDataFrame([(u, l) for u, l in links.items()], "url string, links array<string>")


def crawl(spark, links, seed="https://e.example/start", **bounds):
    p = frontier.CrawlPolicy(**bounds)
    rows = frontier.frontier(spark.createDataFrame([(seed,)], "seed string"), site(spark, links), p).orderBy("seq").collect()
    return [(r.canonical_url.removeprefix("https://e.example"), r.depth, r.status, r.skip_reason) for r in rows]


def test_frontier_order_and_identity(spark):
    got = crawl(spark, {"https://e.example/start": ["/a?b=2&a=1#x", "/b", "/a?a=1&b=2", "https://other.example/", "javascript:x", "/start?utm_source=q"], "https://e.example/b": ["/c"]}, max_depth=2)
    assert got == [("/start", 0, "done", None), ("/a?a=1&b=2", 1, "failed", None), ("/b", 1, "done", None), ("https://other.example/", 1, "skipped", "cross_origin"), ("/c", 2, "failed", None)]


def test_frontier_bounds(spark):
    links = {"https://e.example/start": ["/a", "/b", "/c", "/d"], "https://e.example/a": ["/deep"]}
    assert [x[0] for x in crawl(spark, links, max_links_per_page=2)] == ["/start", "/a", "/b", "/deep"]
    assert [x[0] for x in crawl(spark, links, max_frontier_entries=3)] == ["/start", "/a", "/b"]
    assert [x[2] for x in crawl(spark, links, max_pages=2)] == ["done", "done", "queued", "queued", "queued", "skipped"]
    assert crawl(spark, links)[-1] == ("/deep", 2, "skipped", "max_depth")
    assert crawl(spark, links, deny_patterns=("*/b",))[2][3] == "policy_denied"
    with pytest.raises(ValueError):
        frontier.CrawlPolicy(max_pages=0)


def test_frontier_robots_and_ledger(spark):
    seeds = spark.createDataFrame([("https://e.example/",)], "seed string")
    robots = spark.createDataFrame([("https://e.example", 200, "User-agent: *\nDisallow: /x")], "origin string, status int, body string")
    pages = site(spark, {"https://e.example/": ["/x/1", "/y"]})
    got = frontier.frontier(seeds, pages, robots=robots)
    silent = {r.skip_reason for r in frontier.frontier(seeds, pages, robots=robots.where("false")).collect()}
    open_ = {r.skip_reason for r in frontier.frontier(seeds, pages, frontier.CrawlPolicy(robots_fail_closed=False), robots.where("false")).collect()}
    assert silent == {"robots_unavailable"} and open_ == {None}
    assert {r.canonical_url[-3:]: r.skip_reason for r in got.collect()}["x/1"] == "robots_disallowed"
    last = {r.canonical_url: r.status for r in frontier.latest_status(frontier.events(got)).collect()}
    assert last == {r.canonical_url: r.status for r in got.collect()}


def test_byte_budget_skips_and_goes_on(spark):
    rows = spark.createDataFrame([("s", k, n) for k, n in enumerate([40, 90, 50, 20, 10, 1])], "site string, k int, n long")
    got = frontier.byte_budget(rows, "site", "k", "n", 100, 60).orderBy("k").collect()
    assert [(r.outcome, r.spent) for r in got] == [("fetched", 40), ("too_large", 40), ("fetched", 90), ("too_large", 90), ("fetched", 100), ("exhausted", 100)]


def test_policy_rules(spark):
    cols = "access_class string, rights_status string, permitted_uses array<string>, notes string, basis string, approval_id string, account_owner string, local_only boolean"
    rows = [("public", "public", ["a"], "", "public", "", "", False), ("private", "public", ["a", "a"], "Cookie: x=1", "public", None, None, False), ("owned", "owned", [], None, "operator-approved-export", " ", "", True), (None, None, None, None, None, None, None, None)]
    got = [r.v for r in spark.createDataFrame(rows, cols).select(policy.violations().alias("v")).collect()]
    assert got == [[], ["status-matches-class", "uses-distinct", "notes-safe", "public-basis", "local-only"], ["uses-present", "approval-required"], ["access-class", "rights-status", "uses-present", "basis"]]


def test_assets(spark):
    a = spark.createDataFrame([("1", "x", 1), ("2", "y", 2)], "id string, v string, n int")
    b = spark.createDataFrame([("2", "z", 2), ("3", "w", 3)], "id string, v string, n int")
    rows, conflict = assets.merged(a, b, "id")
    assert {tuple(r) for r in rows.collect()} == {("1", "x", 1), ("2", "y", 2), ("3", "w", 3)} and [r.id for r in conflict.collect()] == ["2"]
    assert {tuple(r) for r in assets.bijection(a, b, ["id"], ["v", "n"]).collect()} == {("1", "missing-right"), ("2", "different-v"), ("3", "missing-left")}
    assert {tuple(r) for r in assets.difference(a.select("id"), b.select("id")).collect()} == {("1", "left"), ("3", "right")}


def test_site_receipts(spark):
    run = ("0" * 16, "2026-01-01T00:00:00Z", "https://e.example/", "complete", 1, 0, 0, 0, 1, 10, True, False)
    cols = "run_id string, created_at string, seed string, status string, written int, duplicates int, empty int, failed int, fetched_pages int, total_bytes int, frontier_exhausted boolean, page_limit_reached boolean"
    pages = spark.createDataFrame([("0" * 16, "https://e.example/", 0, "written", "web/a.md", "a" * 64)], "run_id string, url string, depth int, outcome string, path string, record_hash string")
    events = spark.createDataFrame([("0" * 16, 0, "https://e.example/", "queued", None), ("0" * 16, 1, "https://e.example/", "done", None)], "run_id string, event_index int, canonical_url string, status string, skip_reason string")
    files = spark.createDataFrame([("web/a.md", "a" * 64)], "path string, record_hash string")
    rules = lambda *x: {r.rule for r in receipts.site_faults(*x).collect()}
    runs = spark.createDataFrame([run], cols)
    assert rules(runs, pages, events, files) == set()
    forged = spark.createDataFrame([("zz", "2026", "https://E.example/", "partial", 2, 0, 0, 0, 9, -1, True, True)], cols)
    assert rules(forged, pages, events) == {"run-id", "created-at", "seed", "status", "count-written", "fetched-pages", "negative", "no-events", "exhausted-and-limited", "limited-but-done"}
    assert rules(runs, pages, events, files.withColumn("record_hash", F.lit("b" * 64))) == {"record-changed"}
    assert rules(runs, pages, events.where("event_index = 0"), files) == {"exhausted-but-pending"}
    assert '"contract":"provenance-site-acquisition.v1"' in receipts.site_receipts(runs, pages, events).first().receipt


def test_site_joins_are_never_broadcast(spark):
    pages = spark.createDataFrame([(f"https://s.example/{k}", [f"/{k + 1}", "/none"]) for k in range(9)], "url string, links array<string>")
    e = frontier.frontier(pages.select(F.col("url").alias("seed")), pages)
    page = e.where("status <> 'queued'").select(F.substring(F.sha2("seed", 256), 1, 16).alias("run_id"), F.col("canonical_url").alias("url"), "depth", F.lit("written").alias("outcome"), F.lit("p").alias("path"), F.sha2("seed", 256).alias("record_hash"))
    ledger = frontier.events(e).select(F.substring(F.sha2("seed", 256), 1, 16).alias("run_id"), "event_index", "canonical_url", "status", F.lit(None).cast("string").alias("skip_reason"))
    runs = page.groupBy("run_id").agg(F.max("url").alias("seed"), F.lit("2026-01-01T00:00:00Z").alias("created_at"), F.lit("complete").alias("status"), *(F.count("*").alias(c) for c in ("written", "duplicates", "empty", "failed", "fetched_pages", "total_bytes")), F.lit(True).alias("frontier_exhausted"), F.lit(False).alias("page_limit_reached"))
    for df in (e, receipts.site_faults(runs, page, ledger, page.select("path", "record_hash").distinct())):
        joins = [line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if re.search(r"\bJoin ", line)]
        assert joins and all("strategy=merge" in line for line in joins)


def test_runs_are_counted_without_reading_pages_again(spark):
    pages = spark.createDataFrame([("https://s.example/", '<a href="/b">b</a><p>one'), ("https://s.example/b", "<p> </p>")], "url string, html string")
    existing = spark.createDataFrame([("web", "https://s.example/", hashlib.sha256(b"b one").hexdigest())], "platform string, safe_url string, content_hash string")
    for old, written, duplicates in ((None, 1, 0), (existing, 0, 1)):
        got = collect.collect_sites(pages.select(F.col("url").alias("seed")).where("url not like '%b'"), pages, existing=old)
        assert "html" not in got.runs._jdf.queryExecution().optimizedPlan().toString()
        r = got.runs.first()
        assert (r.written, r.duplicates, r.empty, r.failed, r.status, r.total_bytes) == (written, duplicates, 1, 0, "complete", 32)
        assert sorted((i.url[-1], i.outcome, i.path is None) for i in got.items.collect()) == [("/", "written" if written else "duplicate", False), ("b", "empty", True)]


def test_import_faults(spark):
    from quern.functions import ids

    items = spark.createDataFrame([("p", "a", "1" * 64, 3, "text/Plain", "T"), ("p", "b", "2" * 64, 4, "text/plain", None)], "package_id string, item_id string, sha256 string, byte_size long, mime string, title string")
    none = F.lit(None).cast("string")
    good = items.select("package_id", "item_id", ids.asset_id("sha256", F.col("package_id"), F.col("item_id"), none, none).alias("asset_id"), "sha256", "byte_size", F.lower("mime").alias("media_type"), F.coalesce("title", F.lit("")).alias("alt"))
    total = spark.createDataFrame([("p", 7)], "package_id string, total long")
    faults = lambda a, b: {(r.item_id, r.fault) for r in receipts.import_faults(items, a, b, total).collect()}
    assert faults(good, items) == set()
    assert faults(good.where("item_id = 'a'"), items) == {("b", "not-imported"), (None, "total-bytes")}
    assert faults(good, items.where("item_id = 'a'")) == {("b", "blob-missing")}


def corpus(spark):
    rows = [("a1", "First", "A durable corpus preserves source lineage.\n\nA second paragraph explains receipts.", "public", None, "s"), ("a2", "", "lineage of the source, the source again", "licensed", None, "s"), ("a3", "", "source lineage withdrawn", "public", "2026-01-01T00:00:00Z", "t")]
    d = spark.createDataFrame(rows, "asset_id string, title string, body string, access_class string, tombstoned_at string, source_id string")
    return d.withColumns({"modality": F.lit("text"), "safe_source_url": F.lit(None).cast("string"), "sha256": F.sha2("body", 256)})


def test_bm25_against_a_loop(spark):
    u = evidence.units(corpus(spark))
    rows = u.collect()
    query = "source lineage source"
    docs = {r.evidence_id: re.findall(r"[\w'-]+", f"{r.title} {r.text}".lower()) for r in rows}
    n, average = len(docs), round(sum(map(len, docs.values())) / len(docs), 10)
    want = {}
    for k, w in docs.items():
        s = 0.0
        for t in query.split():
            df = sum(t in x for x in docs.values())
            if tf := w.count(t):
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / average))
        if s:
            want[k] = round(s, 10)
    for got in (evidence.bm25(u, query), evidence.bm25_from_index(evidence.text_index(u), query)):
        assert {r.evidence_id: r.text_score for r in got.collect()} == pytest.approx(want)


def test_stored_postings_are_grouped_without_shuffling_them(spark, tmp_path):
    rows = [(f"e{k}", None if k % 7 == 0 else f"T{k % 3}", " ".join(f"w{k * j % 11} the" for j in range(k % 5))) for k in range(60)] + [("null", None, None)]
    for u in (rows, [*rows, ("e4", "T1", "the w9 w9")]):  # the second time an id repeats
        u = spark.createDataFrame(u, "evidence_id string, title string, text string").repartition(3)
        x = evidence.text_index(u)
        got = evidence.sorted_postings(u, x.lengths)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, x.postings.collect())) and got.schema["tf"].dataType == x.postings.schema["tf"].dataType
        terms = [[r.term for r in part] for part in got.rdd.glom().collect()]
        assert all(p == sorted(p) for p in terms) and sum(len(set(p)) for p in terms) == x.terms.count()
    plan = evidence.sorted_postings(spark.createDataFrame(rows, "evidence_id string, title string, text string"), x.lengths.limit(0))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
    empty = spark.createDataFrame([], "evidence_id bigint, title string, text string")
    assert evidence.sorted_postings(empty, evidence.text_index(empty).lengths).count() == 0


def test_citations_filter_fuse_and_cap(spark):
    a = corpus(spark)
    u = evidence.units(a)
    got = evidence.citations(u, a, "source lineage").orderBy("rank").collect()
    assert {r.asset_id for r in got} == {"a1", "a2"} and [r["rank"] for r in got] == [1, 2]
    assert [r.asset_id for r in evidence.citations(u, a, "lineage", access_classes=["licensed"]).collect()] == ["a2"]
    assert len(evidence.citations(u, a, "lineage", per_source=1).collect()) == 1
    look = u.select("evidence_id", F.lit(0.5).alias("visual_score"))
    both = evidence.citations(u, a, "receipts", look).collect()
    assert {r.matched_modalities for r in both} == {"text+visual", "visual"}
    assert evidence.citations(u, a, "nothinglikeit").count() == 0
    for bad in ({"query": " "}, {"query": "x", "limit": 0}):
        with pytest.raises(ValueError):
            evidence.citations(u, a, **bad)


def test_index_is_the_same_however_it_is_built(spark, tmp_path):
    a = corpus(spark).where("tombstoned_at is null")
    one = evidence.publish(evidence.units(a), a, f"file://{tmp_path}/i")
    two = evidence.manifest(evidence.units(a.repartition(7)), a.repartition(3)).first()["index_id"]
    assert one == two == evidence.publish(evidence.units(a.repartition(2)), a, f"file://{tmp_path}/i")
    u, stored, index = evidence.load(spark, f"file://{tmp_path}/i")
    assert evidence.violations(u, stored, a).count() == 0
    assert index.terms.where("term = 'lineage'").first().df == 2


def test_violations_see_a_consistent_forgery(spark):
    a = corpus(spark)
    live = a.where("tombstoned_at is null")
    u = evidence.units(live)
    assert evidence.violations(u, live, a).count() == 0
    forged = evidence.units(live.withColumn("body", F.concat("body", F.lit(" forged"))))
    rules = {r.rule for r in evidence.violations(forged, live, a).collect()}
    assert rules == {"evidence-missing", "evidence-not-derived"}
    assert "evidence-without-asset" in {r.rule for r in evidence.violations(u, live.where("asset_id = 'a1'"), a).collect()}


def test_violations_derive_units_once(spark):
    a = spark.createDataFrame([(f"a{k}", "", "some words " * 300, "d", None) for k in range(4)], "asset_id string, title string, body string, sha256 string, tombstoned_at string")
    u = evidence.units(a).where("asset_id <> 'a1'").withColumn("content_hash", F.when((F.col("asset_id") == "a2") & (F.col("char_start") == 0), "x").otherwise(F.col("content_hash")))
    v = evidence.violations(u, a, a.select("asset_id", "title", "body", "sha256"))
    plan = v._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20
    assert sorted(r.rule for r in v.collect()) == ["content-hash", *["evidence-missing"] * (evidence.units(a.where("asset_id = 'a1'")).count() + 1), "evidence-not-derived"]


def test_empty_tables(spark):
    a = corpus(spark).where("false")
    u = evidence.units(a)
    assert u.count() == 0 and evidence.text_index(u).stats.first()["document_count"] == 0
    assert evidence.manifest(u, a).first()["text_query"] is False
    assert frontier.frontier(spark.createDataFrame([], "seed string"), site(spark, {"https://e.example/": []})).count() == 0


def test_export_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("fine")
    (tmp_path / "a" / "y.txt").write_text("Cookie: sid=1")
    (tmp_path / ".hidden.md").write_text("no")
    (tmp_path / "z.bin").write_bytes(b"no")
    over = spark.createDataFrame([("a/x.md", "Named", "https://u:p@e.example/")], "path string, title string, source_url string")
    got = {r.path: r for r in files.discover_export(spark, str(tmp_path), over).collect()}
    assert sorted(got) == ["a/x.md", "a/y.txt"] and got["a/x.md"].title == "Named" and got["a/x.md"].source_url == "https://e.example/"
    assert got["a/x.md"].fault is None and got["a/y.txt"].fault == "secret"


def test_manifests(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"asset_id":"a","local_path":"x.md","sha256":"0","bytes":1,"modality":"text"}\n\n')
    (tmp_path / "b.json").write_text('{"contract":"provenance-assets.v1","assets":[{"asset_id":"b","relative_path":"y.png","sha256":"1","byte_size":2,"media_type":"image/png","role":"cover"}]}')
    got = files.read_manifests(spark, str(tmp_path / "a.jsonl"), str(tmp_path / "b.json"))
    assert [(r.asset_id, r.mime, r.modality, r.local_only) for r in got.orderBy("asset_id").collect()] == [("a", "text/markdown", "text", True), ("b", "image/png", "image", True)]
    faults = files.manifest_faults(got, spark.createDataFrame([("x.md", b"z")], "path string, content binary"))
    assert {tuple(r) for r in faults.collect()} == {("a", "digest"), ("b", "missing")}


def package(folder, **changes):
    import hashlib
    import json

    (folder / "files").mkdir(parents=True)
    (folder / "files/a.txt").write_text("a plain text")
    (folder / "files/b.png").write_bytes(b"\x89PNG same")
    (folder / "files/c.png").write_bytes(b"\x89PNG same")
    item = lambda n, mime, kind: {"item_id": n[0], "path": f"files/{n}", "sha256": hashlib.sha256((folder / "files" / n).read_bytes()).hexdigest(), "byte_size": (folder / "files" / n).stat().st_size, "mime": mime, "modality": kind, "title": n, "source_url": "https://e.example/?token=x&k=1", "transcript_path": None, "metadata": {}}
    m = {"contract": "c.v1", "package_id": "p-1", "connector": "files", "created_at": "2026-01-01T00:00:00Z", "source_policy": {"access_class": "owned", "rights_status": "owned", "local_only": True, "permitted_uses": ["x"]}, "items": [item("a.txt", "text/plain", "text"), item("b.png", "image/png", "image"), item("c.png", "image/png", "image")]}
    for x in m["items"]:
        x["source_url"] = "https://e.example/?k=1"
    for k, v in changes.items():
        at, _, field = k.partition("__")
        if field:
            m["items"][int(at[1:])][field] = v
        else:
            m[k] = v
    (folder / "source-package.json").write_text(json.dumps(m))
    return str(folder / "source-package.json")


def test_package_import(spark, tmp_path):
    import json
    import os

    got = files.import_package(spark, package(tmp_path / "p"), str(tmp_path / "out")).orderBy("item_id").collect()
    assert [r.item_id for r in got] == ["a", "b", "c"] and len({r.relative_path for r in got}) == 2 and all((tmp_path / "out" / r.relative_path).read_bytes() for r in got)
    receipt = json.loads((tmp_path / "out/import-receipt.json").read_text())
    assert receipt["asset_count"] == 3 and receipt["total_bytes"] == 12 + 2 * 9 and receipt["package_id"] == "p-1"
    with pytest.raises(ValueError, match="empty"):
        files.import_package(spark, package(tmp_path / "p2"), str(tmp_path / "out"))
    bad = {"digest": {"i0__sha256": "0" * 64}, "size": {"i1__byte_size": 1}, "missing file": {"i2__path": "files/none"}, "unsafe": {"i2__path": "../x"}, "item-id-repeats": {"i1__item_id": "a"}, "transcript-missing": {"i0__transcript_path": "files/z"}}
    for k, (what, change) in enumerate(bad.items()):
        with pytest.raises(ValueError, match=what):
            files.import_package(spark, package(tmp_path / f"b{k}", **change), str(tmp_path / f"o{k}"))
        assert not [x for x in os.listdir(tmp_path) if x.startswith(f"o{k}")]
    with pytest.raises(Exception, match="secret at"):
        files.import_package(spark, package(tmp_path / "s", i0__metadata={"api_key": "v"}), str(tmp_path / "os"))
    with pytest.raises(Exception, match="missing: connector"):
        files.import_package(spark, package(tmp_path / "m", connector=""), str(tmp_path / "om"))
    with pytest.raises(ValueError, match="too large"):
        files.import_package(spark, package(tmp_path / "l"), str(tmp_path / "ol"), max_total_bytes=20)


def test_blobs_hashes_and_targets(spark):
    import hashlib

    from quern.sources import adapters

    sha = hashlib.sha256(b"x").hexdigest()
    path = f"_assets/sha256/{sha[:2]}/{sha}"
    rows = [("ok", sha, 1, path), ("size", sha, 2, path), ("path", sha, 1, "../x"), ("of", sha, 1, "y"), ("gone", "0" * 64, 1, "_assets/sha256/00/" + "0" * 64)]
    got = assets.blob_faults(spark.createDataFrame(rows, "asset_id string, sha256 string, byte_size long, relative_path string"), spark.createDataFrame([(path, b"x")], "path string, content binary"))
    assert {tuple(r) for r in got.collect()} == {("size", "size"), ("path", "path"), ("of", "path-of-digest"), ("gone", "missing")}
    d = spark.createDataFrame([("ffffffffffffffff", "r/grain/new/"), ("000000000000000f", "flour"), ("8000000000000000", "/r/"), (None, "a/odd")], "h string, t string")
    got = d.select(evidence.hash_bits(F.col("h")).alias("n"), adapters.reddit_target("t").alias("x")).collect()
    assert [r.n for r in got] == [-1, 15, -(2**63), None]
    assert [tuple(r.x) for r in got] == [("grain", "new"), ("flour", "hot"), ("popular", "hot"), ("a", "hot")]


def test_strict_reading(spark, tmp_path):
    (tmp_path / "x.md").write_text("no front matter")
    assert files.read_markdown(spark, str(tmp_path)).first()["fault"] == "no-front-matter"
    with pytest.raises(Exception, match="no-front-matter"):
        files.read_markdown(spark, str(tmp_path), strict=True).collect()
    (tmp_path / "m.json").write_text('{"contract":"other","assets":[{"asset_id":"b"}]}')
    with pytest.raises(Exception, match="unsupported contract"):
        files.read_manifests(spark, portable=str(tmp_path / "m.json")).collect()


def test_index_checks_itself(spark, tmp_path):
    a = spark.createDataFrame([(f"asset-{k}", "t", f"text number {k} of the index") for k in range(9)], "asset_id string, title string, body string").withColumns({"sha256": F.sha2("body", 256)})
    u = evidence.units(a)
    folder = f"file://{tmp_path}/i"
    evidence.publish(u, a, folder)
    units, stored, index = evidence.load(spark, folder, check=True)
    row = evidence.manifest(units, stored)
    faults = lambda *x: sorted(r["rule"] for r in evidence.index_faults(*x).collect())
    assert faults(units, stored, index, row) == []
    assert faults(units.where("asset_id <> 'asset-3'"), stored, index, row) == ["content-hash", "counts", "index-id", "lengths", "postings", "stats", "terms"]
    index.terms = index.terms.withColumn("df", F.col("df") + F.when(F.col("term") == "index", 1).otherwise(0))
    assert faults(units, stored, index, row) == ["terms"]
    generation = next((tmp_path / "i/generations").iterdir())
    units.withColumn("text", F.lit("x")).withColumn("content_hash", F.sha2("text", 256)).write.mode("overwrite").parquet(f"{tmp_path}/other")
    import shutil

    shutil.rmtree(generation / "evidence")
    shutil.copytree(tmp_path / "other", generation / "evidence")
    with pytest.raises(ValueError, match="another content"):
        evidence.publish(u, a, folder)
    with pytest.raises(ValueError, match="content-hash"):
        evidence.load(spark, folder, check=True)


def test_ranks_and_totals_by_ranges(spark):
    """Ranks and running sums over many ranges are those of one pass; ties, nulls and one key with most rows included."""
    rows = [(k, float((k * 7919) % 50), "a" if k % 3 else ("b" if k % 2 else None), k % 11) for k in range(400)]
    d = spark.createDataFrame(rows, "k long, score double, g string, n long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.k: r.position for r in evidence.ranked(d, "score", "k").collect()}
        totals = {r.k: (r.running, r.over) for r in assets.running_total(d, "k", "n", 300, "g").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {k: p for p, (_, k) in enumerate(sorted((-s, k) for k, s, _, _ in rows), 1)}
    run = {}
    for k, _, g, n in rows:
        run[g] = run.get(g, 0) + n
        assert totals[k] == (run[g], run[g] > 300)


def test_browser_receipts(spark):
    cols = "run_id string, created_at string, outcome string, requested_url string, final_url string, title string, status_code int, content_type string, request_count int, network_bytes long, source_primitive string, record_path string, record_hash string, asset_ids array<string>"
    good = ("0" * 16, "2026-01-01T00:00:00Z", "written", "https://e.example/", "https://e.example/?k=1", "T", 200, "text/html", 3, 10, "page", "web/a.md", "a" * 64, ["asset-" + "b" * 64])
    d = spark.createDataFrame([good], cols)
    r = receipts.browser_receipts(d).first()
    assert r.file_name == "20260101T000000.000000Z-" + "0" * 16 + ".json" and '"source_profile":"browser"' in r.receipt
    with pytest.raises(Exception, match="invalid browser receipt: request-count, status-code"):
        receipts.browser_receipts(d.withColumns({"status_code": F.lit(99), "request_count": F.lit(0)})).collect()


def test_feeds_of_odd_shape(spark):
    """Other prefixes, no entries, entries without links or dates, and payloads that are no feed."""
    from quern.sources import adapters

    rdf = '<r:RDF xmlns:r="r"><channel><title>C</title></channel><item><title>I</title><link>https://a.example/i</link><q:creator xmlns:q="d">me</q:creator><q:date xmlns:q="d">2025</q:date></item></r:RDF>'
    rows = [("https://a.example", "<feed><title>E</title></feed>"), ("https://b.example", rdf), ("https://c.example", "<feed><entry><title>T</title></entry></feed>"), ("https://d.example", "no xml"), ("https://e.example", None)]
    got = adapters.rss(spark.createDataFrame(rows, "url string, payload string")).collect()
    assert sorted((r.source_url, r.title, r.author, r.date) for r in got) == [("", "T", "", ""), ("https://a.example/i", "I", "me", "2025")]


def test_stream_drops_repeats(spark, tmp_path):
    from pyspark.sql.types import StructType

    src = items(spark, [("https://a.example/", "T", "x"), ("https://a.example/#f", "T", "x "), ("https://b.example/", "T", "x")]).withColumn("arrived", F.to_timestamp(F.lit("2026-01-01 00:00:00")))
    src.write.parquet(f"{tmp_path}/in")
    schema = StructType.fromJson(src.schema.jsonValue())
    stream = streams.deduplicated(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    q = streams.append(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no test tables")
def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and {"rank", "evidence_id", "snippet"} <= set(df.columns)
