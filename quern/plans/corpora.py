"""Queries of evidence, records, frontiers and packages over the standard tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import ids, text, urls
from quern.operators import assets as blobs
from quern.operators import collect, evidence, frontier, policy, receipts, records, transport
from quern.operators.shared import growing, written
from quern.plans.registry import collapsed, query, stripped

QUERY = "heat from the token"
_TERMS = "['heat', 'from', 'the', 'token']"


def _assets(t):
    """Documents as assets: a source each, access by id, some withdrawn."""
    d = t("documents")
    access = F.element_at(F.array(*(F.lit(x) for x in ("public", "owned", "licensed", "private", "unknown", "paid-personal"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return d.select(
        F.concat(F.lit("asset-"), F.col("doc_id").cast("string")).alias("asset_id"), "doc_id", F.lit("").alias("title"), F.col("text").alias("body"), F.lit("text").alias("modality"), access.alias("access_class"),
        F.when(F.col("doc_id") % 97 == 0, "2026-01-01T00:00:00Z").alias("tombstoned_at"), F.col("source").alias("source_id"), F.concat(F.lit("https://"), "source", F.lit(".example.com/")).alias("safe_source_url"), F.sha2("text", 256).alias("sha256"),
    )


_ASSETS = "SELECT 'asset-' || doc_id AS asset_id, doc_id, text, source, ['public', 'owned', 'licensed', 'private', 'unknown', 'paid-personal'][doc_id % 6 + 1] AS access_class, doc_id % 97 = 0 AS tombstoned, 'https://' || source || '.example.com/' AS safe_source_url, sha256(text) AS sha256 FROM documents"

#: Chunks by a recursion over starts: the last blank line or blank in the second half ends one.
_CHUNKS = f"""
WITH RECURSIVE d AS (SELECT doc_id, {stripped('text')} AS body FROM documents), c AS (
  SELECT doc_id, 0 AS a, CAST(NULL AS INTEGER) AS z FROM d WHERE body <> ''
  UNION ALL
  SELECT doc_id, greatest(a + 1, e - 200), e FROM (
    SELECT doc_id, n, a, CASE WHEN a + 1600 < n AND greatest(blank, line) > a THEN greatest(blank, line) ELSE least(n, a + 1600) END AS e FROM (
      SELECT doc_id, a, n,
        CASE WHEN contains(w, ' ') THEN a + 800 + length(regexp_extract(w, '(?s)^(.*) ', 1)) ELSE -1 END AS blank,
        CASE WHEN contains(w, chr(10) || chr(10)) THEN a + 800 + length(regexp_extract(w, '(?s)^(.*)\\n\\n', 1)) ELSE -1 END AS line
      FROM (SELECT c.doc_id, c.a, length(d.body) AS n, substr(d.body, c.a + 801, least(length(d.body), c.a + 1600) - c.a - 800) AS w FROM c JOIN d USING (doc_id) WHERE c.z IS NULL OR c.z < length(d.body)))
  )
), raw AS (SELECT doc_id, z AS e, lag(a) OVER (PARTITION BY doc_id ORDER BY a, z NULLS FIRST) AS s FROM c), part AS (
  SELECT raw.doc_id, s, e, substr(body, s + 1, e - s) AS p FROM raw JOIN d USING (doc_id) WHERE e IS NOT NULL
), chunk AS (
  SELECT 'asset-' || doc_id AS asset_id, doc_id, s + length(p) - length(regexp_replace(p, '^[\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+', '')) AS char_start, {stripped('p')} AS text FROM part WHERE {stripped('p')} <> ''
), unit AS (
  SELECT 'evidence-' || left(sha256('["' || asset_id || '",' || char_start || ',' || (char_start + length(text)) || ',"' || sha256(text) || '"]'), 20) AS evidence_id, asset_id, doc_id, CAST(char_start AS INTEGER) AS char_start, CAST(char_start + length(text) AS INTEGER) AS char_stop, text, sha256(text) AS content_hash FROM chunk
)"""


@query(_CHUNKS + " SELECT evidence_id, asset_id, char_start, char_stop, content_hash FROM unit")
def chunk_ids(spark, t):
    """Every document's chunks with their ids."""
    return evidence.units(_assets(t)).select("evidence_id", "asset_id", "char_start", "char_stop", "content_hash")


@query(_CHUNKS + " SELECT doc_id, char_start, text FROM unit")
def chunks(spark, t):
    return evidence.units(_assets(t)).select(F.substring_index("asset_id", "-", -1).cast("long").alias("doc_id"), "char_start", "text")


_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_''-]+')"
_TF = f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS}) AS term FROM documents) GROUP BY doc_id, term"


def _index(t):
    return evidence.text_index(t("documents").select(F.col("doc_id").alias("evidence_id"), F.lit("").alias("title"), "text"))


@query(_TF)
def term_frequency(spark, t):
    return _index(t).postings.withColumnRenamed("evidence_id", "doc_id")


@query(f"SELECT term, count(*) AS df FROM ({_TF}) GROUP BY term")
def document_frequency(spark, t):
    return _index(t).terms


@query(f"SELECT count(*) AS document_count, round(sum(len({_WORDS})) / count(*), 10) AS average_length FROM documents")
def index_stats(spark, t):
    return _index(t).stats


def _bm25(docs: str, key: str, keep: str) -> str:
    return f"""w AS (SELECT {keep}, {_WORDS} AS w FROM {docs}), stat AS (SELECT count(*) AS n, round(sum(len(w)) / count(*), 10) AS average FROM w),
hit AS (SELECT {key}, len(w) AS length, q.term, CAST(len(list_filter(w, lambda x: x = q.term)) AS DOUBLE) AS tf FROM w, (SELECT unnest({_TERMS}) AS term) q),
df AS (SELECT term, CAST(count(*) FILTER (WHERE tf > 0) AS DOUBLE) AS df FROM hit GROUP BY term),
score AS (SELECT {key}, round(sum(ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * length / average))), 10) AS text_score FROM hit JOIN df USING (term), stat WHERE tf > 0 GROUP BY {key})"""


def _scores(t):
    return evidence.bm25(t("documents").select(F.col("doc_id").alias("evidence_id"), F.lit("").alias("title"), "text"), QUERY)


@query(f"WITH {_bm25('documents', 'doc_id', 'doc_id')} SELECT doc_id, text_score, CAST(row_number() OVER (ORDER BY text_score DESC, doc_id) AS INTEGER) AS position FROM score ORDER BY position LIMIT 20")
def bm25_topk(spark, t):
    """The best twenty documents for a text query."""
    return evidence.ranked(_scores(t), "text_score", most=20).withColumnRenamed("evidence_id", "doc_id")


@query(f"WITH {_bm25('documents', 'doc_id', 'doc_id')} SELECT doc_id, text_score FROM score")
def bm25_index(spark, t):
    """Scores of all documents with a word of the query, from a stored index of which only the postings of those words are read."""
    u = t("documents").select(F.col("doc_id").alias("evidence_id"), F.lit("").alias("title"), "text")
    lengths = written(evidence.text_index(u).lengths, "lengths")
    postings = written(evidence.sorted_postings(u, lengths), "postings")
    stored = evidence.TextIndex(postings, lengths, postings.groupBy("term").agg(F.count("*").alias("df")), written(evidence.stats_of(lengths), "stats"))
    return evidence.bm25_from_index(stored, QUERY).withColumnRenamed("evidence_id", "doc_id")


@query(f"WITH {_bm25('documents', 'doc_id', 'doc_id')} SELECT doc_id, text_score FROM score JOIN ({_ASSETS}) USING (doc_id) WHERE NOT tombstoned AND access_class IN ('public', 'licensed')")
def bm25_filtered(spark, t):
    """Scores of documents that may be seen; statistics are of all."""
    a = _assets(t).select(F.col("doc_id").alias("asset_id"), "modality", "access_class", "tombstoned_at")
    s = _scores(t).withColumn("asset_id", F.col("evidence_id"))
    return evidence.eligible(s, a, ["text"], ["public", "licensed"]).select(F.col("evidence_id").alias("doc_id"), "text_score")


@query(f"WITH {_bm25('documents', 'doc_id', 'doc_id')}, c AS (SELECT doc_id, source, text_score, row_number() OVER (PARTITION BY source ORDER BY text_score DESC, doc_id) AS k FROM score JOIN documents USING (doc_id)) SELECT doc_id, source, text_score, CAST(row_number() OVER (ORDER BY text_score DESC, doc_id) AS INTEGER) AS rank FROM c WHERE k <= 3 ORDER BY rank LIMIT 10")
def source_capped_topk(spark, t):
    """The best ten documents with three of a source at most."""
    s = _scores(t).join(t("documents").select(F.col("doc_id").alias("evidence_id"), "source"), "evidence_id")
    return evidence.capped(s, "text_score", "source").withColumnRenamed("evidence_id", "doc_id")


_FLAT = collapsed("text")


@query(f"SELECT doc_id, CASE WHEN s = '' THEN 'Visual evidence' ELSE substr(s, CASE WHEN instr(lower(s), 'from') > 81 THEN instr(lower(s), 'from') - 80 ELSE 1 END, 360) END AS snippet FROM (SELECT doc_id, {_FLAT} AS s FROM documents)")
def snippet(spark, t):
    return t("documents").select("doc_id", text.snippet("text", "FROM the").alias("snippet"))


def _visual(t, target=0):
    """Likeness of every vector, as an image descriptor, to one of them."""
    e = t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    bits = F.aggregate(F.transform("e", lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L"))), F.expr("0L"), lambda h, b: F.shiftleft(h, 1).bitwiseOR(b))
    grid = F.transform(F.slice("e", 1, 48), lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x + 1) * 127.5).cast("int"))))
    d = e.select("vec_id", bits.alias("h"), grid.alias("g"))
    q = F.broadcast(d.where(F.col("vec_id") == target).select(F.col("h").alias("qh"), F.col("g").alias("qg")))  # one row
    return d.crossJoin(q).select("vec_id", evidence.similarity(F.col("h"), F.col("qh"), F.col("g"), F.col("qg")).alias("visual_score"))


_VISUAL = """emb AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS h, list_transform(embedding[1:48], lambda x: least(255, greatest(0, CAST(floor((CAST(x AS DOUBLE) + 1) * 127.5) AS INTEGER)))) AS g FROM embeddings),
visual AS (SELECT d.vec_id, round(0.65e0 * (1 - len(list_filter(list_zip(d.h, q.h), lambda x: x[1] <> x[2])) / 64e0) + 0.35e0 * (1 - list_sum(list_transform(list_zip(d.g, q.g), lambda x: abs(x[1] - x[2]))) / (48e0 * 255)), 10) AS visual_score FROM emb d, emb q WHERE q.vec_id = 0)"""


@query(f"WITH {_VISUAL} SELECT vec_id, visual_score, CAST(row_number() OVER (ORDER BY visual_score DESC, vec_id) AS INTEGER) AS position FROM visual ORDER BY position LIMIT 20")
def visual_similarity_topk(spark, t):
    """The twenty descriptors most like a given one."""
    return evidence.ranked(_visual(t), "visual_score", "vec_id", most=20)


@query(f"""WITH {_bm25('documents', 'doc_id', 'doc_id')}, {_VISUAL}, a AS (SELECT doc_id AS id, text_score, row_number() OVER (ORDER BY text_score DESC, doc_id) AS p FROM score), b AS (SELECT vec_id AS id, visual_score, row_number() OVER (ORDER BY visual_score DESC, vec_id) AS p FROM visual)
SELECT id, round(coalesce(1e0 / (60 + a.p), 0) + coalesce(1e0 / (60 + b.p), 0), 10) AS fused_score, text_score, visual_score FROM a FULL JOIN b USING (id)""")
def rrf_fusion(spark, t):
    """Reciprocal ranks of a text and an image list, fused."""
    v = _visual(t).withColumnRenamed("vec_id", "evidence_id")
    return evidence.fuse(evidence.ranked(_scores(t), "text_score"), evidence.ranked(v, "visual_score")).withColumnRenamed("evidence_id", "id")


_UNIT_WORDS = _WORDS


@query(_CHUNKS + f""", {_bm25('unit', 'evidence_id', 'evidence_id')}, {_VISUAL}, asset AS ({_ASSETS}), ok AS (SELECT * FROM asset WHERE NOT tombstoned AND access_class <> 'private'),
look AS (SELECT min_by(evidence_id, char_start) AS evidence_id, visual_score FROM unit JOIN visual ON vec_id = doc_id GROUP BY doc_id, visual_score),
a AS (SELECT evidence_id, text_score, row_number() OVER (ORDER BY text_score DESC, evidence_id) AS p FROM score JOIN unit USING (evidence_id) JOIN ok USING (asset_id)),
b AS (SELECT evidence_id, visual_score, row_number() OVER (ORDER BY visual_score DESC, evidence_id) AS p FROM look JOIN unit USING (evidence_id) JOIN ok USING (asset_id)),
f AS (SELECT evidence_id, round(coalesce(1e0 / (60 + a.p), 0) + coalesce(1e0 / (60 + b.p), 0), 10) AS fused_score, text_score, visual_score FROM a FULL JOIN b USING (evidence_id)),
best AS (SELECT f.*, unit.asset_id, char_start, char_stop, unit.text, content_hash, safe_source_url, access_class, sha256, row_number() OVER (PARTITION BY safe_source_url ORDER BY fused_score DESC, evidence_id) AS k FROM f JOIN unit USING (evidence_id) JOIN ok USING (asset_id))
SELECT CAST(row_number() OVER (ORDER BY fused_score DESC, evidence_id) AS INTEGER) AS rank, evidence_id, asset_id, fused_score, text_score, visual_score, concat_ws('+', CASE WHEN text_score IS NOT NULL THEN 'text' END, CASE WHEN visual_score IS NOT NULL THEN 'visual' END) AS matched_modalities, '' AS title,
  substr({_FLAT}, CASE WHEN instr(lower({_FLAT}), 'heat') > 81 THEN instr(lower({_FLAT}), 'heat') - 80 ELSE 1 END, 360) AS snippet, char_start, char_stop, safe_source_url, access_class, sha256 AS source_sha256, content_hash AS evidence_sha256
FROM best WHERE k <= 3 ORDER BY rank LIMIT 10""")
def evidence_citations(spark, t):
    """Cited search by text and image: chunks, index, filters, ranks, fusion, caps and citations."""
    a = _assets(t)
    u = written(evidence.units(a), "units")  # the index is built once, then queried
    look = _visual(t).join(u.groupBy("asset_id").agg(F.min_by("evidence_id", "char_start").alias("evidence_id")), F.concat(F.lit("asset-"), F.col("vec_id").cast("string")) == F.col("asset_id")).select("evidence_id", "visual_score")
    return evidence.citations(u, a, QUERY, look, access_classes=["public", "owned", "licensed", "unknown", "paid-personal"])


@query(_CHUNKS + f""", asset AS ({_ASSETS}), r AS (SELECT evidence_id AS k, '{{"asset_id":"' || asset_id || '","char_start":' || char_start || ',"char_stop":' || char_stop || ',"content_hash":"' || content_hash || '","evidence_id":"' || evidence_id || '","title":""}}' AS r FROM unit UNION ALL SELECT asset_id, '{{"asset_id":"' || asset_id || '","sha256":"' || sha256 || '"}}' FROM asset),
l0 AS (SELECT sha256(k) AS p, sha256(sha256(k) || chr(10) || r) AS d FROM r), l1 AS (SELECT left(p, 5) AS p, sha256(string_agg(d, chr(10) ORDER BY d)) AS d FROM l0 GROUP BY left(p, 5)), l2 AS (SELECT left(p, 2) AS p, sha256(string_agg(d, chr(10) ORDER BY d)) AS d FROM l1 GROUP BY left(p, 2)),
h AS (SELECT sha256(string_agg(d, chr(10) ORDER BY d)) AS content_hash FROM l2)
SELECT (SELECT count(*) FROM asset) AS assets, (SELECT count(*) FROM unit) AS evidence, (SELECT count(*) FROM unit) AS text_units, true AS text_query, content_hash, 'evidence-' || left(content_hash, 20) AS index_id FROM h""")
def index_manifest(spark, t):
    """Counts, content hash and id of the whole index."""
    a = _assets(t)
    return evidence.manifest(written(evidence.units(a), "units"), a)


@query("SELECT doc_id, rule FROM (SELECT doc_id, 'asset-bytes' AS rule FROM documents WHERE doc_id % 50 = 7 UNION ALL SELECT doc_id, 'content-hash' FROM documents WHERE doc_id % 50 = 9 AND doc_id % 97 <> 0 AND length(regexp_replace(text, '\\s', '', 'g')) > 0 UNION ALL SELECT doc_id, 'evidence-without-asset' FROM documents WHERE doc_id % 50 = 11 AND doc_id % 97 <> 0 AND length(regexp_replace(text, '\\s', '', 'g')) > 0)")
def verify_index(spark, t):
    """Rules that an index breaks in which some assets, hashes and references were tampered with, by document. Withdrawn assets have no units."""
    a = _assets(t)
    u = written(evidence.units(a.where("tombstoned_at is null")), "units")
    n = F.substring_index("asset_id", "-", -1).cast("long")
    bad = u.withColumn("content_hash", F.when(n % 50 == 9, F.sha2("content_hash", 256)).otherwise(F.col("content_hash")))
    kept = a.withColumn("sha256", F.when(F.col("doc_id") % 50 == 7, F.sha2("sha256", 256)).otherwise(F.col("sha256"))).where("doc_id % 50 <> 11 or tombstoned_at is not null")
    v = evidence.violations(bad, kept, a.select("asset_id", "title", "body", "sha256"))
    owner = u.select(F.col("evidence_id").alias("key"), n.alias("doc_id"))
    named = v.where(~F.col("rule").isin("evidence-missing", "evidence-not-derived"))
    by_unit = named.where("rule <> 'asset-bytes'").join(owner, "key").select("doc_id", "rule")
    return by_unit.union(named.where("rule = 'asset-bytes'").select(F.substring_index("key", "-", -1).cast("long"), "rule")).distinct()


@query(_CHUNKS + " SELECT evidence_id, CASE WHEN doc_id % 97 = 0 THEN 'evidence-not-derived' ELSE 'evidence-missing' END AS rule FROM unit WHERE (doc_id % 97 = 0) <> (doc_id % 10 = 3) AND (doc_id % 97 = 0 OR doc_id % 10 = 3)")
def verify_rederive(spark, t):
    """Units that a new derivation finds missing or too many, after those of some documents were left out and those of withdrawn assets kept."""
    a = _assets(t)
    u = evidence.units(a).where(F.substring_index("asset_id", "-", -1).cast("long") % 10 != 3)
    return evidence.violations(u, a, a.select("asset_id", "title", "body", "sha256")).select(F.col("key").alias("evidence_id"), "rule")


def _items(t):
    return t("documents").select(F.lit("web").alias("platform"), F.concat(F.lit("https://user@"), "source", F.lit(".example.com/?b=1&token=x#top")).alias("source_url"), F.concat(F.lit("Part "), F.col("doc_id") % 40).alias("title"), F.col("text").alias("body"), "doc_id")


_RECORD = f"SELECT doc_id, source, 'https://' || source || '.example.com/?b=1' AS safe_url, sha256({stripped('text')}) AS content_hash, 'part-' || doc_id % 40 AS slug, row_number() OVER (PARTITION BY source, sha256({stripped('text')}) ORDER BY doc_id) AS nth, {stripped('text')} = '' AS empty FROM documents"


@query(f"SELECT doc_id, safe_url, content_hash, CASE WHEN empty THEN 'empty' WHEN nth > 1 THEN 'duplicate' ELSE 'written' END AS outcome FROM ({_RECORD})")
def record_dedup(spark, t):
    """Outcome of writing every document as a record: a repeat of a URL and body is a duplicate."""
    return records.outcomes(records.identified(_items(t)), "doc_id").select("doc_id", "safe_url", "content_hash", "outcome")


@query(f"""WITH r AS (SELECT * FROM ({_RECORD}) WHERE NOT empty AND nth = 1), a AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY doc_id) = 1 AS one FROM r), b AS (SELECT *, row_number() OVER (PARTITION BY slug, left(content_hash, 8) ORDER BY doc_id) AS eight FROM a WHERE NOT one),
c AS (SELECT *, row_number() OVER (PARTITION BY slug, left(content_hash, 12) ORDER BY doc_id) AS twelve FROM b WHERE eight > 1)
SELECT doc_id, 'web/' || slug || '.md' AS path FROM a WHERE one UNION ALL SELECT doc_id, 'web/' || slug || '-' || left(content_hash, 8) || '.md' FROM b WHERE eight = 1
UNION ALL SELECT doc_id, 'web/' || slug || '-' || left(content_hash, CASE WHEN twelve = 1 THEN 12 ELSE 64 END) || '.md' FROM c""")
def record_paths(spark, t):
    """Paths of the written records; slugs that collide get a part of the hash."""
    done = records.outcomes(records.identified(_items(t)), "doc_id").where("outcome = 'written'")
    return records.paths(done, "doc_id").select("doc_id", "path")


_OUTCOME = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'empty' WHEN 'click' THEN 'duplicate' ELSE 'written' END"


def _attempts(t):
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "empty").when(F.col("event_type") == "click", "duplicate").otherwise("written")
    return t("events").select("event_id", "user_id", "ts", kind.alias("outcome"))


@query(f"SELECT user_id, written, duplicates, empty, failed, CASE WHEN failed = 0 THEN 'complete' WHEN written + duplicates > 0 THEN 'partial' ELSE 'failed' END AS status FROM (SELECT user_id, count(*) FILTER (WHERE o = 'written') AS written, count(*) FILTER (WHERE o = 'duplicate') AS duplicates, count(*) FILTER (WHERE o = 'empty') AS empty, count(*) FILTER (WHERE o = 'failed') AS failed FROM (SELECT user_id, {_OUTCOME} AS o FROM events) GROUP BY user_id)")
def records_by_outcome(spark, t):
    return records.rollup(_attempts(t), "user_id")


@query(f"SELECT event_id, user_id, {_OUTCOME} AS outcome FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_receipt(spark, t):
    return records.latest(_attempts(t), "user_id", "ts", "event_id").drop("ts")


@query(f"SELECT event_id, user_id, {_OUTCOME} AS outcome FROM events WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_complete_receipt(spark, t):
    return records.latest(_attempts(t).where("outcome <> 'failed'"), "user_id", "ts", "event_id").drop("ts")


@query("SELECT o_orderkey AS run_id, o_custkey AS fingerprint, coalesce(bool_and(l_returnflag <> 'R'), true) AS reusable FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def resume_reusable(spark, t):
    """Receipts (orders) that may be reused: those of which no record (line) was changed (returned)."""
    runs = t("orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("fingerprint"))
    path = F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    line = t("lineitem").select(F.col("l_orderkey").alias("run_id"), path.alias("path"), "l_returnflag")
    kept = line.select("run_id", "path", F.lit("a").alias("record_hash"))
    files = line.groupBy("path").agg(F.when(F.max(F.col("l_returnflag") == "R"), "b").otherwise("a").alias("record_hash"))
    return records.reusable(runs, kept, files).select("run_id", "fingerprint", "reusable")


@query("SELECT event_id, coalesce(greatest(0e0, 3600e0 - (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6), 0e0) AS wait FROM events")
def politeness_wait(spark, t):
    """Seconds that a polite client would have waited before each event of a user."""
    return records.waits(t("events").select("event_id", "user_id", "ts"), "user_id", "ts", 3600.0, "event_id").select("event_id", "wait")


@query("""SELECT event_id, attempt, CASE WHEN failed AND NOT final AND attempt < 2 THEN CAST(least(1 << attempt, 5) AS DOUBLE) END AS wait FROM (
SELECT event_id, event_id % 4 AS attempt, (event_id % 7 = 0 OR event_id % 9 >= 4) AS failed, (event_id % 7 = 0 AND event_id % 2 = 0) OR event_id % 9 IN (4, 5) AS final FROM events)""")
def retry_decisions(spark, t):
    """How long each failed attempt waits before it is tried again, by its status or error."""
    n = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, (200, 204, 301, 304, 404, 400, 408, 429, 503))), (n % 9 + 1).cast("int"))
    error = F.when(n % 7 == 0, F.when(n % 2 == 0, "too_large").otherwise("reset"))
    e = t("events").select("event_id", (n % 4).cast("int").alias("attempt"), status.alias("status"), error.alias("error"))
    return e.select("event_id", "attempt", transport.retry_wait(F.col("attempt"), F.col("status"), F.col("error")).alias("wait"))


@query("""SELECT page_id AS request_id, CAST(hop AS INTEGER) AS hop, 'https://' || CASE WHEN moved AND hop >= 2 THEN 'b' ELSE 'a' END || '.example/h' || hop AS url, outcome, NOT (moved AND hop >= 2) AS credentials_sent FROM (
SELECT page_id, moved, CASE WHEN lost AND n > 2 THEN 1 WHEN moved AND n > 2 THEN 2 WHEN n = 7 THEN 5 ELSE n - 1 END AS hop,
  CASE WHEN lost AND n > 2 THEN 'no-location' WHEN moved AND n > 2 THEN 'address' WHEN n = 7 THEN 'too-many-redirects' WHEN page_id % 11 = 0 THEN 'declared-too-large' WHEN page_id % 13 = 0 THEN 'too-large' ELSE 'ok' END AS outcome
FROM (SELECT page_id, page_id % 7 + 1 AS n, page_id % 5 = 0 AS moved, page_id % 17 = 3 AS lost FROM pages))""")
def redirect_chains(spark, t):
    """Where chains of redirects end that may be long, lead to a private address, lose their way, or end in too much."""
    n, k = F.col("page_id") % 7 + 1, F.col("page_id")
    h = t("pages").select("page_id", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("hop"))
    name = lambda at: F.concat(F.lit("https://"), F.when((k % 5 == 0) & (at >= 2), "b").otherwise("a"), F.lit(".example/h"), at.cast("string"))
    last = F.col("hop") == F.col("n") - 1
    to = F.col("hop") + 1
    there = F.when(k % 2 == 0, name(to)).otherwise(F.when((k % 5 == 0) & (to == 2), name(to)).otherwise(F.concat(F.lit("/h"), to.cast("string"))))
    location = F.when(~last & ~((k % 17 == 3) & (F.col("hop") == 1)), there)
    h = h.select(k.alias("request_id"), F.col("hop").cast("int").alias("hop"), name(F.col("hop")).alias("url"), F.when(last, 200).otherwise(302).alias("status"), location.alias("location"), F.when(k % 11 == 0, 10**7).cast("long").alias("declared_bytes"), F.when(k % 13 == 0, 10**7).otherwise(10).cast("long").alias("body_bytes"))
    answers = spark.createDataFrame([("a.example", "8.8.4.4"), ("b.example", "8.8.8.8"), ("b.example", "192.168.0.1")], "host string, address string")
    return transport.chains(h, answers)


@query("""SELECT host, list_sort(a) AS addresses, CASE k WHEN 0 THEN 'unresolved' WHEN 2 THEN 'address' WHEN 3 THEN 'invalid-address' END AS fault FROM (SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages),
LATERAL (SELECT length(host) % 4 AS k), LATERAL (SELECT CASE k WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['8.8.8.8', '2606:4700::1'] WHEN 2 THEN ['8.8.8.8', '169.254.0.' || length(host)] ELSE ['8.8.8.8', 'no address'] END AS a)""")
def host_addresses(spark, t):
    """Which hosts may be connected to: one answer that isn't public closes a host."""
    h = t("pages").select(urls.host("url").alias("host")).distinct()
    k = F.length("host") % 4
    given = F.when(k == 1, F.array(F.lit("8.8.8.8"), F.lit("2606:4700::1"))).when(k == 2, F.array(F.lit("8.8.8.8"), F.concat(F.lit("169.254.0."), F.length("host").cast("string")))).when(k == 3, F.array(F.lit("8.8.8.8"), F.lit("no address")))
    return transport.host_faults(h, h.select("host", F.explode(given).alias("address")))


@query(f"""WITH r AS (SELECT conv_id, turn, role, {stripped("coalesce(text, '')")} AS b FROM conversations WHERE turn <= 3), g AS (SELECT conv_id, max(b) FILTER (WHERE turn = 0) AS story, string_agg('- **' || role || '**: ' || b, chr(10) ORDER BY turn) FILTER (WHERE turn > 0 AND b <> '' AND b <> '[deleted]') AS said FROM r GROUP BY conv_id)
SELECT conv_id, array_to_string(list_filter([coalesce(story, ''), coalesce('## Comments' || chr(10) || chr(10) || said, '')], lambda x: x <> ''), chr(10) || chr(10)) AS text FROM g""")
def discussion_body(spark, t):
    """Each conversation as a story with its first three comments."""
    return records.discussion(t("conversations"), "conv_id", "turn", "role", "text", 3)


POLICY = frontier.CrawlPolicy(deny_patterns=("*/the*",))
_CANON = "(SELECT page_id, u.s || '://' || lower(u.h) || coalesce(nullif(u.p, ''), '/') || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END AS url, u.s || '://' || lower(u.h) AS origin, html FROM (SELECT *, list_sort(list_filter(string_split(u.q, '&'), lambda x: x <> '' AND NOT list_contains(['ref', 'utm_source'], split_part(x, '=', 1)))) AS k FROM (SELECT *, regexp_extract(url, '^([a-z]+)://([^/?#]+)([^?#]*)\\??([^#]*)', ['s', 'h', 'p', 'q']) AS u FROM pages)))"


def _frontier_sql(robots: bool = False) -> str:
    """Entries of the bounded crawls; with robots, origins answer by the length of their name."""
    k = "length(origin) % 4"
    ask = f"WHEN {k} >= 2 THEN 'robots_unavailable' WHEN {k} = 1 AND starts_with(substr(url, length(origin) + 1), '/a') THEN 'robots_disallowed'" if robots else ""
    why = f"CASE WHEN lower(url) GLOB '*/the*' THEN 'policy_denied' {ask} END"
    return f"""p AS (SELECT *, {why} AS why FROM {_CANON} QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1),
l AS (SELECT url AS seed, origin, unnest(x[1:500]) AS link, generate_subscripts(x[1:500], 1) AS pos FROM (SELECT *, regexp_extract_all(html, '(?i)<a\\s[^>]*?href="([^"]+)"', 1) AS x FROM p WHERE why IS NULL)),
f AS (SELECT seed, origin, origin || link AS url, min(pos) AS pos FROM l WHERE origin || link <> seed GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY pos) AS nth, {why} AS why FROM f QUALIFY nth <= 999),
k AS (SELECT *, 1 + count(*) FILTER (WHERE why IS NULL) OVER (PARTITION BY seed ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS taken FROM n),
entry AS (SELECT url AS seed, url AS canonical_url, 0 AS depth, CASE WHEN why IS NULL THEN 'done' ELSE 'skipped' END AS status, CAST(NULL AS VARCHAR) AS parent_url, why AS skip_reason, 0 AS seq FROM p
UNION ALL SELECT seed, url, 1, CASE WHEN why IS NOT NULL THEN 'skipped' WHEN taken >= 25 THEN 'queued' WHEN url IN (SELECT url FROM p) THEN 'done' ELSE 'failed' END, seed, why, nth FROM k)"""


_FRONTIER = _frontier_sql()


def _entries(t, robots=None):
    pages = t("pages").select(urls.canonicalize("url").alias("url"), "page_id", text.page_links("html").alias("links"))
    pages = written(pages.groupBy("url").agg(F.min_by("links", "page_id").alias("links")), "sites")
    return frontier.frontier(pages.select(F.col("url").alias("seed")), pages, POLICY, robots)


@query(f"WITH {_frontier_sql(True)} SELECT * FROM entry")
def frontier_robots(spark, t):
    """The same crawls where origins were asked for their rules: some have none, some close paths, some fail or didn't answer."""
    o = t("pages").select(urls.origin("url").alias("origin")).distinct()
    k = F.length("origin") % 4
    rules = "User-agent: another\nDisallow: /\n\nUser-agent: *\nDisallow: /a # not those\nAllow: /"
    robots = o.where(k < 3).select("origin", F.when(k == 0, 404).when(k == 1, 200).otherwise(503).alias("status"), F.when(k == 1, rules).alias("body"))
    return _entries(t, robots).withColumn("seq", F.col("seq").cast("long"))


@query(f"WITH {_FRONTIER} SELECT * FROM entry")
def frontier_bfs(spark, t):
    """The frontier of a bounded crawl from every page at once."""
    return _entries(t).withColumn("seq", F.col("seq").cast("long"))


@query(f"WITH {_FRONTIER}, e AS (SELECT *, CASE WHEN status IN ('done', 'failed') THEN ['queued', 'in_progress', status] ELSE [status] END AS s FROM entry) SELECT seed, canonical_url, seq * 3 + i AS event_index, st AS status FROM (SELECT seed, canonical_url, seq, unnest(s) AS st, generate_subscripts(s, 1) - 1 AS i FROM e)")
def frontier_events(spark, t):
    """The event ledger of those crawls."""
    return frontier.events(_entries(t))


@query(f"WITH {_FRONTIER} SELECT status, count(*) AS n FROM entry GROUP BY status")
def frontier_status_rollup(spark, t):
    """How many URLs ended in each state, from the ledger alone."""
    return frontier.latest_status(frontier.events(_entries(t))).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH {_FRONTIER}, r AS (SELECT seed, left(sha256(seed), 16) AS run_id, count(*) FILTER (WHERE status = 'failed') AS failed, bool_or(status = 'queued') AS pending, length(seed) % 4 AS k FROM entry GROUP BY seed)
SELECT run_id, unnest(list_filter([CASE WHEN k = 1 AND failed > 0 THEN 'status' END, CASE WHEN k = 2 THEN 'count-written' END, CASE WHEN k = 3 AND pending THEN 'exhausted-but-pending' END], lambda x: x IS NOT NULL)) AS rule FROM r""")
def verify_site_receipts(spark, t):
    """Rules that receipts of the crawls break after some were changed: by a status, a count, or a flag."""
    e = written(_entries(t), "entries").withColumn("run_id", F.substring(F.sha2("seed", 256), 1, 16))
    fetched = e.where("status in ('done', 'failed')")
    digest = F.when(F.col("status") == "done", F.sha2("canonical_url", 256))
    pages = fetched.select("run_id", F.col("canonical_url").alias("url"), "depth", F.when(F.col("status") == "done", "written").otherwise("failed").alias("outcome"), F.concat(F.lit("web/"), digest, F.lit(".md")).alias("path"), digest.alias("record_hash"))
    ledger = frontier.events(e.drop("run_id")).withColumn("run_id", F.substring(F.sha2("seed", 256), 1, 16)).join(growing(e.select("run_id", "canonical_url", "skip_reason")), ["run_id", "canonical_url"])
    k = F.length("seed") % 4
    n = lambda s: F.count_if(F.col("status") == s)
    runs = e.groupBy("run_id", "seed").agg(n("done").alias("done"), n("failed").alias("failed"), n("queued").alias("waiting"))
    runs = runs.select(
        "run_id", "seed", F.lit("2026-01-01T00:00:00Z").alias("created_at"), F.when((F.col("failed") == 0) | (k == 1), "complete").otherwise("partial").alias("status"), (F.col("done") + F.when(k == 2, 1).otherwise(0)).alias("written"), F.lit(0).alias("duplicates"), F.lit(0).alias("empty"), "failed",
        F.col("done").alias("fetched_pages"), F.lit(0).alias("total_bytes"), ((F.col("waiting") == 0) | (k == 3)).alias("frontier_exhausted"), ((F.col("waiting") > 0) & (k != 3)).alias("page_limit_reached"),
    )
    return receipts.site_faults(runs, pages, ledger, pages.select("path", "record_hash").where("path is not null").distinct())


@query("""WITH RECURSIVE p AS (SELECT page_id % 10 AS site, page_id, octet_length(encode(html)) AS size, row_number() OVER (PARTITION BY page_id % 10 ORDER BY page_id) AS k FROM pages), f AS (
  SELECT site, 0 AS k, CAST(NULL AS BIGINT) AS page_id, CAST(NULL AS BIGINT) AS size, CAST(NULL AS VARCHAR) AS outcome, CAST(0 AS BIGINT) AS spent FROM p WHERE k = 1
  UNION ALL SELECT p.site, CAST(p.k AS INTEGER), p.page_id, p.size, CASE WHEN f.spent >= 100000 THEN 'exhausted' WHEN p.size <= 9000 AND p.size <= 100000 - f.spent THEN 'fetched' ELSE 'too_large' END, CASE WHEN f.spent < 100000 AND p.size <= 9000 AND p.size <= 100000 - f.spent THEN f.spent + p.size ELSE f.spent END FROM f JOIN p ON p.site = f.site AND p.k = f.k + 1)
SELECT site, page_id, size, outcome, spent FROM f WHERE k > 0""")
def crawl_byte_budget(spark, t):
    """Pages of ten sites against a byte budget that skips what doesn't fit."""
    p = t("pages").select((F.col("page_id") % 10).alias("site"), "page_id", F.octet_length("html").cast("long").alias("size"))
    return frontier.byte_budget(p, "site", "page_id", "size", 100000, 9000)


@query("SELECT doc_id, source, running, running > 200000 AS over FROM (SELECT doc_id, source, CAST(sum(octet_length(encode(text))) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS running FROM documents)")
def package_running_cap(spark, t):
    """Running bytes of each source's package, and where they go over the cap."""
    d = t("documents").select("doc_id", "source", F.octet_length("text").cast("long").alias("size"))
    return blobs.running_total(d, "doc_id", "size", 200000, "source").drop("size")


@query("SELECT doc_id, 'asset-' || sha256(sha256(text) || chr(0) || CASE WHEN doc_id % 2 = 0 THEN source || chr(0) || doc_id ELSE 'https://a.example/' || chr(0) || 'image' END) AS asset_id, '_assets/sha256/' || left(sha256(text), 2) || '/' || sha256(text) AS blob_path FROM documents")
def asset_ids(spark, t):
    even = F.col("doc_id") % 2 == 0
    d = t("documents").select("doc_id", F.sha2("text", 256).alias("h"), F.when(even, F.col("source")).alias("s"))
    return d.select("doc_id", ids.asset_id("h", F.col("s"), F.col("doc_id").cast("string"), F.lit("https://a.example/"), F.lit("image")).alias("asset_id"), ids.blob_path("h").alias("blob_path"))


@query("SELECT sha256(text) AS sha256, min(octet_length(encode(text))) AS byte_size, count(*) AS assets, '_assets/sha256/' || left(sha256(text), 2) || '/' || sha256(text) AS blob_path FROM documents GROUP BY sha256(text)")
def asset_dedup(spark, t):
    """Blobs of all documents: equal bytes are stored once."""
    return blobs.stored(t("documents").select(F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("byte_size")))


def _halves(t):
    d = t("documents").select("doc_id", "source", "lang", F.octet_length("text").cast("long").alias("size"))
    changed = d.where("doc_id % 3 <> 0").withColumn("lang", F.when(F.col("doc_id") % 7 == 0, "xx").otherwise(F.col("lang")))
    return d.where("doc_id % 3 <> 1"), changed


@query("SELECT doc_id, source, CASE WHEN doc_id % 3 = 1 AND doc_id % 7 = 0 THEN 'xx' ELSE lang END AS lang, octet_length(encode(text)) AS size, doc_id % 3 = 2 AND doc_id % 7 = 0 AND lang <> 'xx' AS conflict FROM documents")
def asset_manifest_merge(spark, t):
    """Union of two manifests that overlap, and which rows they disagree about."""
    rows, conflict = blobs.merged(*_halves(t), "doc_id")
    return rows.join(conflict.withColumn("conflict", F.lit(True)), "doc_id", "left").fillna(False, ["conflict"])


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphans_anti(spark, t):
    """Documents without a label."""
    return blobs.orphans(t("documents").select("doc_id", "source"), t("labels"), "doc_id")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'missing-left' WHEN doc_id % 3 = 0 THEN 'missing-right' ELSE 'different-lang' END AS fault FROM documents WHERE doc_id % 3 <> 2 OR doc_id % 7 = 0")
def bijection_check(spark, t):
    return blobs.bijection(*_halves(t), ["doc_id"], ["source", "lang", "size"])


@query("SELECT doc_id, lang, 'left' AS side FROM documents WHERE doc_id % 3 = 0 OR (doc_id % 3 = 2 AND doc_id % 7 = 0) UNION ALL SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'xx' ELSE lang END, 'right' FROM documents WHERE doc_id % 3 = 1 OR (doc_id % 3 = 2 AND doc_id % 7 = 0)")
def tree_diff(spark, t):
    """Rows that only one of two listings has."""
    a, b = _halves(t)
    return blobs.difference(a.select("doc_id", "lang"), b.select("doc_id", "lang"))


@query("SELECT (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS labels_beyond, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS unlabelled")
def subset_check(spark, t):
    """How many ids of either table the other lacks."""
    d, l = t("documents").select("doc_id"), t("labels").select("doc_id")
    return l.join(d, "doc_id", "left_anti").agg(F.count("*").alias("labels_beyond")).crossJoin(d.exceptAll(d.join(l, "doc_id", "left_semi")).agg(F.count("*").alias("unlabelled")))


@query("SELECT source AS package_id, 'item-' || doc_id % 200 AS item_id, fault FROM (SELECT source, doc_id, unnest(list_filter([CASE WHEN count(*) OVER (PARTITION BY source, doc_id % 200) > 1 THEN 'item-id-repeats' END, CASE WHEN doc_id % 31 = 0 THEN 'unsafe-path' END, CASE WHEN doc_id % 29 = 0 THEN 'transcript-missing' END], lambda x: x IS NOT NULL)) AS fault FROM documents)")
def package_faults(spark, t):
    """What is wrong with packages whose ids repeat, whose paths lead out, and whose transcripts are missing."""
    n = F.col("doc_id").cast("string")
    path = F.when(F.col("doc_id") % 31 == 0, F.concat(F.lit("../"), n)).otherwise(F.concat(F.lit("files/"), n))
    d = t("documents").select(F.col("source").alias("package_id"), F.concat(F.lit("item-"), (F.col("doc_id") % 200).cast("string")).alias("item_id"), path.alias("path"), F.when(F.col("doc_id") % 29 == 0, F.lit("files/none")).alias("transcript_path"))
    return blobs.package_faults(d)


@query("""WITH d AS (SELECT o_orderkey, ['public', 'owned', 'licensed', 'private'][o_orderkey % 4 + 1] AS a, ['public', 'owned', 'licensed'][o_orderkey % 3 + 1] AS s, o_orderkey % 5 AS b, o_orderkey % 11 = 0 AS nouse, o_orderkey % 13 = 0 AS notes, o_orderkey % 2 = 0 AS lo FROM orders),
v AS (SELECT o_orderkey, list_filter([CASE WHEN a <> s THEN 'status-matches-class' END, CASE WHEN nouse THEN 'uses-present' END, CASE WHEN notes THEN 'notes-safe' END, CASE WHEN b = 2 THEN 'approval-required' END, CASE WHEN b = 3 THEN 'owner-required' END, CASE WHEN b = 0 AND a <> 'public' THEN 'public-basis' END, CASE WHEN b = 4 AND s <> 'licensed' THEN 'licensed-basis' END, CASE WHEN a = 'private' AND NOT lo THEN 'local-only' END], lambda x: x IS NOT NULL) AS rules FROM d)
SELECT o_orderkey, rules FROM v WHERE len(rules) > 0""")
def rights_violations(spark, t):
    """Broken rules of declarations made from orders."""
    k = F.col("o_orderkey")
    of = lambda names, n: F.element_at(F.array(*(F.lit(x) for x in names)), (k % n + 1).cast("int"))
    d = t("orders").select(
        "o_orderkey", of(("public", "owned", "licensed", "private"), 4).alias("access_class"), of(("public", "owned", "licensed"), 3).alias("rights_status"), of(("public", "official-api", "operator-approved-export", "account-owned-export", "licensed-dataset"), 5).alias("basis"),
        F.when(k % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("local-research"))).alias("permitted_uses"), F.when(k % 13 == 0, "Cookie: a=1").otherwise("fine").alias("notes"), F.lit(" ").alias("approval_id"), F.lit(None).cast("string").alias("account_owner"), (k % 2 == 0).alias("local_only"),
    )
    return d.select("o_orderkey", policy.violations().alias("rules")).where(F.size("rules") > 0)


@query("""WITH r AS (SELECT *, substr(sha256(CAST(page_id AS VARCHAR)), 1, 16) AS run_id, page_id % 10 AS k FROM pages)
SELECT run_id, unnest(CASE k WHEN 1 THEN ['file-name'] WHEN 2 THEN ['requested-url'] WHEN 3 THEN ['status-code', 'request-count'] WHEN 4 THEN ['record-of-outcome'] WHEN 5 THEN ['record-hash', 'record-changed'] WHEN 6 THEN ['asset-ids', 'asset-unknown'] WHEN 7 THEN ['asset-unknown'] WHEN 8 THEN ['record-missing'] WHEN 9 THEN ['created-at', 'source-profile'] ELSE [] END) AS rule FROM r""")
def verify_browser_receipts(spark, t):
    """Rules that receipts of rendered pages break, of which nine in ten were spoilt in some way."""
    k = F.col("page_id") % 10
    run = F.substring(F.sha2(F.col("page_id").cast("string"), 256), 1, 16)
    digest = F.sha2("html", 256)
    asset = F.concat(F.lit("asset-"), digest)
    p = t("pages").select(
        run.alias("run_id"), F.concat(F.lit("20260101T000000.000000Z-"), F.when(k == 1, F.reverse(run)).otherwise(run), F.when(k == 1, ".txt").otherwise(".json")).alias("file_name"), F.when(k == 9, "2026-01-01").otherwise("2026-01-01T00:00:00Z").alias("created_at"),
        F.when(k == 4, "empty").otherwise("written").alias("outcome"), F.when(k == 2, "https://me:pw@e.example/").otherwise("https://e.example/").alias("requested_url"), F.lit("https://e.example/end").alias("final_url"), F.lit("").alias("title"), F.when(k == 3, 99).otherwise(200).alias("status_code"), F.lit("text/html").alias("content_type"),
        F.when(k == 3, 0).otherwise(4).alias("request_count"), F.octet_length("html").cast("long").alias("network_bytes"), F.when(k == 9, "http").otherwise("browser").alias("source_profile"), F.lit("page").alias("source_primitive"), F.concat(F.lit("web/"), run, F.lit(".md")).alias("record_path"), F.when(k == 5, "?").otherwise(digest).alias("record_hash"),
        F.when(k == 6, F.array(F.lit("asset-1"))).when(k == 7, F.array(F.concat(F.lit("asset-"), F.sha2(digest, 256)))).otherwise(F.array(asset)).alias("asset_ids"), k.alias("k"), digest.alias("now"), asset.alias("asset_id"),
    )
    return receipts.browser_faults(p, p.where("k <> 8").select(F.col("record_path").alias("path"), F.col("now").alias("record_hash")), p.select("asset_id"))


@query(f"""WITH {_FRONTIER}, b AS (SELECT url, octet_length(encode(html)) AS size FROM p)
SELECT seed, CASE WHEN failed = 0 THEN 'complete' WHEN written > 0 THEN 'partial' ELSE 'failed' END AS status, written, failed, coalesce(total, 0) AS total_bytes, NOT waiting AS frontier_exhausted FROM (
SELECT seed, count(*) FILTER (WHERE status = 'done') AS written, count(*) FILTER (WHERE status = 'failed') AS failed, bool_or(status = 'queued') AS waiting, CAST(sum(size) FILTER (WHERE status = 'done') AS BIGINT) AS total FROM entry LEFT JOIN b ON canonical_url = url GROUP BY seed)""")
def collect_sites(spark, t):
    """A collection run from every page: what its receipt counts."""
    fetched = t("pages").select(urls.canonicalize("url").alias("url"), "page_id", "html").groupBy("url").agg(F.min_by("html", "page_id").alias("html"))
    got = collect.collect_sites(fetched.select(F.col("url").alias("seed")), written(fetched, "fetched"), POLICY)
    return got.runs.select("seed", "status", "written", "failed", "total_bytes", "frontier_exhausted")


@query("""SELECT doc_id, unnest(CASE doc_id % 6 WHEN 0 THEN ['$.meta[0].Api-Key:secret_field'] WHEN 1 THEN ['$.meta[0].n:credential_value'] WHEN 2 THEN ['$.meta[0].n.session_id:secret_field', '$.meta[0].n.session_id:secret_assignment'] WHEN 3 THEN ['$.meta[0].n:credential_url'] WHEN 4 THEN ['$.meta[0].n:session_path'] ELSE [] END) AS finding FROM documents""")
def json_secrets(spark, t):
    """Places and kinds of secrets in nested metadata."""
    inner = ('{"Api-Key":1}', '{"n":"Bearer abcdefgh"}', '{"n":{"session_id":"token=x"}}', '{"n":"https://me:pw@inner.example/"}', '{"n":"Local Storage/x"}', '{"n":"a token of thanks"}')
    doc = F.concat(F.lit('{"id":'), F.col("doc_id").cast("string"), F.lit(',"meta":['), F.get(F.array(*map(F.lit, inner)), (F.col("doc_id") % 6).cast("int")), F.lit("]}"))
    found = t("documents").select("doc_id", F.explode(text.json_secrets(doc)).alias("f"))
    return found.select("doc_id", F.concat_ws(":", "f.place", "f.kind").alias("finding"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'no <local-path>: denied' WHEN 1 THEN 'sent token=<REDACTED>, then failed' ELSE left(repeat('x', 2000), 1000) END AS error FROM events")
def errors_redacted(spark, t):
    """Error texts as receipts may keep them: without secrets and local paths, and not long."""
    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.concat(F.lit("no /home/user"), F.col("event_id").cast("string"), F.lit("/x.txt: denied"))).when(k == 1, F.concat(F.lit("sent token: "), F.col("event_id").cast("string"), F.lit(", then failed"))).otherwise(F.repeat(F.lit("x"), F.lit(2000)))
    return t("events").select("event_id", text.error_redacted(raw).alias("error"))
