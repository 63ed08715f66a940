"""Queries of text, URL and identity functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import exact, ids, text, urls
from quern.plans.registry import collapsed, query, stripped

_UNESCAPED = "replace(replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·')"


def _unescaped(x: str) -> str:
    return f"replace({_UNESCAPED.format(x)}, '&amp;', '&')"


def _prose(x: str) -> str:
    x = f"regexp_replace({x}, '(?i)<script[\\s\\S]*?</script>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?i)<style[\\s\\S]*?</style>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?i)<(br|/p|/div|/li|/h[1-6])\\s*/?>', chr(10), 'g')"
    x = _unescaped(f"regexp_replace({x}, '<[^>]+>', ' ', 'g')")
    x = f"regexp_replace({x}, '[ \\t\\f\\r]+', ' ', 'g')"
    return stripped(f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


_TITLE = collapsed(_unescaped("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))


def _slug(x: str) -> str:
    s = f"regexp_replace(regexp_replace(lower(coalesce(nullif({x}, ''), 'item')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
    return f"coalesce(nullif(regexp_replace(left({s}, 80), '-+$', ''), ''), 'item')"


@query(f"SELECT doc_id, sha256({stripped('text')}) AS content_hash, sha256(source) AS target_identity FROM documents")
def content_hash(spark, t):
    """Digest of every stripped text."""
    return t("documents").select("doc_id", text.content_hash("text").alias("content_hash"), ids.target_identity("source").alias("target_identity"))


@query(f"SELECT page_id, {_prose('html')} AS body FROM pages")
def html_to_text(spark, t):
    """Prose of every page."""
    return t("pages").select("page_id", text.html_to_text("html").alias("body"))


@query(f"SELECT page_id, {_TITLE} AS title FROM pages")
def page_title(spark, t):
    return t("pages").select("page_id", text.page_title("html").alias("title"))


_HREFS = "regexp_extract_all(html, '(?i)<a\\s[^>]*?href=\"([^\"]+)\"', 1)"


@query(f"SELECT page_id, CAST(pos AS INTEGER) AS pos, link FROM (SELECT page_id, unnest({_HREFS}) AS link, generate_subscripts({_HREFS}, 1) - 1 AS pos FROM pages)")
def page_links(spark, t):
    """Anchors of every page in order."""
    return t("pages").select("page_id", F.posexplode(text.page_links("html")).alias("pos", "link"))


_ORIGIN = "regexp_extract(url, '^[a-z]+://[^/?#]+')"


@query(f"SELECT page_id, {_TITLE} AS title, url AS canonical, list_transform({_HREFS}, lambda x: CASE WHEN x LIKE '/%' THEN {_ORIGIN} || x ELSE x END) AS links FROM pages")
def page_parse(spark, t):
    """Title, canonical link and resolved anchors by a full parser."""
    return t("pages").select("page_id", exact.parse_html("url", "html").alias("x")).select("page_id", "x.*")


_NAMED = {"&hellip;": "…", "&eacute;": "é", "&#8212;": "—", "&#x1F600;": "😀", "&amp;lt;": "&lt;", "&Rarr;": "↠", "&notit;": "¬it;", "&nosuch;": "&nosuch;", "&amp;hellip;&nbsp;x": "&hellip;\u00a0x", "&": "&"}


@query("SELECT page_id, '<' || [" + ", ".join(f"'{v}'" for v in _NAMED.values()) + f"][page_id % {len(_NAMED)} + 1] || '>' AS decoded FROM pages")
def html_entities(spark, t):
    """Entities of every kind: usual, named, numbered, without an end, unknown, and escaped ones."""
    names = F.array(*(F.lit(k) for k in _NAMED))
    return t("pages").select("page_id", text.unescape(F.concat(F.lit("&lt;"), F.get(names, (F.col("page_id") % len(_NAMED)).cast("int")), F.lit("&gt;"))).alias("decoded"))


@query(f"SELECT 'page' AS kind, page_id AS id, {_slug(_TITLE)} AS slug FROM pages UNION ALL SELECT 'part', p_partkey, {_slug('p_name')} FROM part")
def slugify(spark, t):
    a = t("pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), text.slugify(text.page_title("html")).alias("slug"))
    return a.union(t("part").select(F.lit("part"), "p_partkey", text.slugify("p_name")))


_ASSIGNED = r"(?i)\b((?:access[_-]?|)token|api[_-]?key|(?:client[_-]?|)secret|cookie|password|session|signature)\s*[:=]\s*([^\s,;]+)"
_REDACTED = rf"regexp_replace(regexp_replace(text, '(?i)\b(Bearer|Basic)\s+[A-Za-z0-9._~+/=-]+', '\1 <REDACTED>', 'g'), '{_ASSIGNED}', '\1=<REDACTED>', 'g')"


@query(f"SELECT doc_id, {_REDACTED} AS redacted, {_REDACTED} <> text AS changed FROM documents")
def redact_text(spark, t):
    """Texts without URLs' credentials, authorization values and assigned secrets."""
    return t("documents").select("doc_id", "text", text.redact("text").alias("redacted")).select("doc_id", "redacted", (F.col("redacted") != F.col("text")).alias("changed"))


_HITS = {
    "credential_value": r"regexp_matches(text, '\b(Bearer|Basic)\s+[A-Za-z0-9._~+/=-]+|\b(AKIA[0-9A-Z]{16}|gh[opsru]_[A-Za-z0-9]{20,}|sk-[\w-]{20,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})\b')",
    "credential_header": r"regexp_matches(text, '(?i)\b(Authorization|Proxy-Authorization|Cookie|Set-Cookie)\s*:')",
    "secret_assignment": rf"regexp_matches(text, '{_ASSIGNED}')",
    "session_path": r"regexp_matches(text, '(?i)(^|[\\/])(cookies?|local storage|session storage|browser profile|login data)($|[\\/.])')",
}


@query("SELECT doc_id, kinds FROM (SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN {v} THEN '{k}' END" for k, v in _HITS.items()) + "], lambda x: x IS NOT NULL) AS kinds FROM documents) WHERE len(kinds) > 0")
def secret_scan(spark, t):
    """Kinds of secrets of the texts that show any."""
    return t("documents").select("doc_id", text.secret_kinds("text").alias("kinds")).where(F.size("kinds") > 0)


_URL_PARTS = r"^([a-z]+)://([^/?#]+)([^?#]*)\??([^#]*)"
_URL = f"SELECT page_id, url, regexp_extract(url, '{_URL_PARTS}', ['s', 'h', 'p', 'q']) AS u FROM pages"
_DROP = "'fbclid', 'gclid', 'mc_cid', 'mc_eid', 'ref', 'ref_src', 'utm_campaign', 'utm_content', 'utm_medium', 'utm_source', 'utm_term'"


def _built(params: str) -> str:
    return f"u.s || '://' || lower(u.h) || coalesce(nullif(u.p, ''), '/') || CASE WHEN len({params}) > 0 THEN '?' || array_to_string({params}, '&') ELSE '' END"


_PARAMS = "list_filter(string_split(u.q, '&'), lambda x: x <> '')"
_KEPT = f"list_sort(list_filter({_PARAMS}, lambda x: NOT list_contains([{_DROP}], lower(split_part(x, '=', 1)))))"


@query(f"SELECT page_id, {_built(_KEPT)} AS canonical FROM ({_URL})")
def url_canonicalize(spark, t):
    """The stable identity of every page's URL."""
    return t("pages").select("page_id", urls.canonicalize("url").alias("canonical"))


@query(f"SELECT page_id, {_built(_PARAMS)} AS safe_url FROM ({_URL})")
def url_sanitize(spark, t):
    return t("pages").select("page_id", urls.sanitize("url").alias("safe_url"))


@query(f"SELECT page_id, u.s || '://' || lower(u.h) AS origin FROM ({_URL})")
def url_origin(spark, t):
    return t("pages").select("page_id", urls.origin("url").alias("origin"))


_BARE = "regexp_replace(url, '[?#].*$', '')"
#: Spoilt forms of a page's URL, by page, each with why it may not be fetched and the keys that are secret.
_SPOILT = [
    ("url", None, []),
    ("'file:///etc/x'", "scheme", []),
    ("'http://localhost/x'", "blocked-host", []),
    ("replace(url, '://', '://user:pw@')", "userinfo", []),
    (f"{_BARE} || '?api_key=1&page=2'", "sensitive-query", ["api_key"]),
    ("regexp_replace(url, '^(https?://[^/]+)', '\\1:0')", "port", []),
    (f"{_BARE} || '?token=&sig=a'", "sensitive-query", ["sig"]),
    (f"{_BARE} || '?next=https%3A%2F%2Fme%3Apw%40inner.example%2F'", "sensitive-query", ["next"]),
    (f"{_BARE} || '?to=https://inner.example/?jwt=1'", "sensitive-query", ["to"]),
    (f"{_BARE} || '?api%5Fkey=x&b.token=2'", "sensitive-query", ["api_key", "b.token"]),
    (f"{_BARE} || '?u=http%3A%2F%2Fa.example%2F%3Fu%3Dhttp%253A%252F%252Fb.example%252F%253Fsecret%253Dx'", "sensitive-query", ["u"]),
    (f"{_BARE} || '?next=https%3A%2F%2Finner.example%2F%3Fpage%3D2'", None, []),
    ("'http://10.1.2.3/x'", "address", []),
    ("'http://[fe80::7]/x'", "address", []),
    ("'http://93.184.215.14/x'", None, []),
    ("'https://h.example:99999/x'", "port", []),
    ("'http://Metadata.google.internal./x'", "blocked-host", []),
    ("'not a url'", "scheme", []),
]
_WHICH = f"page_id % {len(_SPOILT)}"
_SPOILT_SQL = f"SELECT page_id, CASE {_WHICH} " + " ".join(f"WHEN {k} THEN {x}" for k, (x, _, _) in enumerate(_SPOILT)) + " END AS url FROM pages"


def _spoilt(t):
    cases = f"case {_WHICH} " + " ".join(f"when {k} then {x}" for k, (x, _, _) in enumerate(_SPOILT)).replace("'\\1:0'", "'$1:0'") + " end as url"
    return t("pages").selectExpr("page_id", cases)


@query(f"SELECT page_id, CASE {_WHICH} " + " ".join(f"WHEN {k} THEN '{why}'" for k, (_, why, _) in enumerate(_SPOILT) if why) + " END AS reason FROM pages")
def url_safety_reason(spark, t):
    """Why a spoilt URL may not be fetched."""
    return _spoilt(t).select("page_id", urls.safety_reason("url").alias("reason"))


@query(f"SELECT page_id, CASE {_WHICH} " + " ".join(f"WHEN {k} THEN {keys}" for k, (_, _, keys) in enumerate(_SPOILT) if keys) + " ELSE [] END AS keys FROM pages")
def sensitive_query_keys(spark, t):
    return _spoilt(t).select("page_id", urls.sensitive_query_keys("url").alias("keys"))


@query("SELECT page_id, lower(url) NOT GLOB '*utm_*' AND (lower(url) GLOB '*/en/*' OR lower(url) GLOB 'https://*' ) AS allowed FROM pages")
def url_glob_policy(spark, t):
    """Shell patterns: what a deny pattern matches is out, else what an allow pattern matches is in."""
    return t("pages").select("page_id", urls.policy_allows("url", ("*/EN/*", "https://*"), ("*utm_*",)).alias("allowed"))


_GATE = f"CASE WHEN {_WHICH} IN ({', '.join(str(k) for k, (_, why, keys) in enumerate(_SPOILT) if keys or why == 'userinfo')}) THEN 'credential-bearing-url' WHEN page_id % 5 = 0 THEN 'browser-session' WHEN page_id % 5 = 1 THEN 'subscriber-content' ELSE 'public-web' END"


@query(f"SELECT page_id, {_GATE} AS source_class, CASE WHEN {_GATE} = 'public-web' THEN 'allow_public' ELSE 'export_required' END AS action FROM pages")
def source_gate(spark, t):
    """Kind of every spoilt source, with markers by page."""
    markers = F.when(F.col("page_id") % 5 == 0, F.array(F.lit(" Cookie "))).when(F.col("page_id") % 5 == 1, F.array(F.lit("paid"), F.lit("x"))).otherwise(F.array(F.lit("open")))
    kind = urls.source_class("url", markers)
    return _spoilt(t).select("page_id", kind.alias("source_class")).withColumn("action", F.when(F.col("source_class") == "public-web", "allow_public").otherwise("export_required"))


_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_''-]+')"


@query(f"SELECT doc_id, len({_WORDS}) AS n, sha256(array_to_string({_WORDS}, ' ')) AS words_hash FROM documents")
def tokens(spark, t):
    """Number of words of every text, and a digest of all of them."""
    return t("documents").select("doc_id", text.words("text").alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), F.sha2(F.array_join("w", " "), 256).alias("words_hash"))


_EXTENSIONS = ["md", "pdf", "PNG", "tar.gz", "mp3"]
_EXT_SQL = "[" + ", ".join(f"'{x}'" for x in _EXTENSIONS) + "][doc_id % 5 + 1]"


@query(f"SELECT doc_id, path, CASE lower(regexp_extract(path, '[.]([a-zA-Z0-9]+)$', 1)) WHEN 'md' THEN 'text/markdown' WHEN 'pdf' THEN 'application/pdf' WHEN 'png' THEN 'image/png' WHEN 'mp3' THEN 'audio/mpeg' ELSE 'application/octet-stream' END AS mime, ['text', 'document', 'image', 'document', 'audio'][doc_id % 5 + 1] AS modality, doc_id % 5 = 0 OR doc_id % 5 = 2 AS allowed FROM (SELECT doc_id, source || '/' || doc_id || '.' || {_EXT_SQL} AS path FROM documents)")
def mime_modality(spark, t):
    """Media type and modality by extension, and whether a type list takes it."""
    names = F.array(*(F.lit(x) for x in _EXTENSIONS))
    d = t("documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.get(names, (F.col("doc_id") % 5).cast("int"))).alias("path")).withColumn("mime", text.mime_of("path"))
    return d.select("doc_id", "path", "mime", text.modality_of("mime").alias("modality"), text.content_type_allowed("mime", ("text/markdown; q=1", "image/*")).alias("allowed"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y%m%dT%H%M%S') || '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') || 'Z' AS name, true AS valid FROM events")
def timestamps(spark, t):
    """Dates of Unix times, and file-name forms of ISO times."""
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    e = t("events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), iso.alias("iso"))
    return e.select("event_id", text.epoch_date("s").alias("day"), text.timestamp_name("iso").alias("name"), text.timestamp_valid("iso").alias("valid"))


_RAW = f"list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r]'), lambda x: {stripped('x')}), lambda x: x <> '' AND NOT contains(x, '-->') AND NOT regexp_matches(x, '^(WEBVTT|NOTE|Kind:|Language:)') AND NOT regexp_matches(x, '^[0-9]+$'))"
_LINES = f"list_filter(list_transform({_RAW}, lambda x: {stripped("regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '[[][^]]*[]]', '', 'g')")}), lambda x: x <> '')"


@query(f"SELECT doc_id, array_to_string(list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]), ' ') AS spoken FROM (SELECT doc_id, {_LINES} AS l FROM documents)")
def adjacent_dedup_lines(spark, t):
    """Texts as captions: cues, notes, tags and sounds go, repeats in a row stay once."""
    return t("documents").select("doc_id", text.vtt_to_text("text").alias("spoken"))


@query("SELECT doc_id, sha256('{\"adapter\":\"files\",\"limit\":' || CAST(doc_id % 50 AS VARCHAR) || ',\"target\":\"' || source || '\"}') AS fingerprint, 'item-' || left(sha256(source || '/' || doc_id || '.txt'), 16) AS item_id FROM documents")
def fingerprints(spark, t):
    """Digests of collection specifications, and default item ids."""
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return t("documents").select("doc_id", ids.fingerprint({"target": F.col("source"), "adapter": F.lit("files"), "limit": (F.col("doc_id") % 50)}).alias("fingerprint"), ids.item_id(path).alias("item_id"))


@query(f"SELECT doc_id, regexp_matches(source, '^[a-z0-9]([a-z0-9_-]*[a-z0-9])?$') AS platform_ok, true AS path_ok, doc_id % 2 = 0 AS up_ok, true AS digest_ok, length({stripped('source')}) BETWEEN 1 AND 200 AS short_ok FROM documents")
def identifier_checks(spark, t):
    """Forms of platforms, paths, digests and short texts."""
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    up = F.when(F.col("doc_id") % 2 == 0, F.concat(path, F.lit("..x"))).otherwise(F.concat(F.lit("a/../"), path))
    return t("documents").select("doc_id", ids.platform_ok("source").alias("platform_ok"), ids.relative_path_ok(path).alias("path_ok"), ids.relative_path_ok(up).alias("up_ok"), ids.digest_ok(F.sha2("text", 256)).alias("digest_ok"), text.short_text_ok("source").alias("short_ok"))
