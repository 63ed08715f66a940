"""URL functions. The common case is generated code; only URLs with escapes or nested URLs are handed to ``exact``.

Spark computes a Python function for all rows, whatever condition stands around it, so the functions get a null for
rows that don't need them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import col

TRACKING = ("gclid", "fbclid", "mc_cid", "mc_eid", "ref", "ref_src", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content")
#: Query keys that carry a secret, once other characters than letters and digits are low lines; and providers' own.
SENSITIVE_KEY = "(?:^|[_-])(?:token|access[_-]?token|secret|client[_-]?secret|api[_-]?key|password|credential|cookie|session|jwt|auth|authorization|sig|signed|signature)(?:$|[_-])"
PROVIDER_KEY = "^(?:(?:googleaccessid|awsaccesskeyid|policy)$|x-(?:goog|amz)-)"
BLOCKED_HOST = r"^(?:localhost|metadata|metadata\.google\.internal)$|\.(?:localhost|local)$|\.metadata\.google\.internal$"


def part(url: Column | str, name: str) -> Column:
    return F.try_parse_url(col(url), F.lit(name))


def scheme(url: Column | str) -> Column:
    return F.lower(part(url, "PROTOCOL"))


def host(url: Column | str) -> Column:
    """Lower-case host name, without brackets and a final dot."""
    return F.regexp_replace(F.lower(part(url, "HOST")), r"^\[|\]$|\.$", "")


def port(url: Column | str) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(part(url, "AUTHORITY"), F.lit("")), r":(\d+)$", 1), F.lit("")).try_cast("int")


def sensitive_key(key: Column | str) -> Column:
    """Whether a query key by its name carries a secret."""
    k = F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(key))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return k.rlike(SENSITIVE_KEY) | k.rlike(PROVIDER_KEY)


def _pairs(url: Column | str) -> Column:
    """Non-empty key=value strings of the query."""
    return F.filter(F.split(F.coalesce(part(url, "QUERY"), F.lit("")), "&"), lambda x: x != "")


def _key(pair: Column) -> Column:
    return F.split_part(pair, F.lit("="), F.lit(1))


def _quick_keys(url: Column | str) -> Column:
    hits = F.filter(_pairs(url), lambda x: x.rlike("=.") & sensitive_key(_key(x)))
    return F.array_sort(F.array_distinct(F.transform(hits, _key)))


def sensitive_query_keys(url: Column | str) -> Column:
    """Distinct keys with a value that are secret by name, or hold a URL with a secret in it, in order."""
    from quern.functions.exact import secret_params_exact

    return F.when(plain(url), _quick_keys(url)).otherwise(secret_params_exact(F.when(~plain(url), col(url))))


def has_userinfo(url: Column | str) -> Column:
    from quern.functions.exact import user_exact

    return F.when(plain(url), F.coalesce(part(url, "USERINFO"), F.lit("")) != "").otherwise(user_exact(F.when(~plain(url), col(url))))


def _with_value(pair: Column) -> Column:
    return F.when(pair.contains("="), pair).otherwise(F.concat(pair, F.lit("=")))


def _join(scheme_: Column, host_: Column, port_: Column, path: Column, query: Column) -> Column:
    shown = F.when(host_.contains(":"), F.concat(F.lit("["), host_, F.lit("]"))).otherwise(host_)
    return F.concat(
        scheme_, F.lit("://"), shown, F.when(port_ > 0, F.concat(F.lit(":"), port_.cast("string"))).otherwise(""), F.coalesce(F.nullif(path, F.lit("")), F.lit("/")),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )


def plain(url: Column | str) -> Column:
    """Whether a URL has none of what only the exact forms handle: escapes, plus signs, other non-ASCII queries, nested URLs."""
    q = F.coalesce(part(url, "QUERY"), F.lit(""))
    return F.coalesce(part(url, "HOST").isNotNull() & ~q.rlike(r"[%+;]|://|[^\x21-\x7e]|[\"'<>\[\]{}|\\^`~*()!@:,/?$]"), F.lit(False))


def sanitize(url: Column | str) -> Column:
    """A URL that may be stored: no user, fragment or secret-bearing parameter; order and blanks of the others stay.

    ``<redacted-url>`` where the URL can't be read.
    """
    from quern.functions.exact import sanitize_url

    kept = F.array_join(F.transform(F.filter(_pairs(url), lambda x: ~sensitive_key(_key(x))), _with_value), "&")
    quick = _join(scheme(url), F.lower(part(url, "HOST")), port(url), part(url, "PATH"), kept)
    return F.when(plain(url), quick).otherwise(sanitize_url(F.when(~plain(url), col(url))))


def _quick_identity(url: Column | str, tracking: tuple[str, ...]) -> Column:
    drop = [t.lower() for t in tracking]
    kept = F.filter(F.transform(_pairs(url), _with_value), lambda x: ~F.lower(_key(x)).isin(drop) & ~sensitive_key(_key(x)))
    by = F.array_sort(F.transform(kept, lambda x: F.struct(_key(x).alias("k"), F.substring_index(x, "=", -1).alias("v"), x.alias("x"))))
    query = F.array_join(F.transform(by, lambda s: s["x"]), "&")
    s, p = scheme(url), port(url)
    p = F.when(((s == "http") & (p == 80)) | ((s == "https") & (p == 443)), F.lit(None)).otherwise(p)
    return F.when(_quick_reason(url).isNull(), _join(s, host(url), p, part(url, "PATH"), query))


def canonicalize(url: Column | str, tracking: tuple[str, ...] = TRACKING) -> Column:
    """The stable identity of a safe URL: sorted query without tracking and secrets, no default port, no fragment; null for an unsafe one."""
    from quern.functions.exact import canonical_url

    easy = _easy(url)
    return F.when(easy, _quick_identity(url, tracking)).otherwise(canonical_url(tuple(tracking))(F.when(~easy, col(url))))


def origin(url: Column | str) -> Column:
    """scheme://host, and the port where it isn't the scheme's own."""
    s, h, p = scheme(url), F.lower(part(url, "HOST")), port(url)
    own = p.isNull() | ((s == "http") & (p == 80)) | ((s == "https") & (p == 443))
    return F.concat(s, F.lit("://"), h, F.when(own, "").otherwise(F.concat(F.lit(":"), p.cast("string"))))


def _easy(url: Column | str) -> Column:
    """``plain``, and the host is a name rather than an address."""
    return plain(url) & ~F.coalesce(host(url).contains(":") | host(url).rlike(r"^[0-9.]+$"), F.lit(True))


def _quick_reason(url: Column | str) -> Column:
    h, p, s = host(url), port(url), scheme(url)
    return (
        F.when(s.isNull() | ~s.isin("http", "https"), "scheme")
        .when(F.coalesce(h, F.lit("")) == "", "host")
        .when((p <= 0) | (p > 65535), "port")
        .when(h.rlike(BLOCKED_HOST), "blocked-host")
        .when(F.coalesce(part(url, "USERINFO"), F.lit("")) != "", "userinfo")
        .when(F.size(_quick_keys(url)) > 0, "sensitive-query")
    )


def safety_reason(url: Column | str) -> Column:
    """Why a URL may not be fetched; null where it may. Escapes, nested URLs and addresses are judged by ``exact``."""
    from quern.functions.exact import safety_reason_exact

    easy = _easy(url)
    return F.when(col(url).isNull(), "scheme").when(easy, _quick_reason(url)).otherwise(safety_reason_exact(F.when(~easy, col(url))))


def resolved(df: DataFrame, base: str, link: str, name: str, tracking: tuple[str, ...] = TRACKING) -> DataFrame:
    """``df`` with the canonical form of a link on a page as column ``name``; null where it is unsafe.

    Whole links and paths from the root are joined in generated code, others (relative ones, with dots, escapes) in Python. What is
    used often is a column of its own, or the plan would hold it as often.
    """
    from quern.functions.exact import resolve_canonical

    rooted = F.col(link).rlike(r"^/(?:[^/]|$)") & ~F.col(link).rlike(r"/\.{1,2}(?:[/?#]|$)") & plain(base)
    d = df.withColumn("_whole", F.when(rooted, F.concat(origin(base), F.col(link))).when(F.col(link).rlike("(?i)^https?://[^/]"), F.col(link)))
    d = d.withColumn("_easy", _easy("_whole")).withColumn("_quick", F.when(F.col("_easy"), _quick_identity("_whole", tracking)))
    hard = ~F.col("_easy")
    d = d.withColumn("_slow", resolve_canonical(tuple(tracking))(F.when(hard, F.col(base)), F.when(hard, F.col(link))))
    return d.withColumn(name, F.when(hard, F.col("_slow")).otherwise(F.col("_quick"))).drop("_whole", "_easy", "_quick", "_slow")


def glob_regex(pattern: str) -> str:
    """The regular expression of a shell pattern, for whole lower-case strings."""
    import fnmatch

    return "^" + fnmatch.translate(pattern.lower()).replace("(?s:", "(?:", 1).removesuffix(r"\z").removesuffix(r"\Z") + "$"


def matches_any(url: Column | str, patterns: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.lower(col(url)).rlike("(?s)" + glob_regex(p))
    return hit


def policy_allows(url: Column | str, allow: tuple[str, ...] = (), deny: tuple[str, ...] = ()) -> Column:
    """A pattern of ``deny`` wins; an empty ``allow`` allows all others."""
    return ~matches_any(url, deny) & (matches_any(url, allow) if allow else F.lit(True))


def _under(h: Column, *apexes: str) -> Column:
    hit = F.lit(False)
    for a in apexes:
        hit = hit | (h == a) | h.endswith("." + a)
    return hit


def source_class(url: Column | str, markers: Column) -> Column:
    """What kind of source a URL is, by credentials, markers and host, in that order."""
    m = F.transform(markers, lambda x: F.lower(F.trim(x)))
    has = lambda *names: F.arrays_overlap(m, F.array(*(F.lit(n) for n in names)))
    h = host(url)
    return (
        F.when(has_userinfo(url) | (F.size(sensitive_query_keys(url)) > 0), "credential-bearing-url")
        .when(has("cookie", "session", "login", "persistent-session"), "browser-session")
        .when(_under(h, "x.com", "twitter.com"), "account-platform")
        .when(_under(h, "pinterest.com", "pin.it"), "visual-board")
        .when(has("paid", "member-only", "subscriber-only", "paywall"), "subscriber-content")
        .otherwise("public-web")
    )


def request_id(url: Column | str, kind: Column) -> Column:
    """Id of the request that an operator has to fill; null for public sources."""
    digest = F.sha2(F.concat(sanitize(url), kind), 256)
    return F.when(kind != "public-web", F.concat(F.lit("source-request-"), F.substring(digest, 1, 12)))


YOUTUBE_HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com", "youtu.be", "www.youtu.be")


def host_allowed(url: Column | str, hosts: tuple[str, ...]) -> Column:
    return F.coalesce(host(url).isin(*hosts), F.lit(False))
