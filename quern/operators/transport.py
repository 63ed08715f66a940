"""Decisions of a protected transport, over recorded requests: which hosts may be connected to, where redirects may lead, when a request is tried again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import urls
from quern.functions.exact import address_is_global, joined_url

REDIRECTS = (301, 302, 303, 307, 308)


def host_faults(hosts: DataFrame, answers: DataFrame) -> DataFrame:
    """(host, addresses, fault): what a resolver answered (host, address) for each host, and why it may not be connected to.

    One answer that isn't public, or is no address, is enough; so is none. A host that is an address answers for itself.
    """
    h = hosts.select("host").distinct()
    literal = h.where(address_is_global("host").isNotNull()).select("host", F.col("host").alias("address"))
    own = answers.select("host", "address").distinct().join(literal.select("host"), "host", "left_anti").unionByName(literal)
    seen = own.withColumn("open", address_is_global("address")).groupBy("host").agg(
        F.array_sort(F.collect_set("address")).alias("addresses"), F.bool_or(F.col("open").isNull()).alias("odd"), F.bool_and(F.coalesce("open", F.lit(False))).alias("public")
    )
    fault = F.when(F.col("host").rlike(urls.BLOCKED_HOST), "blocked-host").when(F.col("addresses").isNull(), "unresolved").when(F.col("odd"), "invalid-address").when(~F.col("public"), "address")
    return h.join(seen, "host", "left").select("host", F.coalesce("addresses", F.array().cast("array<string>")).alias("addresses"), fault.alias("fault"))


def chains(hops: DataFrame, answers: DataFrame, max_bytes: int = 5 << 20, max_redirects: int = 5) -> DataFrame:
    """(request_id, hop, url, outcome, credentials_sent): where each recorded chain of redirects ends, and how.

    ``hops`` (request_id, hop, url, status, location, declared_bytes, body_bytes) are counted from 0. Each hop's URL and the addresses of its host are
    judged anew; a redirect needs a location, which has to be the next hop, and no more than ``max_redirects`` are followed. Bodies are bounded
    by what is declared, then by what came. Credentials stay behind once a hop is of another origin.
    """
    by = Window.partitionBy("request_id").orderBy("hop")
    host = hops.withColumn("_host", urls.host("url"))
    bad = host_faults(host.where("_host <> ''").select(F.col("_host").alias("host")), answers).select(F.col("host").alias("_of"), F.col("fault").alias("_dns"))
    h = host.join(bad, F.col("_host") == F.col("_of"), "left").withColumn("_unsafe", urls.safety_reason("url"))
    leads = F.col("status").isin(*REDIRECTS)
    h = h.withColumn("_next", F.lead("url").over(by)).withColumn("_target", joined_url("url", "location"))
    outcome = (
        F.when(F.col("_unsafe").isNotNull(), F.concat(F.lit("unsafe-url:"), "_unsafe")).when(F.col("_dns").isNotNull(), F.col("_dns")).when(leads & (F.coalesce("location", F.lit("")) == ""), "no-location")
        .when(leads & (F.col("hop") >= max_redirects), "too-many-redirects").when(leads & F.col("_next").isNull(), "not-followed").when(leads & ~F.col("_next").eqNullSafe(F.col("_target")), "broken-chain").when(leads, F.lit(None))
        .when(F.col("declared_bytes") > max_bytes, "declared-too-large").when(F.col("body_bytes") > max_bytes, "too-large").otherwise("ok")
    )
    h = h.withColumn("outcome", outcome).withColumn("_origin", urls.origin("url"))
    moved = h.withColumn("_first", F.first("_origin").over(by)).withColumn("credentials_sent", F.min(F.col("_origin").eqNullSafe(F.col("_first")).cast("int")).over(by) == 1)
    ends = moved.where("outcome is not null").groupBy("request_id").agg(F.min_by(F.struct("hop", "url", "outcome", "credentials_sent"), "hop").alias("x"))
    return ends.select("request_id", "x.*")


def retry_wait(attempt: Column, status: Column, error: Column, retries: int = 2, longest: float = 5.0) -> Column:
    """Seconds to wait before a failed request (attempts from 0) is tried again; null where it isn't.

    Unsafe and oversized answers are final, and so are the client's own errors but for a timeout (408) and too many requests (429).
    """
    final = error.isin("unsafe", "too_large") | (status.between(400, 499) & ~status.isin(408, 429))
    failed = error.isNotNull() | (status >= 400)
    return F.when(failed & ~F.coalesce(final, F.lit(False)) & (attempt < retries), F.least(F.pow(F.lit(2.0), attempt), F.lit(longest)))
