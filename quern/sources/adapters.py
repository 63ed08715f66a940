"""Source payloads as items: raw API answers, feeds, captions and pages, already fetched, become one common schema.

Each function takes a DataFrame with the payload as text and gives (platform, source_url, title, author,
date, body, extra). Parsing is Spark's own JSON and XML; nothing is fetched here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text, urls

ITEM = ("platform", "source_url", "title", "author", "date", "body", "extra")


def _s(c: Column | str) -> Column:
    return F.coalesce(text.col(c), F.lit(""))


def _item(df: DataFrame, platform: Column | str, url, title, author, date, body, keep: tuple[str, ...] = (), **extra: Column) -> DataFrame:
    kept = F.to_json(F.struct(*(v.alias(k) for k, v in extra.items()))) if extra else F.lit("{}")
    p = F.lit(platform) if isinstance(platform, str) else platform
    return df.select(p.alias("platform"), _s(url).alias("source_url"), _s(title).alias("title"), _s(author).alias("author"), _s(date).alias("date"), text.strip(_s(body)).alias("body"), kept.alias("extra"), *keep)


_STORY = "id bigint, type string, title string, by string, time bigint, url string, text string, score int, descendants int, kids array<bigint>, deleted boolean, dead boolean"


def hackernews(items: DataFrame, listing: DataFrame, limit: int = 25, max_comments: int = 5) -> DataFrame:
    """Stories of a listing (ids: array) with their first comments, from item payloads (payload).

    The listing is cut before items are looked at. Comments, deleted and dead items drop out, and kids are counted before the empty ones drop out.
    """
    x = items.select(F.from_json("payload", _STORY).alias("x")).select("x.*").dropDuplicates(["id"])
    gone = F.coalesce("deleted", F.lit(False)) | F.coalesce("dead", F.lit(False))
    top = listing.select(F.posexplode(F.slice("ids", 1, limit)).alias("place", "id"))
    story = top.join(x, "id").where(~gone & (F.coalesce("type", F.lit("story")) != "comment"))
    kid = story.select("id", F.posexplode(F.slice(F.coalesce("kids", F.array().cast("array<bigint>")), 1, max_comments)).alias("at", "kid"))
    said = kid.join(x.where(~gone).select(F.col("id").alias("kid"), "by", "text"), "kid").withColumn("b", text.html_to_text("text")).where("b <> ''")
    lines = said.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", F.concat(F.lit("- **"), _s("by"), F.lit("**: "), "b").alias("l")))).alias("c")).select("id", F.concat(F.lit("## Top comments\n\n"), F.array_join(F.transform("c", lambda c: c["l"]), "\n")).alias("comments"))
    page = F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("id").cast("string"))
    link = F.when(_s("url") != "", F.concat(F.lit("Link: "), "url"))
    all_ = story.join(lines, "id", "left")
    return _item(all_, "hackernews", page, "title", "by", text.epoch_date("time"), text.body_of(link, text.html_to_text("text"), F.col("comments")), id=F.col("id"), points=F.col("score"), comments=F.col("descendants"))


_LISTING = "data struct<children array<struct<data struct<title string, selftext string, author string, created_utc double, permalink string, url string, score int, num_comments int, stickied boolean>>>>"
_THREAD = "array<struct<data struct<children array<struct<data struct<author string, body string>>>>>>"
_IMAGE = r"(?i)\.(jpg|jpeg|png|gif|webp)$"


def reddit_target(target: Column | str) -> DataFrame | Column:
    """(subreddit, sort) of a target such as r/name/new; 'popular' and 'hot' where it says nothing."""
    t = F.regexp_replace(text.strip(target), r"^/?(r/)?|/+$", "")
    sort = F.split_part(t, F.lit("/"), F.lit(2))
    return F.struct(F.coalesce(F.nullif(F.split_part(t, F.lit("/"), F.lit(1)), F.lit("")), F.lit("popular")).alias("subreddit"), F.when(sort.isin("hot", "new", "top", "rising"), sort).otherwise("hot").alias("sort"))


def reddit(listings: DataFrame, threads: DataFrame | None = None, limit: int = 25, max_comments: int = 5) -> DataFrame:
    """Posts of listings (payload), with comments of threads (permalink, payload)."""
    d = listings.select(F.explode(F.slice(F.from_json("payload", _LISTING)["data"]["children"], 1, limit)).alias("c")).select("c.data.*").where(~F.coalesce("stickied", F.lit(False)))
    if threads is not None:
        c = F.get(F.from_json("payload", _THREAD), 1)["data"]["children"]
        own = F.filter(F.transform(F.slice(c, 1, max_comments), lambda x: x["data"]), lambda x: F.coalesce(text.strip(x["body"]), F.lit("")).isin("", "[deleted]") == F.lit(False))
        lines = F.array_join(F.transform(own, lambda x: F.concat(F.lit("- **"), F.coalesce(x["author"], F.lit("")), F.lit("**: "), text.strip(x["body"]))), "\n")
        d = d.join(threads.select("permalink", F.when(F.size(own) > 0, F.concat(F.lit("## Top comments\n\n"), lines)).alias("comments")), "permalink", "left")
    else:
        d = d.withColumn("comments", F.lit(None).cast("string"))
    link = F.when((_s("selftext") == "") & (_s("url") != "") & ~F.col("url").rlike(_IMAGE), F.concat(F.lit("Link: "), "url"))
    return _item(d, "reddit", F.concat(F.lit("https://www.reddit.com"), _s("permalink")), "title", "author", text.epoch_date(F.col("created_utc").cast("bigint")), text.body_of(text.strip(_s("selftext")), link, F.col("comments")), score=F.col("score"), comments=F.col("num_comments"))


_REPO = "full_name string, html_url string, description string, topics array<string>, owner struct<login string>, pushed_at string, stargazers_count int, language string, message string"
_RELEASES = "array<struct<name string, tag_name string, body string>>"


def github(repos: DataFrame, max_releases: int = 5) -> DataFrame:
    """Repositories of (meta, readme, releases) payloads; what wasn't found drops out."""
    d = repos.select(F.from_json("meta", _REPO).alias("m"), F.from_json("readme", "encoding string, content string").alias("r"), F.from_json("releases", _RELEASES).alias("v"))
    d = d.where("m.full_name is not null and coalesce(m.message, '') <> 'Not Found'")
    topics = F.when(F.size("m.topics") > 0, F.concat(F.lit("Topics: "), F.array_join("m.topics", ", ")))
    readme = F.decode(F.unbase64(F.regexp_replace("r.content", r"\s", "")), "UTF-8")
    notes = F.transform(F.slice("v", 1, max_releases), lambda x: F.concat(F.lit("### "), F.coalesce(F.nullif(x["name"], F.lit("")), x["tag_name"], F.lit("")), F.lit("\n\n"), F.coalesce(x["body"], F.lit(""))))
    body = text.body_of(text.strip(_s("m.description")), topics, F.when(_s(readme) != "", F.concat(F.lit("## README\n\n"), text.strip(readme))), F.when(F.size("v") > 0, F.concat(F.lit("## Releases\n\n"), F.array_join(notes, "\n\n"))))
    return _item(d, "github", "m.html_url", "m.full_name", "m.owner.login", F.substring(_s("m.pushed_at"), 1, 10), body, stars=F.col("m.stargazers_count"), language=F.col("m.language"))


_POSTS = "data struct<posts struct<edges array<struct<node struct<name string, tagline string, description string, url string, votesCount int, createdAt string, topics struct<edges array<struct<node struct<name string>>>>>>>>>"


def producthunt(payloads: DataFrame, limit: int = 20) -> DataFrame:
    """Products of GraphQL answers (payload)."""
    n = payloads.select(F.explode(F.slice(F.from_json("payload", _POSTS)["data"]["posts"]["edges"], 1, limit)).alias("e")).select("e.node.*")
    names = F.transform(F.coalesce("topics.edges", F.from_json(F.lit("[]"), "array<struct<node struct<name string>>>")), lambda t: t["node"]["name"])
    body = text.body_of(text.strip(_s("tagline")), text.html_to_text("description"), F.when(F.size(names) > 0, F.concat(F.lit("Topics: "), F.array_join(names, ", "))))
    return _item(n, "producthunt", urls.sanitize("url"), "name", F.lit(""), F.substring(_s("createdAt"), 1, 10), body, votes=F.col("votesCount"))


_ITEMS = "array<struct<title string, link string, author string, creator string, pubDate string, date string, updated string, description string, encoded string, category array<string>>>"
_TEXT = "struct<_type string, _VALUE string>"
_ENTRY = f"array<struct<title {_TEXT}, link array<struct<_href string, _rel string>>, author array<struct<name string>>, published string, updated string, summary {_TEXT}, content {_TEXT}, category array<struct<_term string>>>>"
_FEED = f"channel struct<title string, item {_ITEMS}>, item {_ITEMS}, title {_TEXT}, entry {_ENTRY}"


def rss(feeds: DataFrame, limit: int = 25) -> DataFrame:
    """Entries of RSS and Atom documents (url, payload); the platform is told by the feed's host.

    Prefixes of names don't matter. Body: content, else summary or description; author: the entry's, else the feed's title; date: published, else updated.
    An Atom entry's link is its alternate one, else its first.
    """
    d = feeds.select("url", F.from_xml("payload", _FEED, {"ignoreNamespace": "true", "mode": "PERMISSIVE"}).alias("f"))
    full = lambda *cs: F.coalesce(*(F.nullif(text.strip(c), F.lit("")) for c in cs), F.lit(""))
    none = F.lit(None).cast("string")
    items = F.transform(F.coalesce("f.channel.item", "f.item"), lambda x: F.struct(
        x["link"].alias("link"), x["title"].alias("title"), full(x["author"], x["creator"]).alias("author"), full(x["pubDate"], x["date"], x["updated"]).alias("date"), x["encoded"].alias("content"), x["description"].alias("summary"), x["category"].alias("tags")))
    # names of one text may be given without attributes, which then is the value
    entries = F.transform("f.entry", lambda x: F.struct(
        F.coalesce(F.get(F.filter(x["link"], lambda y: F.coalesce(y["_rel"], F.lit("alternate")) == "alternate"), 0)["_href"], F.get(x["link"], 0)["_href"]).alias("link"), x["title"]["_VALUE"].alias("title"), full(F.get(x["author"], 0)["name"]).alias("author"),
        full(x["published"], x["updated"]).alias("date"), x["content"]["_VALUE"].alias("content"), x["summary"]["_VALUE"].alias("summary"), F.transform(x["category"], lambda y: y["_term"]).alias("tags")))
    e = d.select("url", F.coalesce("f.channel.title", F.col("f.title._VALUE"), none).alias("feed"), F.explode(F.slice(F.coalesce(items, entries), 1, limit)).alias("e"))
    h = urls.host("url")
    platform = F.when((h == "substack.com") | h.endswith(".substack.com"), "substack").when((h == "medium.com") | h.endswith(".medium.com"), "medium").otherwise("rss")
    body = full(text.html_to_text("e.content"), text.html_to_text("e.summary"))
    author = F.coalesce(F.nullif("e.author", F.lit("")), "feed")
    return _item(e, platform, "e.link", "e.title", author, "e.date", body, feed=_s("feed"), tags=F.filter(F.coalesce("e.tags", F.array().cast("array<string>")), lambda x: x != ""))


_VIDEO = "id string, title string, channel string, upload_date string, webpage_url string, description string, duration int, view_count bigint, channel_id string"


def youtube(videos: DataFrame) -> DataFrame:
    """Videos of (info, vtt) payloads from known hosts; one without description and transcript drops out."""
    d = videos.select(F.from_json("info", _VIDEO).alias("i"), text.vtt_to_text(_s("vtt")).alias("said")).select("i.*", "said")
    url = F.coalesce(F.nullif("webpage_url", F.lit("")), F.concat(F.lit("https://www.youtube.com/watch?v="), "id"))
    d = d.withColumn("url", url).where(urls.host_allowed("url", urls.YOUTUBE_HOSTS) & F.col("id").rlike(r"^[A-Za-z0-9_-]{6,20}$"))
    date = F.regexp_replace(_s("upload_date"), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    out = _item(d, "youtube", "url", "title", "channel", date, text.body_of(text.strip(_s("description")), F.when(F.col("said") != "", F.concat(F.lit("## Transcript\n\n"), "said"))), duration=F.col("duration"), views=F.col("view_count"))
    return out.where("body <> ''")


def _meta(names: tuple[str, ...]) -> Column:
    """The content of the first meta element of one of the names."""
    tag = F.regexp_extract("html", rf"(?is)<meta\s[^>]*(?:name|property)\s*=\s*[\"']?(?:{'|'.join(names)})[\"'][^>]*>", 0)
    return text.strip(text.unescape(F.regexp_extract(tag, r"(?is)\scontent\s*=\s*\"([^\"]*)\"", 1)))


def article(pages: DataFrame, types: tuple[str, ...] = ("text/html", "application/xhtml+xml", "text/plain"), robots: DataFrame | None = None, agent: str = "quern", keep: tuple[str, ...] = ()) -> DataFrame:
    """Articles of fetched pages (url, content_type, html): title, else the URL, the prose, and author and date where the page's metadata tell them.

    ``robots`` (origin, status, body) may close pages to an agent; an origin that failed to answer is open. ``keep`` are columns to carry along.
    """
    p = pages.where(text.content_type_allowed("content_type", types))
    if robots is not None:
        from quern.operators.frontier import CrawlPolicy, robots_verdict

        p = robots_verdict(p.withColumn("canonical_url", F.col("url")), robots, CrawlPolicy(agent=agent, robots_fail_closed=False)).where("robots = 'allowed'")
    return _item(p, "web", urls.sanitize("url"), F.coalesce(F.nullif(text.page_title("html"), F.lit("")), urls.sanitize("url")), _meta(("author",)), _meta(("article:published_time", "date")), text.html_to_text("html"), keep)
