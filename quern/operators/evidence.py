"""Evidence: units from documents, a BM25 index as normalised tables, visual likeness, rank fusion, citations.

The index is three tables, postings (unit, term, count), lengths, and term frequencies over
units, rather than a map for each unit, so that a query reads only the postings of its
terms and ranks with joins and partial aggregation.
"""

from __future__ import annotations

import json
import operator
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import ids, text
from quern.operators.shared import growing, ranged, small_batches, written

K1, B, RRF = 1.2, 0.75, 60


def units(assets: DataFrame, size: int = 1600, overlap: int = 200) -> DataFrame:
    """(evidence_id, asset_id, title, char_start, char_stop, text, content_hash) of the chunks of assets (asset_id, title, body)."""
    small_batches(assets.sparkSession)  # else a worker holds 10,000 bodies and their chunks at once
    body = assets.select("asset_id", "title", text.strip("body").alias("body"))  # a column of its own, or each step of the fold would strip again
    c = body.select("asset_id", "title", F.explode(text.chunks("body", size, overlap)).alias("c"))
    c = c.select("asset_id", "title", F.col("c.start").alias("char_start"), F.col("c.stop").alias("char_stop"), F.col("c.text").alias("text")).withColumn("content_hash", F.sha2("text", 256))
    digest = ids.stable_hash(ids.json_string("asset_id"), F.col("char_start").cast("string"), F.col("char_stop").cast("string"), ids.json_string("content_hash"))
    return c.select(ids.short_id("evidence", digest).alias("evidence_id"), "asset_id", "title", "char_start", "char_stop", "text", "content_hash")


@dataclass
class TextIndex:
    """Postings (evidence_id, term, tf), lengths (evidence_id, length), terms (term, df) and one row of stats."""

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    stats: DataFrame


def _unit_words(u: DataFrame) -> DataFrame:
    return u.select("evidence_id", text.words(F.concat_ws(" ", F.coalesce("title", F.lit("")), "text")).alias("words"))


def text_index(u: DataFrame) -> TextIndex:
    """Index of units (evidence_id, title, text); the title's words count too."""
    w = _unit_words(u)
    postings = w.select("evidence_id", F.explode("words").alias("term")).groupBy("evidence_id", "term").agg(F.count("*").alias("tf"))
    lengths = w.select("evidence_id", F.size("words").cast("long").alias("length"))
    terms = postings.groupBy("term").agg(F.count("*").alias("df"))
    return TextIndex(postings, lengths, terms, stats_of(lengths))


def stats_of(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("document_count"), F.coalesce(F.round(F.sum("length") / F.count("*"), 10), F.lit(0.0)).alias("average_length"))


def _posting_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(evidence_id, words) batch by batch as (term, ids, counts): one row for each word of a batch."""
    for b in batches:
        keys, lists = b.columns
        n, coded = len(b), lists.flatten().dictionary_encode()
        row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        pair, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(n, 1) + row, return_counts=True)
        code, row = np.divmod(pair, max(n, 1))
        first = np.flatnonzero(np.diff(code, prepend=-1))
        off = pa.array(np.append(first, len(code)), pa.int32())
        yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[first])), pa.ListArray.from_arrays(off, keys.take(pa.array(row))), pa.ListArray.from_arrays(off, pa.array(tf, pa.int64()))], names=["term", "ids", "counts"])


def sorted_postings(u: DataFrame, lengths: DataFrame) -> DataFrame:
    """``text_index(u).postings`` ordered by term within partitions, each term in one of them, for a stored index.

    A unit's words are counted where the unit lies, so that only lists of units are shuffled and sorted, not postings. Where ``lengths`` show that ids
    repeat, their counts have to be added up, and postings are grouped as ever.
    """
    if not lengths.groupBy("evidence_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return text_index(u).postings.repartition("term").sortWithinPartitions("term")
    small_batches(u.sparkSession)
    w = _unit_words(u)
    schema = T.StructType().add("term", "string").add("ids", T.ArrayType(w.schema["evidence_id"].dataType)).add("counts", T.ArrayType(T.LongType()))
    blocks = w.mapInArrow(_posting_blocks, schema).repartition("term").sortWithinPartitions("term")
    rows = blocks.select("term", F.inline(F.arrays_zip("ids", "counts")).alias("evidence_id", "tf"))
    return rows.select("evidence_id", "term", "tf")


def query_terms(query: str) -> list[str]:
    return [t.lower() for t in re.findall(r"[\w'-]+", query)]


def bm25(u: DataFrame, query: str) -> DataFrame:
    """(evidence_id, text_score) of units that hold a word of the query.

    Frequencies and the average length are of all units given; filter the result, not the
    units. A repeated word of the query counts again. Units are read once: each word of the query is counted by a filter
    over the unit's words, the counts are written, and statistics are one row, so that nothing is shuffled.
    """
    terms = query_terms(query)
    distinct = sorted(set(terms))
    w = u.select("evidence_id", text.words(F.concat_ws(" ", F.coalesce("title", F.lit("")), "text")).alias("w"))
    counted = w.select("evidence_id", F.size("w").alias("length"), *(F.size(F.filter("w", partial(operator.eq, F.lit(t)))).alias(f"tf{k}") for k, t in enumerate(distinct)))
    counted = written(counted, "counted")
    stats = counted.agg(F.count("*").alias("n"), F.round(F.sum("length") / F.count("*"), 10).alias("average"), *(F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(distinct))))
    rows = counted.where(" or ".join(f"tf{k} > 0" for k in range(len(distinct))) or "false").crossJoin(F.broadcast(stats))  # one row
    average = F.when(F.col("average") == 0, 1.0).otherwise(F.col("average"))
    score = F.lit(0.0)
    for t in terms:
        k = distinct.index(t)
        tf, df = F.col(f"tf{k}"), F.col(f"df{k}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / average))).otherwise(0.0)
    return rows.select("evidence_id", F.round(score, 10).alias("text_score")).where("text_score <> 0")


def bm25_from_index(index: TextIndex, query: str) -> DataFrame:
    """``bm25`` over index tables: only the postings of the query's terms are read."""
    terms = query_terms(query)
    times = F.lit(0)
    for t in sorted(set(terms)):
        times = F.when(F.col("term") == t, terms.count(t)).otherwise(times)
    hit = index.postings.where(F.col("term").isin(*sorted(set(terms)))).withColumn("times", times)
    df = hit.groupBy("term").agg(F.count("*").alias("df"))  # as many rows as the query has words
    rows = hit.join(F.broadcast(df), "term").join(growing(index.lengths), "evidence_id").crossJoin(F.broadcast(index.stats))
    average = F.when(F.col("average_length") == 0, 1.0).otherwise(F.col("average_length"))
    idf = F.log(1 + (F.col("document_count") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("times") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / average))
    return rows.groupBy("evidence_id").agg(F.round(F.sum(part), 10).alias("text_score")).where("text_score <> 0")


def eligible(u: DataFrame, assets: DataFrame, modalities: list[str] | None = None, access_classes: list[str] | None = None) -> DataFrame:
    """Units of assets that aren't withdrawn and are of the wanted modalities and access classes; None wants all."""
    a = assets.where("tombstoned_at is null")
    if modalities is not None:
        a = a.where(F.col("modality").isin(modalities))
    if access_classes is not None:
        a = a.where(F.col("access_class").isin(access_classes))
    return u.join(a.select("asset_id"), "asset_id", "left_semi")


def similarity(dhash_a: Column, dhash_b: Column, grid_a: Column, grid_b: Column) -> Column:
    """Likeness of two image descriptors: 65 % by equal bits of the gradient hash, 35 % by nearness of the colour grids."""
    ham = F.bit_count(dhash_a.bitwiseXOR(dhash_b))
    far = F.aggregate(F.zip_with(grid_a, grid_b, lambda x, y: F.abs(x - y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.round(0.65 * (1 - ham / 64) + 0.35 * (1 - far / (48 * 255)), 10)


def hash_bits(hex_hash: Column) -> Column:
    """A gradient hash of 16 hex digits as a signed number."""
    return F.conv(hex_hash, 16, -10).cast("long")


def ranked(scores: DataFrame, score: str, key: str = "evidence_id", most: int | None = None) -> DataFrame:
    """Rank by descending score, equals by key: of the ``most`` best rows, or of all.

    All rows are ranked in ranges of the order, and a range begins after the rows of those before it.
    """
    if most is not None:
        return scores.orderBy(F.desc(score), key).limit(most).withColumn("position", F.row_number().over(Window.orderBy(F.desc(score), key)))
    r = ranged(scores, F.desc(score), F.col(key))
    parts = r.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    parts = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(F.desc(score), key))
    return r.withColumn("_own", own).join(parts, "_part").select(*scores.columns, (F.col("_base") + F.col("_own")).alias("position"))


def fuse(text_rank: DataFrame, visual_rank: DataFrame) -> DataFrame:
    """(evidence_id, fused_score, text_score, visual_score): reciprocal ranks of either list, added."""
    t = text_rank.select("evidence_id", (1 / (RRF + F.col("position"))).alias("one"), "text_score", F.lit(None).cast("double").alias("visual_score"))
    v = visual_rank.select("evidence_id", (1 / (RRF + F.col("position"))).alias("one"), F.lit(None).cast("double").alias("text_score"), "visual_score")
    return t.unionByName(v).groupBy("evidence_id").agg(F.round(F.sum("one"), 10).alias("fused_score"), F.max("text_score").alias("text_score"), F.max("visual_score").alias("visual_score"))


def capped(rows: DataFrame, score: str, source: str, per_source: int = 3, limit: int = 10, key: str = "evidence_id") -> DataFrame:
    """The best ``limit`` rows with ``per_source`` of a source at most, and their rank."""
    own = rows.withColumn("_of_source", F.row_number().over(Window.partitionBy(source).orderBy(F.desc(score), key))).where(F.col("_of_source") <= per_source).drop("_of_source")
    top = own.orderBy(F.desc(score), key).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))  # of ``limit`` rows


def citations(u: DataFrame, assets: DataFrame, query: str | None = None, visual_scores: DataFrame | None = None, limit: int = 10, per_source: int = 3, modalities: list[str] | None = None, access_classes: list[str] | None = None) -> DataFrame:
    """Cited results of a text query, an image's scores (evidence_id, visual_score), or both.

    Filters apply before ranking, but term statistics are of all units. Each list is ranked, ranks are
    fused, each source keeps ``per_source``, and the best ``limit`` are joined with what a
    citation tells. Only these rows are joined with texts.
    """
    if not (query and query.strip()) and visual_scores is None:
        raise ValueError("a query needs text or image scores")
    if limit <= 0 or per_source <= 0:
        raise ValueError("limit and per_source must be positive")
    allowed = eligible(u.select("evidence_id", "asset_id"), assets, modalities, access_classes)
    spark = u.sparkSession
    none = lambda c: spark.createDataFrame([], f"evidence_id string, {c} double, position int")
    t = ranked(bm25(u, query).join(allowed, "evidence_id", "left_semi"), "text_score") if query and query.strip() else none("text_score")
    v = ranked(visual_scores.join(allowed, "evidence_id", "left_semi"), "visual_score") if visual_scores is not None else none("visual_score")
    source = assets.select("asset_id", F.coalesce("safe_source_url", "source_id").alias("source"))
    found = fuse(t, v).join(allowed, "evidence_id").join(source, "asset_id")
    best = F.broadcast(capped(found, "fused_score", "source", per_source, limit))  # ``limit`` rows
    whole = u.join(best.drop("asset_id", "source"), "evidence_id").join(assets.drop("title", "body"), "asset_id")
    matched = F.filter(F.array(F.when(F.col("text_score").isNotNull(), F.lit("text")), F.when(F.col("visual_score").isNotNull(), F.lit("visual"))), lambda x: x.isNotNull())
    return whole.select(
        "rank", "evidence_id", "asset_id", "fused_score", "text_score", "visual_score", F.concat_ws("+", matched).alias("matched_modalities"), "title", text.snippet("text", query or "").alias("snippet"), "char_start", "char_stop",
        "safe_source_url", "access_class", F.col("sha256").alias("source_sha256"), F.col("content_hash").alias("evidence_sha256"),
    )


#: Hexadecimal digits by which digests are gathered, from the leaves of the content tree to its root.
TREE = (5, 2, 0)


def content_tree(rows: DataFrame) -> DataFrame:
    """One row, ``content_hash``: the root of a tree of digests over rows (key, row).

    A row's digest is of its key's digest and its text. Digests that begin alike are joined in order, line by line, and hashed, by
    fewer digits at each level; so no task sees more than a small part of the rows.
    """
    level = rows.select(F.sha2("key", 256).alias("at"), F.sha2(F.concat_ws("\n", F.sha2("key", 256), "row"), 256).alias("digest"))
    for digits in TREE:
        level = level.groupBy(F.substring("at", 1, digits).alias("at")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), "\n"), 256).alias("digest"))
    return level.select(F.col("digest").alias("content_hash"))


def manifest(u: DataFrame, assets: DataFrame) -> DataFrame:
    """One row of counts, capabilities, the content hash and the index id."""
    rows = u.select(F.col("evidence_id").alias("key"), F.to_json(F.struct("asset_id", "char_start", "char_stop", "content_hash", "evidence_id", "title")).alias("row"))
    rows = rows.union(assets.select(F.col("asset_id").alias("key"), F.to_json(F.struct("asset_id", "sha256")).alias("row")))
    counts = u.agg(F.count("*").alias("evidence"), F.count_if(text.strip("text") != "").alias("text_units"), F.coalesce(F.bool_or(text.strip("text") != ""), F.lit(False)).alias("text_query"))
    digest = content_tree(rows)
    empty = F.sha2(F.lit(""), 256)
    whole = counts.crossJoin(assets.agg(F.count("*").alias("assets"))).join(digest, F.lit(True), "left").withColumn("content_hash", F.coalesce("content_hash", empty))  # single rows
    return whole.select("assets", "evidence", "text_units", "text_query", "content_hash", ids.short_id("evidence", F.col("content_hash")).alias("index_id"))


def violations(u: DataFrame, assets: DataFrame, bodies: DataFrame, size: int = 1600, overlap: int = 200) -> DataFrame:
    """(rule, key): what is wrong with stored units and assets, held against ``bodies`` (asset_id, title, body, sha256 of the bytes).

    Stored digests are never trusted: assets are held against their bytes, units against
    a new derivation from the bodies.
    """
    names = ["evidence_id", "asset_id", "char_start", "char_stop", "content_hash"]
    u = written(u.select(*names, (F.sha2("text", 256) != F.col("content_hash")).alias("_forged")), "held")  # read by five rules, and may be derived itself
    out = [
        u.groupBy("evidence_id").count().where("count > 1").select(F.lit("evidence-id-repeats").alias("rule"), F.col("evidence_id").alias("key")),
        assets.groupBy("asset_id").count().where("count > 1").select(F.lit("asset-id-repeats"), "asset_id"),
        u.join(assets.select("asset_id"), "asset_id", "left_anti").select(F.lit("evidence-without-asset"), "evidence_id"),
        u.where("_forged").select(F.lit("content-hash"), "evidence_id"),
    ]
    real = bodies.select("asset_id", F.col("sha256").alias("real"))
    out.append(assets.join(real, "asset_id", "left").where(~F.col("sha256").eqNullSafe(F.col("real"))).select(F.lit("asset-bytes"), "asset_id"))
    anew = units(bodies.join(assets.where("tombstoned_at is null").select("asset_id"), "asset_id", "left_semi"), size, overlap).select(names)
    anew = written(anew, "derived")
    out.append(anew.exceptAll(u.select(names)).select(F.lit("evidence-missing"), "evidence_id"))
    out.append(u.select(names).exceptAll(anew).select(F.lit("evidence-not-derived"), "evidence_id"))
    first = out[0]
    for o in out[1:]:
        first = first.union(o)
    return first


_TABLES = ("postings", "lengths", "terms", "stats")


def index_faults(u: DataFrame, assets: DataFrame, index: TextIndex, stored: DataFrame) -> DataFrame:
    """(rule): what a stored index breaks, held against its own records: content-hash, index-id, counts, and each table of the text index that isn't the records'.

    Tables are compared by counts and digests of their rows, so that only single rows meet.
    """
    anew = manifest(u, assets).select(*(F.col(c).alias(f"new_{c}") for c in ("assets", "evidence", "text_units", "content_hash", "index_id")))
    both = stored.crossJoin(anew)  # single rows
    checks = [("content-hash", F.col("content_hash") != F.col("new_content_hash")), ("index-id", F.col("index_id") != F.col("new_index_id")), ("counts", F.struct("assets", "evidence", "text_units") != F.struct("new_assets", "new_evidence", "new_text_units"))]
    out = both.select(F.explode(F.filter(F.array(*(F.when(bad, F.lit(n)) for n, bad in checks)), lambda x: x.isNotNull())).alias("rule"))
    rebuilt = text_index(u)
    mark = lambda df, n: df.agg(F.count("*").alias(f"n{n}"), F.coalesce(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")), F.lit(0)).alias(f"s{n}"))
    for name in _TABLES:
        pair = mark(getattr(index, name), 0).crossJoin(mark(getattr(rebuilt, name), 1))  # single rows
        out = out.union(pair.where("n0 <> n1 or s0 <> s1").select(F.lit(name)))
    return out


def _fs(spark, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def publish(u: DataFrame, assets: DataFrame, folder: str) -> str:
    """Writes an index under its own id and returns the id.

    It is written aside and renamed, so that a generation is whole or not there. One that is there already stays as it is,
    if its records still have the content that its id names; else that is an error. The pointer to the current one is replaced by a rename.
    """
    spark = u.sparkSession
    row = written(manifest(u, assets), "manifest")
    index_id = row.first()["index_id"]
    root = f"{folder}/generations/{index_id}"
    fs, at = _fs(spark, root)
    if not fs.exists(at):
        index = text_index(u)
        aside = f"{folder}/staging/{uuid.uuid4().hex}"
        for name, df in (("assets", assets), ("evidence", u), ("postings", sorted_postings(u, index.lengths)), ("lengths", index.lengths), ("terms", index.terms), ("stats", index.stats), ("manifest", row)):
            df.write.parquet(f"{aside}/{name}")
        fs.mkdirs(at.getParent())
        _, source = _fs(spark, aside)
        if fs.exists(at) or not fs.rename(source, at):  # another writer was first
            fs.delete(source, True)
    there = manifest(*(spark.read.parquet(f"{root}/{n}") for n in ("evidence", "assets"))).first()
    if there["index_id"] != index_id:
        raise ValueError(f"{root} holds another content than its id names")
    fs, new = _fs(spark, f"{folder}/.current-{uuid.uuid4().hex}.json")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps({"index_id": index_id}).encode()))
    out.close()
    _, current = _fs(spark, f"{folder}/current.json")
    jvm = spark._jvm
    over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(current.toUri() if current.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration()).rename(new, current, over)
    return index_id


def load(spark, folder: str, check: bool = False) -> tuple[DataFrame, DataFrame, TextIndex]:
    """Units, assets and text index of the current generation; ``check`` holds it against its records first."""
    root = f"{folder}/generations/{spark.read.json(f'{folder}/current.json').first()['index_id']}"
    read = lambda n: spark.read.parquet(f"{root}/{n}")
    found = read("evidence"), read("assets"), TextIndex(*(read(n) for n in _TABLES))
    if check and (faults := [r["rule"] for r in index_faults(*found, read("manifest")).collect()]):  # a few rules at most
        raise ValueError(f"the index doesn't match its records: {', '.join(faults)}")
    return found
