"""Operator 4: near duplicates by MinHash bands, verified with odd sketches.

Each document's word shingles give ``SAMPLES`` MinHash values. Bands of
``ROWS`` values propose candidates. Verification folds the samples into an
odd sketch: sample i with value v flips bit hash(i, v), so a bit holds the
parity of the samples that fell on it. Equal samples cancel in the XOR of two
sketches, and with p the share of bits that differ, similarity is
1 + bits / (4 * samples) * ln(1 - 2p).

Copies that agree in all words are folded first, by digest, so that their
number never multiplies candidates. Within a band's bucket each document is
held against the bucket's first; only where that fails, against all members
that aren't yet in its component, so no candidate is left out. Buckets that hold much of the corpus are
dealt to parts with a first each, which meet the bucket's; comparisons across components go by cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import kernel
from quern.llm.work import shared_dir, small_batches, written

SHINGLE = 3
SAMPLES, ROWS = 256, 4
BITS = 1024
THRESHOLD = 0.5
#: Buckets that hold about this share of all rows by band are dealt to PARTS; so many at most can.
HOT_SHARE, PARTS = 2.0**-14, 256
#: Members of a bucket that one side of a comparison across components holds.
CELL = 4096

_WORDS64 = BITS // 64
_SIGNATURE = "doc_id long, digest_a long, digest_b long, sketch array<long>, bands array<long>"
_MULT = (kernel.random_table(21, SAMPLES) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (kernel.random_table(22, SAMPLES) >> np.uint64(32)).astype(np.uint32)


def minhashes(sh: np.ndarray, first: np.ndarray, block: int = 1 << 14) -> np.ndarray:
    """``SAMPLES`` MinHash values of every document with shingles (rows in order)."""
    n = len(first) - 1
    out = np.full((SAMPLES, n), 0xFFFFFFFF, np.uint32)
    low = (sh >> np.uint64(32)).astype(np.uint32)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(first, first[i] + block, side="right")) - 1)
        x, at = low[first[i] : first[j]], first[i:j] - first[i]
        y = np.empty_like(x)
        for k in range(SAMPLES):
            np.multiply(x, _MULT[k], out=y)
            y += _ADD[k]
            np.minimum.reduceat(y, at, out=out[k, i:j])
        i = j
    return out.T


def odd_sketches(mh: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples: (documents, BITS / 64) words."""
    with np.errstate(over="ignore"):
        h = kernel.mix64(mh.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    bit = (h % np.uint64(BITS)).astype(np.int64)
    n = len(mh)
    counts = np.bincount((np.arange(n)[:, None] * BITS + bit).ravel(), minlength=n * BITS).reshape(n, BITS) & 1
    return np.packbits(counts.astype(np.uint8), axis=1, bitorder="little").view(np.uint64).reshape(n, _WORDS64)


def most_differing(threshold: float) -> int:
    """Bits that sketches of that similarity differ in, as expected."""
    return int(BITS / 2 * (1 - math.exp(-4 * SAMPLES * (1 - threshold) / BITS)))


def similarity(differing: np.ndarray | int) -> np.ndarray:
    """Estimated Jaccard similarity; 0 where half of the bits or more differ."""
    left = np.maximum(1 - 2 * np.asarray(differing, float) / BITS, 1e-12)
    return np.clip(1 + BITS / (4 * SAMPLES) * np.log(left), 0, 1)


def signatures_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the documents that have words, and their digests, sketches and bands."""
    data, off, _ = kernel.utf8(pc.utf8_lower(text))
    at, digests, sketches, bands = [], [], [], []
    with np.errstate(over="ignore"):
        for i, j in kernel.passes(off):
            low, s, e, first = kernel.words(data[off[i] : off[j]], off[i : j + 1] - off[i])
            has = np.flatnonzero(np.diff(first))
            if not len(has):
                continue
            h = kernel.span_hashes(low, s, e)
            start = first[:-1][has]
            # two digests of the word sequence: sums of hashes keyed by place
            place = (np.arange(len(h)) - np.repeat(start, np.diff(first)[has])).astype(np.uint64)
            a = kernel.mix64(h + place * np.uint64(0x9E3779B97F4A7C15))
            digests.append(np.stack([np.add.reduceat(a, start), np.add.reduceat(kernel.mix64(a ^ np.uint64(0x5851F42D4C957F2D)), start)], 1).view(np.int64))
            sh, sf = kernel.shingles(h, first, SHINGLE)
            mh = minhashes(sh, sf[np.append(has, len(first) - 1)])
            sketches.append(odd_sketches(mh).view(np.int64))
            quad = mh.reshape(len(mh), SAMPLES // ROWS, ROWS).astype(np.uint64)
            acc = np.arange(1, SAMPLES // ROWS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.zeros((len(mh), 1), np.uint64)
            for k in range(ROWS):
                acc = kernel.mix64(acc * np.uint64(0x9FB21C651E98DF25) + quad[:, :, k])
            bands.append(acc.view(np.int64))
            at.append(has + i)
    if not at:
        return np.zeros(0, np.int64), np.zeros((0, 2), np.int64), np.zeros((0, _WORDS64), np.int64), np.zeros((0, SAMPLES // ROWS), np.int64)
    return np.concatenate(at), np.concatenate(digests), np.concatenate(sketches), np.concatenate(bands)


def _lists(a: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32), a.ravel())


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kernel.frugal()
    for batch in batches:
        at, digest, sketch, band = signatures_of(batch.column(1))
        if len(at):
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), _lists(sketch), _lists(band)], names=["doc_id", "digest_a", "digest_b", "sketch", "bands"])


def differing(a: str, b: str) -> F.Column:
    """Population count of the XOR of two sketch columns, in generated code."""
    return sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(_WORDS64)), F.lit(0))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of each component; roots themselves aren't listed.

    Alternating large-star and small-star steps over checkpointed edges until
    they no longer change.
    """
    shared_dir(edges.sparkSession)

    def star(df: DataFrame, large: bool) -> DataFrame:
        both = df.union(df.select("v", "u")) if large else df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        x = both.join(both.groupBy("u").agg(F.min("v").alias("m")), "u").withColumn("m", F.least("u", "m"))  # no window: one node may have a third of all edges
        if large:
            return x.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        return x.select("v", "m").union(x.select("u", "m")).where("v <> m").distinct().toDF("u", "v")

    def state(df: DataFrame) -> tuple:
        return tuple(df.select(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())

    now = edges.toDF("u", "v").where("u <> v").distinct().checkpoint()
    before = state(now)
    while before[0]:
        now = star(star(now, True), False).checkpoint()
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


_MIXED = "a long, b long"


def _across(limit: int):
    """For one cell: pairs that verify across components, enough to join all that belong together.

    A cell has the members of one side, or of two that are held against each other.
    """

    def pairs(table: pa.Table) -> pa.Table:
        ids, label, side = (np.asarray(table[c]) for c in ("doc_id", "label", "side"))
        sk = np.asarray(table["sketch"].combine_chunks().flatten()).view(np.uint64).reshape(len(ids), _WORDS64)
        order = np.lexsort((ids, label))
        ids, label, sk, side = ids[order], label[order], sk[order], side[order]
        group = np.unique(label, return_inverse=True)[1]
        two = len(np.unique(side)) > 1
        parent = np.arange(group[-1] + 1)

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out_a, out_b = [], []
        for k in range(len(ids) - 1):
            rest = np.arange(int(np.searchsorted(group, group[k], side="right")), len(ids))
            rest = rest[side[rest] != side[k]] if two else rest
            for j in rest[np.bitwise_count(sk[rest] ^ sk[k]).sum(1, dtype=np.int32) <= limit]:
                x, y = root(group[k]), root(group[j])
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out_a.append(ids[k])
                    out_b.append(ids[j])
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return pairs


def _by_bucket(texts: DataFrame, least: int) -> DataFrame:
    """(text, bucket, part): each text's buckets. ``part`` is 0 but for buckets that hold much of all rows, and more than ``least``."""
    rows = texts.select("text", F.explode("bands").alias("bucket"))
    top = int(2 / HOT_SHARE)
    found = rows.agg(F.expr(f"filter(approx_top_k(bucket, {top}, {2 * top}), x -> x.count > {least})").alias("top"), F.count("*").alias("n")).first()  # of bounded size
    hot = [r["item"] for r in found["top"] or () if r["count"] > found["n"] * HOT_SHARE]
    cell = F.pmod(F.xxhash64("text"), F.lit(PARTS)).cast("int") + 1
    return rows.withColumn("part", F.when(F.col("bucket").isin(hot), cell).otherwise(0) if hot else F.lit(0))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, cell: int = CELL) -> DataFrame:
    """(doc_id, kept_id, similarity): each document that repeats one kept, which has the smallest id of its group.

    Groups are the connected components of pairs whose estimated similarity
    reaches ``threshold``. ``similarity`` is the estimate between the document
    and the one kept, rounded to 4 places; in a chain of copies it can be
    under the threshold.

    Documents without words (null, empty, only punctuation) and rows without an
    id are in no group. Fewer than three words make one shingle. Case and
    punctuation don't matter. Rows that repeat an id are one document; where
    their texts differ, any of them can make it part of a group, and ``similarity`` is 1 where
    the two documents share a text, else between each's text of the least digest. Long texts are
    read whole. Other columns aren't read. An empty table has no groups.
    """
    limit = most_differing(threshold)
    small_batches(docs.sparkSession)
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).where("doc_id is not null")
    sig = written(src.mapInArrow(_signatures, _SIGNATURE), "signatures")
    # a text is one digest, named by the smallest id that has it; ids with several texts are in several
    first = sig.groupBy("digest_a", "digest_b").agg(F.min("doc_id").alias("rep"))
    copies = sig.select("doc_id", "digest_a", "digest_b").join(first, ["digest_a", "digest_b"]).select("doc_id", "rep")
    text = F.struct("doc_id", F.col("digest_a").alias("digest")).alias("text")
    folded = sig.groupBy("digest_a", "digest_b").agg(F.min_by(F.struct("doc_id", "digest_a", "bands", "sketch"), "doc_id").alias("x")).select("x.*").select(text, "bands", "sketch")
    folded = written(folded, "texts")

    star = _by_bucket(folded.select("text", "bands"), cell)
    own = Window.partitionBy("bucket", "part")
    star = star.withColumn("leader", F.min("text").over(own)).withColumn("last", F.max("text").over(own)).where("leader <> last or part > 0")
    star = written(star.select("text", "bucket", "part", "leader"), "buckets")
    tops = star.where("part > 0").groupBy("bucket", "part").agg(F.first("leader").alias("text"))  # at most PARTS of each hot bucket
    tops = tops.withColumn("leader", F.min("text").over(Window.partitionBy("bucket"))).select("text", "bucket", "leader")
    star = star.select("text", "bucket", "leader").union(tops)

    sketch = folded.select("text", "sketch")
    pairs = star.where("text <> leader").select("text", "leader").distinct()
    judged = pairs.join(sketch, "text").withColumnRenamed("sketch", "s").join(sketch.select(F.col("text").alias("leader"), F.col("sketch").alias("t")), "leader")
    judged = written(judged.select("text", "leader", (differing("s", "t") <= limit).alias("near")), "judged")
    edges = judged.where("near").select("text.doc_id", "leader.doc_id").union(copies.where("doc_id <> rep"))
    label = components(edges)

    mixed = star.join(judged.where(~F.col("near")), ["text", "leader"], "left_semi").select("bucket").distinct()
    member = star.join(mixed, "bucket", "left_semi").select("text", "bucket").distinct().join(label.select(F.col("node").alias("id"), "root"), F.col("text.doc_id") == F.col("id"), "left")
    member = member.select("text", "bucket", F.coalesce("root", "text.doc_id").alias("label"))
    sides = member.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(F.count("*") / cell).cast("int").alias("sides")).where("lo <> hi")
    member = member.join(sides.select("bucket", "sides"), "bucket").withColumn("side", F.pmod(F.xxhash64("text"), F.col("sides")).cast("int"))
    # a side meets itself and every other: the cell is named by the lower side and the higher
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1))).select("text", "bucket", "label", "side", F.least("side", "other").alias("lower"), F.greatest("side", "other").alias("higher"))
    found = member.join(sketch, "text").select("bucket", "lower", "higher", "side", "text.doc_id", "label", "sketch").groupBy("bucket", "lower", "higher").applyInArrow(_across(limit), _MIXED)
    root = written(components(label.select("node", "root").union(found)), "groups")

    by_id = sig.groupBy("doc_id").agg(F.min_by("sketch", "digest_a").alias("sketch"), (F.min("digest_a") < F.max("digest_a")).alias("several"))
    s = by_id.select(F.col("doc_id").alias("node"), F.col("sketch").alias("s"), F.col("several").alias("s_several"))
    t = by_id.select(F.col("doc_id").alias("root"), F.col("sketch").alias("t"), F.col("several").alias("t_several"))
    estimate = F.round(F.greatest(F.lit(0.0), 1 + BITS / (4 * SAMPLES) * F.log(F.greatest(F.lit(1e-12), 1 - 2 * differing("s", "t") / BITS))), 4)
    both = root.join(s, "node").join(t, "root").select("node", "root", estimate.alias("similarity"), (F.col("s_several") | F.col("t_several")).alias("several"))
    digests = sig.select("doc_id", "digest_a").distinct()
    same = both.where("several").join(digests, F.col("node") == F.col("doc_id")).select("node", "root", "digest_a")
    same = same.join(digests.select(F.col("doc_id").alias("root"), "digest_a"), ["root", "digest_a"]).select("node", F.lit(True).alias("same")).distinct()
    return both.join(same, "node", "left").select(F.col("node").alias("doc_id"), F.col("root").alias("kept_id"), F.when(F.coalesce("same", F.lit(False)), 1.0).otherwise(F.col("similarity")).alias("similarity"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each group: all columns and rows whose id isn't in ``near_duplicates``.

    Rows that share an id stay or go together; rows without an id stay.
    """
    gone = near_duplicates(docs, id_col, text_col, threshold).select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")


def op4_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
