"""Operator 2: document fingerprints from content-defined chunks.

A gear hash of the last 32 bytes is computed at all positions at once, by
doubling: the hash of 2m bytes joins two of m. Chunks end where its high bits are zero;
before the normal size more bits have to be (a rarer boundary), after it fewer, which draws
sizes towards the normal. An insertion moves only the boundaries beside it,
so the digests of all other chunks stay.

A document's fingerprint is its set of chunk digests with their lengths in bytes. The containment of
one document in another is the share of the first one's weight that the second
has too. Every document that contains it to the threshold is a link of it: a document has the number of its links, the one
that contains most, and its class, which is all documents with the same chunks; ``links`` lists the pairs of classes. All of these are exact.

Inside, documents that hold the same of the chunks
that occur elsewhere are one group, since they contain equally much of any other; so a passage that thousands
have in texts of their own gives one group, not the square of pairs. A group's rarest chunks, so many that the rest
weigh less than the threshold, propose all that hold any of them, and those are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import kernel
from quern.llm.work import small_batches, written

#: Sizes of a chunk in bytes, and the bits that must be zero before and after the normal size.
LEAST, NORMAL, LARGEST = 64, 256, 1024
BITS_BEFORE, BITS_AFTER = 9, 6
#: A container is named from this share on.
THRESHOLD = 0.5
#: Holders of a chunk that one part of the join by chunk meets, about.
HOLDERS_A_PART = 256

_GEAR = (kernel.random_table(41, 256) >> np.uint64(32)).astype(np.uint32)
_FAR = np.iinfo(np.int64).max


def gear(data: np.ndarray) -> np.ndarray:
    """At each position the sum over k < 32 of the gear of the byte k before it, shifted left by k."""
    h = _GEAR[data]
    with np.errstate(over="ignore"):
        for k in (1, 2, 4, 8, 16):
            h[k:] += h[:-k] << np.uint32(k)
    return h


def boundaries(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the chunks, by document, and their documents.

    All documents advance by a chunk at a time. Bytes before a document's start
    can't matter, since no chunk is under 32 bytes but a whole document or its last.
    """
    h = gear(data)
    easy = np.flatnonzero(h >> np.uint32(32 - BITS_AFTER) == 0) + 1  # a chunk may end before these positions
    hard = easy[h[easy - 1] >> np.uint32(32 - BITS_BEFORE) == 0]
    easy, hard = np.append(easy, _FAR), np.append(hard, _FAR)
    doc = np.flatnonzero(np.diff(off))
    at, stop = off[:-1][doc], off[1:][doc]
    starts, ends, docs = [], [], []
    while len(doc):
        soon = hard[np.searchsorted(hard, at + LEAST)]
        late = easy[np.searchsorted(easy, at + NORMAL)]
        end = np.minimum(np.where(soon < at + NORMAL, soon, np.minimum(late, at + LARGEST)), stop)
        starts.append(at)
        ends.append(end)
        docs.append(doc)
        on = end < stop
        doc, at, stop = doc[on], end[on], stop[on]
    if not starts:
        return (np.zeros(0, np.int64),) * 3
    s, e, d = np.concatenate(starts), np.concatenate(ends), np.concatenate(docs)
    order = np.argsort(s)
    return s[order], e[order], d[order]


_PRINTS = "doc_id long, n_bytes long, digests array<long>, lengths array<int>"


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, digests, lengths) of every row: the distinct chunks in ascending order of digest, and their lengths.

    A text under LEAST bytes is one chunk; null and empty texts have none, and ``n_bytes`` is null for a null one.
    Repeated rows each have theirs, alike, and a null id stays null. Texts are read whole, bytes as they are: case
    and blanks matter. Other columns aren't read. An empty table gives none.
    """

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel.frugal()
        for b in batches:
            data, off, null = kernel.utf8(b.column(1))
            for i, j in kernel.passes(off):
                own, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                s, e, d = boundaries(own, o)
                g = kernel.span_hashes(own, s, e).view(np.int64)
                order = np.lexsort((g, d))
                g, d, n = g[order], d[order], (e - s)[order]
                new = np.append(True, (g[1:] != g[:-1]) | (d[1:] != d[:-1]))[: len(g)]
                at = pa.array(np.searchsorted(d[new], np.arange(j - i + 1)).astype(np.int32))
                size = pa.array(np.diff(o), mask=null[i:j])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), size, pa.ListArray.from_arrays(at, pa.array(g[new])), pa.ListArray.from_arrays(at, pa.array(n[new].astype(np.int32)))], names=["doc_id", "n_bytes", "digests", "lengths"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, _PRINTS)


def chunks(prints: DataFrame) -> DataFrame:
    """(doc_id, digest, length): the distinct chunks of each id."""
    pair = F.explode(F.arrays_zip("digests", "lengths"))
    return prints.where("doc_id is not null").select("doc_id", pair.alias("x")).select("doc_id", F.col("x.digests").alias("digest"), F.col("x.lengths").alias("length"))


def containment(left: DataFrame, right: DataFrame) -> DataFrame:
    """(doc_id, other_id, containment) of all pairs of two fingerprint tables that share a chunk: the share of the left's weight that the right has.

    For two tables of which one is small or chunks are rarely shared; within one table use ``containers``.
    """
    a, b = chunks(left).distinct(), chunks(right).select(F.col("doc_id").alias("other_id"), "digest").distinct()
    weight = a.groupBy("doc_id").agg(F.sum("length").alias("weight"))
    shared = a.join(b, "digest").groupBy("doc_id", "other_id").agg(F.sum("length").alias("shared"))
    return shared.join(weight, "doc_id").select("doc_id", "other_id", F.round(F.col("shared") / F.col("weight"), 6).alias("containment"))


def least_shared(weight: str, threshold: float) -> F.Column:
    """The fewest bytes that are a share of ``threshold`` of the weight, as division has it: 0.55 * 100 is above 55, and 55 / 100 is 0.55."""
    n = F.ceil(F.lit(float(threshold)) * F.col(weight))
    return F.when((n - 1) / F.col(weight) >= threshold, n - 1).when(n / F.col(weight) < threshold, n + 1).otherwise(n)


def _groups(prints: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Documents that share a chunk, by group, and what groups share.

    (doc_id, one, elsewhere, weight, need, class_id) of each document: ``one`` is the smallest id of those that hold the same of
    the chunks that occur elsewhere, ``elsewhere`` the weight of these, ``need`` what a container must have of them, ``class_id``
    the smallest id with the same chunks. And (one, container_id, shared) of all pairs of groups, named by ``one``, of which the
    second has as much as any document of the first needs.
    """
    rows = chunks(prints)
    # rare is a row that repeats an id; the shuffle by digest is needed anyway
    two = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("top")).where("least < top").select("digest")
    held = written(rows.join(two, "digest").select("doc_id", "digest", "length").distinct(), "held")
    total = rows.distinct().groupBy("doc_id").agg(F.sum("length").alias("weight"))

    # any document of a group contains as much of another
    prints_of = [F.bit_xor(F.xxhash64("digest", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    sets = written(held.groupBy("doc_id").agg(F.sum("length").alias("elsewhere"), F.count("*").alias("n"), *prints_of).join(total, "doc_id"), "sets")
    key = ["x1", "x2", "n", "elsewhere"]
    # who has no chunk but shared ones has the same chunks as others of the group like that
    alike = F.min(F.when(F.col("weight") == F.col("elsewhere"), F.col("doc_id"))).alias("alike")
    heads = sets.groupBy(*key).agg(F.min("doc_id").alias("one"), F.min("weight").alias("weight"), alike)
    class_id = F.when(F.col("weight") == F.col("elsewhere"), F.col("alike")).otherwise(F.col("doc_id")).alias("class_id")
    members = sets.join(heads.drop("weight"), key).select("doc_id", "one", "elsewhere", "weight", least_shared("weight", threshold).alias("need"), class_id)
    members = written(members, "members")
    of_group = held.join(heads.select(F.col("one").alias("doc_id")), "doc_id", "left_semi").withColumnRenamed("doc_id", "one")
    holders = of_group.groupBy("digest").agg(F.count("*").alias("holders"))
    of_group = written(of_group.join(holders, "digest"), "groups")

    # a container misses less than all of a document's rarest chunks, once the others weigh too little: only who holds one of those is compared
    able = heads.withColumn("need", least_shared("weight", threshold)).where("elsewhere >= need").select("one", "elsewhere", "need")
    before = Window.partitionBy("one").orderBy("holders", "digest").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("elsewhere") - F.coalesce(F.sum("length").over(before), F.lit(0))
    mine = of_group.join(able, "one").withColumn("left", left).withColumn("probe", F.col("left") >= F.col("need"))
    mine = written(mine.withColumn("rest", F.min(F.when(F.col("probe"), F.col("left") - F.col("length"))).over(Window.partitionBy("one"))), "mine")
    # holders of a chunk that many have are dealt to parts
    parts = F.ceil(F.col("holders") / HOLDERS_A_PART)
    theirs = of_group.where("holders > 1").select(F.col("one").alias("container_id"), "digest", F.pmod(F.xxhash64("one"), parts).alias("part"))
    probes = mine.where("probe and holders > 1").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    met = probes.join(theirs, ["digest", "part"]).where("one <> container_id").groupBy("one", "container_id").agg(F.sum("length").alias("shared"), F.first("rest").alias("rest"), F.first("need").alias("need"))
    pair = written(met.where("shared + rest >= need").select("one", "container_id", "shared", "need"), "pairs")
    later = mine.where("not probe and holders > 1").select("one", "digest", "length").join(pair.select("one", "container_id", "need"), "one").join(theirs.drop("part"), ["container_id", "digest"])
    shared = pair.unionByName(later.select("one", "container_id", F.col("length").cast("long").alias("shared"), "need"))
    return members, shared.groupBy("one", "container_id").agg(F.sum("shared").alias("shared"), F.first("need").alias("need")).where("shared >= need").drop("need")


def containers(prints: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, container_id, containment, links, class_id): for each document that others contain to ``threshold`` or more, the one of all that contains most of it, and the number of all of them.

    Of equals the smallest id is named. ``class_id`` is the smallest id of the documents with the same chunks, each of which is a link of
    the others. Rows that share an id are one document with the chunks of
    all. Rows without an id, and documents without chunks, take no part.
    """
    members, shared = _groups(prints, threshold)
    group = members.groupBy("one").agg(F.count("*").alias("size"), F.min(F.when(F.col("doc_id") > F.col("one"), F.col("doc_id"))).alias("two"), F.min("elsewhere").alias("shared"))
    shares = shared.join(group.select(F.col("one").alias("container_id"), "size"), "container_id").groupBy("one", "shared").agg(F.min("container_id").alias("container_id"), F.sum("size").alias("n"))
    shares = written(shares, "shares")
    best = shares.groupBy("one").agg(F.min(F.struct((-F.col("shared")).alias("less"), "container_id")).alias("other"))

    # links of a document that needs so much: documents of groups that have that or more, and of its own
    linked = members.where("elsewhere >= need")
    needs = linked.select("one", F.col("need").alias("shared"), F.lit(0).cast("long").alias("n")).distinct().withColumn("needed", F.lit(True))
    has = shares.select("one", "shared", "n").unionByName(group.select("one", "shared", (F.col("size") - 1).alias("n"))).withColumn("needed", F.lit(False))
    most_first = Window.partitionBy("one").orderBy(F.desc("shared")).rangeBetween(Window.unboundedPreceding, Window.currentRow)  # one row for each share of a group, however many have it
    counted = has.unionByName(needs).withColumn("links", F.sum("n").over(most_first)).where("needed").select("one", F.col("shared").alias("need"), "links")

    own = F.when(F.col("doc_id") > F.col("one"), F.col("one")).otherwise(F.col("two"))
    own = F.when(own.isNotNull(), F.struct((-F.col("elsewhere")).alias("less"), own.alias("container_id")))
    found = linked.join(counted, ["one", "need"]).where("links > 0").join(group.select("one", "two"), "one").join(best, "one", "left").withColumn("x", F.least(own, "other"))
    return found.select("doc_id", "x.container_id", F.round(-F.col("x.less") / F.col("weight"), 6).alias("containment"), "links", "class_id")


def links(prints: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(class_id, other_id, containment): all pairs of classes of which the second contains the first to ``threshold`` or more, each named by its ``class_id``.

    Every document of a class is a link of every document of one that it contains, and of the others of its own, so nothing else
    is needed to list all links of documents. Their number is that of the answer: texts that share much with many have many.
    """
    members, shared = _groups(prints, threshold)
    named = members.where("doc_id = class_id")
    within = named.select("one", F.col("one").alias("container_id"), F.col("elsewhere").alias("shared")).distinct()
    a = named.where("elsewhere >= need").select("class_id", "one", "weight", "need")
    b = named.select(F.col("class_id").alias("other_id"), F.col("one").alias("container_id"))
    pairs = a.join(shared.unionByName(within), "one").where("shared >= need").join(b, "container_id").where("class_id <> other_id")
    return pairs.select("class_id", "other_id", F.round(F.col("shared") / F.col("weight"), 6).alias("containment"))


def fingerprinted(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``fingerprints`` of every row, with its ``containers``: ``container_id`` and ``containment`` are null, and ``links`` is 0, where nothing contains the document.

    ``class_id`` is a document's own id where no other has the same chunks, or it has none. Rows without an id have neither class nor links.
    """
    prints = written(fingerprints(docs, id_col, text_col), "prints")
    of = prints.join(containers(prints, threshold), "doc_id", "left")
    return of.withColumn("links", F.when(F.col("doc_id").isNotNull(), F.coalesce("links", F.lit(0)))).withColumn("class_id", F.coalesce("class_id", "doc_id"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(spark.read.parquet(f"{sf_dir}/documents.parquet"))
