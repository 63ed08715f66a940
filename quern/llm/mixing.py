"""Operator 8: mixing sources to target weights, in blocks of a fixed number of tokens.

The documents of a source are hashed into streams of some millions of tokens. A
stream is its documents by id, each with its end, cut into blocks; the last is
filled up with ends. The blocks of a source are numbered through all its
streams. Each output shard draws how many of its slots each source gets from a
multinomial of the target weights: a pseudorandom number for each slot falls into the
share of one source in the sum of all weights, and its hits are a source's count. That
takes a join by cells of the sum, however many sources there are. The slots of a source, counted through
all shards, go through a pseudorandom permutation of its block numbers, anew for
each pass over the source, and blocks are joined to slots by number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import kernel, tokens
from quern.llm.work import small_batches, written

BLOCK = 1024
#: Slots of an output shard, and blocks of a stream, about.
SLOTS, STREAM_BLOCKS = 1024, 2048
#: Without given weights a source's is its tokens to this power.
FLATTEN = 0.5
SEED = 17
#: The largest weight, as a whole number: shares are exact, in whatever order sources come.
WHOLE = 1 << 32
#: Passes over a source that one task fills slots from.
EPOCHS = 4

_TOKENS = "source string, doc_id long, lang string, n long, ids binary, place long"
_U = np.uint64


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of each i in a permutation of 0 to n - 1 that ``key`` chooses.

    Four Feistel rounds over the least even number of bits that hold n, again
    for those that fall at n or beyond.
    """
    i, n, key = np.broadcast_arrays(np.asarray(i, np.uint64), np.asarray(n, np.uint64), np.asarray(key, np.uint64))
    out = i.copy()
    with np.errstate(over="ignore"):
        half = np.zeros(len(out), np.uint64)
        while (small := (_U(1) << (half + half)) < n).any():
            half[small] += _U(1)
        mask = (_U(1) << half) - _U(1)
        todo = np.arange(len(out))
        while len(todo):
            k, h, m = key[todo], half[todo], mask[todo]
            left, right = out[todo] >> h, out[todo] & m
            for r in range(4):
                left, right = right, left ^ (kernel.mix64(right + k + _U(r + 1) * _U(0x9E3779B97F4A7C15)) & m)
            out[todo] = (left << h) | right
            todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def _key(source_key: np.ndarray, epoch: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return kernel.mix64(source_key.view(np.uint64) + epoch.astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def uniforms(shard: int, slots: int, seed: int) -> np.ndarray:
    """A number from 0 to 1, less than that, for each slot of the shard."""
    with np.errstate(over="ignore"):
        key = kernel.mix64(np.array([seed, shard], np.uint64) * _U(0x9E3779B97F4A7C15))
        return (kernel.mix64(kernel.mix64(key[:1] + key[1:] * _U(3)) + np.arange(slots, dtype=np.uint64) * _U(0xD6E8FEB86659FD93)) >> _U(11)) * 2.0**-53


def shares(sources: DataFrame) -> tuple[DataFrame, int]:
    """``sources`` (source, weight, ...) with where each one's share of the sum begins and ends, low and high, and the sum.

    Weights are rounded up to whole numbers of which the largest is WHOLE; sources without one are left out.
    """
    top = sources.agg(F.max("weight")).first()[0]
    if not top:
        return sources.limit(0).withColumns({"low": F.lit(0).cast("long"), "high": F.lit(0).cast("long")}), 0
    s = sources.where("weight > 0").withColumn("whole", F.ceil(F.col("weight") / top * WHOLE).cast("long")).withColumn("part", F.pmod(F.xxhash64("source"), F.lit(1024)))
    parts = s.groupBy("part").agg(F.sum("whole").alias("own")).withColumn("base", F.sum("own").over(Window.orderBy("part")) - F.col("own"))  # 1024 rows
    within = F.sum("whole").over(Window.partitionBy("part").orderBy("source").rowsBetween(Window.unboundedPreceding, 0))
    s = s.withColumn("within", within).join(parts.select("part", "base"), "part")
    s = written(s.withColumn("high", F.col("base") + F.col("within")).withColumn("low", F.col("high") - F.col("whole")).drop("part", "base", "within", "whole"), "shares")
    return s, s.agg(F.max("high")).first()[0]


def draws(shards: int, sources: DataFrame, slots: int, seed: int) -> DataFrame:
    """(shard, source, blocks, source_key, n): how many slots of each shard each source gets; one that gets none isn't listed."""
    spark = sources.sparkSession
    share, total = shares(sources)
    cells = max(1024, 4 * share.count())
    wide = -(-max(total, 1) // cells)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.column(0).to_pylist():
                at = (uniforms(shard, slots, seed) * total).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(slots, shard)), pa.array(at), pa.array(at // wide)], names=["shard", "at", "cell"])

    drawn = spark.range(0, shards if total else 0, 1, max(1, min(2048, -(-shards // 64)))).mapInArrow(draw, "shard long, at long, cell long")
    share = share.withColumn("cell", F.explode(F.sequence(F.expr(f"low div {wide}"), F.expr(f"(high - 1) div {wide}"))))
    # Catalyst takes the slots for as few as the shards they are drawn in, and would broadcast them
    hit = drawn.hint("merge").join(share, "cell").where("at >= low and at < high")
    return hit.groupBy("shard", "source", "blocks", "source_key").agg(F.count("*").alias("n"))


def _slots(shards: int, sources: DataFrame, slots: int, seed: int) -> DataFrame:
    """(source, block, shard, slot, epoch): where each drawn block goes."""
    drawn = written(draws(shards, sources, slots, seed), "draws")
    # running counts in two levels, so that no source's shards meet in one task
    part = F.expr("shard div 64")
    before = drawn.groupBy("source", part.alias("part")).agg(F.sum("n").alias("of_part"))
    before = before.withColumn("base", F.sum("of_part").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select(F.col("source").alias("of"), "part", "base")
    run = drawn.withColumn("part", part).withColumn("own", F.sum("n").over(Window.partitionBy("source", "part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    run = run.hint("merge").join(before, F.col("source").eqNullSafe(F.col("of")) & (run["part"] == before["part"])).select("shard", "source", "blocks", "source_key", "n", (F.coalesce("base", F.lit(0)) + F.coalesce("own", F.lit(0))).alias("first"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard, blocks, key, n, first, within = (np.asarray(c) for c in b.columns[1:])
            at = np.repeat(np.arange(len(n)), n)
            j = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            epoch, rest = np.divmod(first[at] + j, blocks[at])
            block = permuted(rest, blocks[at], _key(key[at], epoch))
            slot = permuted(within[at] + j, np.full(len(at), slots), kernel.mix64(shard[at].astype(np.uint64) + _U(seed)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(block), pa.array(shard[at]), pa.array(slot.astype(np.int32)), pa.array(epoch.astype(np.int32))], names=["source", "block", "shard", "slot", "epoch"])

    return run.withColumn("within", within).select("source", "shard", "blocks", "source_key", "n", "first", "within").mapInArrow(place, "source string, block long, shard long, slot int, epoch int")


def _encoded(docs: DataFrame, vocabulary: bytes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens.tokenizer(vocabulary)
        for b in batches:
            for i, j, ids, off in t.encode(b.column(3)):
                blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(off * 2), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(3)), pa.array(np.diff(off) + 1), blob.cast(pa.binary()), b.column(4).slice(i, j - i)], names=["source", "doc_id", "lang", "n", "ids", "place"])

    return docs.mapInArrow(run, _TOKENS)


_SLOT = "shard long, slot int, source string, block long, epoch int, doc_ids array<long>, lang string, n_tokens int, "
_MIXED, _MIXED_TEXT = _SLOT + "tokens array<int>", _SLOT + "text string"
_SLOT_TYPES = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.string(), pa.int32()]


def _texts(t: tokens.Tokenizer, ids: np.ndarray, stops: np.ndarray, blocks: np.ndarray, block: int) -> list[str]:
    """The text of each block of a stream whose documents end, with their ends, at ``stops``.

    A character that a block's edge falls into belongs to the block in which it begins. Documents are parted by a blank line.
    """
    at = np.append(0, np.cumsum(t.size[ids]))  # bytes before each token
    data = t.decode(ids)
    raw = np.frombuffer(data, np.uint8)
    edge = at[np.minimum(np.stack([blocks, blocks + 1]) * block, len(ids))]
    for _ in range(3):  # a character has three bytes more at most
        inside = edge < len(raw)
        inside[inside] = raw[edge[inside]] & 0xC0 == 0x80
        edge[inside] += 1
    ends = at[stops]
    out = []
    for low, high in edge.T:
        cut = [low, *ends[np.searchsorted(ends, low, side="right") : np.searchsorted(ends, high)], high]
        out.append("\n\n".join(data[a:b].decode() for a, b in zip(cut, cut[1:]) if a < b))
    return out


def _filled(
    docs: DataFrame, weights: dict[str | None, float] | None, block: int, slots: int, shards: int | None, seed: int, vocabulary_path: str, id_col: str, text_col: str, stream_blocks: int, as_text: bool,
) -> DataFrame:
    if weights is not None and not all(0 <= w < float("inf") for w in weights.values()):
        raise ValueError("weights must be finite and not negative")
    spark = docs.sparkSession
    small_batches(spark)
    vocabulary = tokens.read_vocabulary(vocabulary_path)
    null = F.lit(None).cast("string")
    source, lang = (docs[c].cast("string").alias(c) if c in docs.columns else null.alias(c) for c in ("source", "lang"))
    doc, body = docs[id_col].cast("long"), docs[text_col].cast("string")
    src = docs.select(source, doc.alias("doc_id"), lang, body.alias("text"), F.xxhash64(doc, body).alias("place")).where("text is not null and text <> ''")
    table = written(_encoded(src, vocabulary), "mixing", "zstd")

    # streams: so many of a source as make about stream_blocks blocks each
    total = written(table.groupBy("source").agg(F.sum("n").alias("total")), "sources")
    streams = F.greatest(F.lit(1), F.ceil(F.col("total") / (stream_blocks * block))).cast("long")
    table = table.join(total.select(F.col("source").alias("of"), streams.alias("streams")), F.col("source").eqNullSafe(F.col("of")))
    table = table.withColumn("stream", F.pmod("place", "streams")).drop("of", "streams", "place")
    size = table.groupBy("source", "stream").agg(F.expr(f"(sum(n) + {block - 1}) div {block}").alias("blocks"), F.sum("n").alias("total"))
    by_source = Window.partitionBy("source").orderBy("stream").rowsBetween(Window.unboundedPreceding, -1)
    size = written(size.withColumn("start", F.coalesce(F.sum("blocks").over(by_source), F.lit(0))), "streams")
    sources = size.groupBy("source").agg(F.sum("blocks").alias("blocks"), F.sum("total").alias("total"))
    weight = F.col("total").cast("double") ** FLATTEN
    if weights is not None:  # as many as the caller names
        given = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "named string, given double")
        sources, weight = sources.join(given, F.col("source").eqNullSafe(F.col("named")), "left"), F.coalesce("given", F.lit(0.0))
    sources = written(sources.select("source", "blocks", weight.alias("weight"), F.xxhash64("source", F.lit(seed)).alias("source_key")), "weights")
    if shards is None:
        shards = -(-(sources.agg(F.sum("blocks")).first()[0] or 0) // slots)

    slot = written(_slots(shards, sources, slots, seed), "slots")
    coarse = stream_blocks // 2 or 1
    where = size.select("source", "stream", "start", (F.col("start") + F.col("blocks")).alias("stop"))
    where = where.select(F.col("source").alias("of"), "stream", "start", "stop", F.explode(F.sequence(F.expr(f"start div {coarse}"), F.expr(f"(stop - 1) div {coarse}"))).alias("near"))
    slot = slot.join(where, F.col("source").eqNullSafe(F.col("of")) & (F.expr(f"block div {coarse}") == F.col("near"))).where("block >= start and block < stop")
    slot = slot.select("source", "stream", F.expr(f"epoch div {EPOCHS}").cast("int").alias("turn"), (F.col("block") - F.col("start")).alias("own"), "block", "shard", "slot", "epoch")
    # a stream that many passes are made over is handed to several tasks
    turns = slot.groupBy("source", "stream").agg(F.max("turn").alias("turns"))
    turns = written(turns.withColumnRenamed("source", "of").withColumnRenamed("stream", "of_stream"), "turns")
    table = table.join(turns, F.col("source").eqNullSafe(F.col("of")) & (F.col("stream") == F.col("of_stream")), "left")
    table = table.select("source", "stream", F.explode(F.sequence(F.lit(0), F.coalesce("turns", F.lit(0)))).alias("turn"), "doc_id", "lang", "ids")

    def fill(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in (_MIXED_TEXT if as_text else _MIXED).split(", ")]
        types = [*_SLOT_TYPES, pa.string() if as_text else pa.list_(pa.int32())]
        if not len(left) or not len(right):
            return pa.table({n: pa.array([], t) for n, t in zip(names, types)})
        kernel.frugal()
        t = tokens.tokenizer(vocabulary)
        doc, blob, langs = left["doc_id"].to_pylist(), left["ids"].to_pylist(), left["lang"].to_pylist()
        order = sorted(range(len(doc)), key=lambda k: (doc[k] is None, doc[k] or 0, blob[k], langs[k] or ""))
        end = np.uint16(t.eos).tobytes()
        ids = np.frombuffer(b"".join(x for k in order for x in (blob[k], end)), np.uint16)
        stops = np.cumsum([len(blob[k]) // 2 + 1 for k in order])
        del blob
        real = len(ids)
        own = np.asarray(right["own"])
        first = np.searchsorted(stops, own * block, side="right")
        last = np.searchsorted(stops, np.minimum((own + 1) * block, real) - 1, side="right")
        n = last - first + 1
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        flat = pa.array([doc[order[k]] for k in at], pa.int64())
        size = len(own)
        columns = [
            right["shard"], right["slot"], pa.array([key[0].as_py()] * size, pa.string()), right["block"], right["epoch"], pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), flat),
            pa.array([langs[order[k]] for k in first], pa.string()), pa.array(np.minimum(block, real - own * block).astype(np.int32)),
        ]
        if as_text:
            blocks, which = np.unique(own, return_inverse=True)
            columns.append(pa.array(_texts(t, ids, stops, blocks, block), pa.string()).take(pa.array(which)))
        else:
            ids = np.concatenate([ids, np.full(-real % block, t.eos, np.uint16)]).reshape(-1, block)
            columns.append(pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * block), pa.array(ids[own].ravel().astype(np.int32))))
        return pa.table(columns, names=names)

    return table.groupBy("source", "stream", "turn").cogroup(slot.groupBy("source", "stream", "turn")).applyInArrow(fill, _MIXED_TEXT if as_text else _MIXED)


def mixed(
    docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK, slots: int = SLOTS, shards: int | None = None, seed: int = SEED,
    vocabulary_path: str = tokens.VOCABULARY, id_col: str = "doc_id", text_col: str = "text", stream_blocks: int = STREAM_BLOCKS,
) -> DataFrame:
    """One row for each slot of each output shard: (shard, slot, source, block, epoch, doc_ids, lang, n_tokens, tokens).

    ``weights`` are the sources' target shares of the slots, in any scale; a source
    without one gets none, and one that is negative, infinite or no number is an error. Without weights they are tokens ** FLATTEN, so that small sources
    gain. Without ``shards`` there are as many as hold all blocks once. ``tokens`` has
    ``block`` ids of which the first ``n_tokens`` are of documents (each with its end),
    the rest ends that fill up a stream's last block; ``doc_ids`` are the documents
    in it, in order, and ``lang`` is the first's. ``epoch`` counts the passes over a source.

    Null and empty texts have no tokens and are in no block. Null sources are a
    source of their own; a missing source or language column is null. A null id comes last in its stream. Ties
    of an id go by text, and repeated rows are each in a stream, so the result depends on the
    rows alone, not on how they are stored. Texts are packed whole. Other columns aren't
    read. An empty table, or weights that are all 0, give no rows.
    """
    return _filled(docs, weights, block, slots, shards, seed, vocabulary_path, id_col, text_col, stream_blocks, False)


def mixed_documents(
    docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK, slots: int = SLOTS, shards: int | None = None, seed: int = SEED,
    vocabulary_path: str = tokens.VOCABULARY, id_col: str = "doc_id", text_col: str = "text", stream_blocks: int = STREAM_BLOCKS,
) -> DataFrame:
    """``mixed`` as documents (doc_id, text, lang, source, n_chars), a row for each slot; nulls, empty tables and all else as there.

    ``doc_id`` numbers the slots through all shards. Documents of a block are parted by a blank line. A
    character that a block's edge falls into is whole, in the block in which it begins, so that all blocks of a pass hold
    each document's characters once. A block in which only the end of a document is left has an empty text.
    """
    got = _filled(docs, weights, block, slots, shards, seed, vocabulary_path, id_col, text_col, stream_blocks, True)
    return got.select((F.col("shard") * slots + F.col("slot")).alias("doc_id"), "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
