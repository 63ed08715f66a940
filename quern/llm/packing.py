"""Operator 1: best-fit packing into bins of several permitted capacities.

Documents are hashed into groups of some millions of tokens, and each group is
packed in one task: longest pieces first, each into the open bin that it leaves
least room in. Where none has room, a new bin opens, of the capacity that costs
least for each token it can hope to hold: the piece and as much as still fits of
the shorter ones to come. At the end each bin shrinks to the smallest capacity
that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import kernel, tokens
from quern.llm.work import small_batches

#: Permitted sequence lengths, in tokens, and the cost of a sequence beside its length.
CAPACITIES = (512, 1024, 2048, 4096, 8192)
BIN_COST = 32
#: Bytes of text that one group holds, about.
GROUP_BYTES = 16 << 20

_PACKED = "pack_group int, bin int, capacity int, n_tokens int, doc_ids array<long>, starts array<int>, lengths array<int>, tokens array<int>"


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, bin_cost: float = BIN_COST) -> tuple[list[int], list[int]]:
    """The bin of each piece, and the capacity of each bin.

    No piece may be longer than the largest capacity. Pieces of one length are
    placed in their order; of bins with equal room the one opened or filled last is taken.
    """
    caps = sorted(capacities)
    order = sorted(range(len(lengths)), key=lambda k: -lengths[k])
    # tokens[n]: of pieces not yet placed that are n long or shorter
    n_long = np.bincount(np.asarray(lengths, np.int64), minlength=caps[-1] + 1) if lengths else np.zeros(caps[-1] + 1, np.int64)
    short = np.cumsum(n_long * np.arange(len(n_long)))
    rooms: list[list[int]] = [[] for _ in range(caps[-1] + 1)]
    open_rooms = 0  # bit r is set where rooms[r] isn't empty
    of, used = [0] * len(lengths), []
    placed_here = at_length = 0
    for k in order:
        n = lengths[k]
        if n != at_length:
            at_length, placed_here = n, 0
        placed_here += n
        above = open_rooms >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_rooms &= ~(1 << room)
        else:
            b, best = len(used), None
            for c in caps[bisect_left(caps, n) :]:
                left = min(c - n, n)
                to_come = int(short[left]) - (placed_here if left >= n else 0)
                cost = (c + bin_cost) / max(1, n + min(c - n, to_come))
                if best is None or cost < best:
                    best, room = cost, c
            used.append(0)
        of[k] = b
        used[b] += n
        if room > n:
            rooms[room - n].append(b)
            open_rooms |= 1 << (room - n)
    return of, [caps[bisect_left(caps, u)] for u in used]


def packed(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, bin_cost: float = BIN_COST, vocabulary_path: str = tokens.VOCABULARY, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row for each bin: (pack_group, bin, capacity, n_tokens, doc_ids, starts, lengths, tokens).

    A document and its end make a sequence, cut into pieces of the largest
    capacity where it is longer; piece k of a bin is ``lengths[k]`` tokens of
    ``doc_ids[k]`` from token ``starts[k]`` on, and ``tokens`` holds all pieces in that
    order. Documents are dealt to groups of about ``group_bytes`` of text, and bins hold documents of one group. Every text is packed whole, once for each row that holds it. Null and empty texts have nothing to
    pack. A null id packs as null. Ties are broken by id, then by text, so the
    result depends on the rows alone, not on how they are stored. Other columns
    aren't read. An empty table gives no bins.
    """
    caps = tuple(sorted(set(capacities)))
    vocabulary = tokens.read_vocabulary(vocabulary_path)
    small_batches(docs.sparkSession)
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).where("text is not null and text <> ''")
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // group_bytes))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens.tokenizer(vocabulary)
        for b in batches:
            for i, j, ids, off in t.encode(b.column(2)):
                ids = ids.astype(np.uint16).view(np.uint8)
                blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(off * 2), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), blob.cast(pa.binary())], names=["pack_group", "doc_id", "ids"])

    def bins(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel.frugal()
        tab = pa.Table.from_batches(list(batches)).combine_chunks()
        if not len(tab):
            return
        blob = tab["ids"].to_pylist()
        doc = tab["doc_id"].to_pylist()
        order = sorted(range(len(doc)), key=lambda k: (doc[k] is None, doc[k] or 0, blob[k]))
        eos = tokens.tokenizer(vocabulary).eos
        piece_doc, piece_start, pieces = [], [], []
        for k in order:
            ids = np.append(np.frombuffer(blob[k], np.uint16), np.uint16(eos))
            for s in range(0, len(ids), caps[-1]):
                piece_doc.append(doc[k])
                piece_start.append(s)
                pieces.append(ids[s : s + caps[-1]])
        lengths = [len(x) for x in pieces]
        of, capacity = pack(lengths, caps, bin_cost)
        by_bin = sorted(range(len(of)), key=of.__getitem__)
        count = np.bincount(of)
        for a in range(0, len(count), 512):  # bins of one Arrow batch
            c = count[a : a + 512]
            at = int(count[:a].sum())
            own = by_bin[at : at + int(c.sum())]
            off = pa.array(np.append(0, np.cumsum(c)).astype(np.int32))
            n = np.add.reduceat([lengths[k] for k in own], np.cumsum(c) - c)
            lists = [pa.ListArray.from_arrays(off, x) for x in (pa.array([piece_doc[k] for k in own], pa.int64()), pa.array([piece_start[k] for k in own], pa.int32()), pa.array([lengths[k] for k in own], pa.int32()))]
            flat = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(np.concatenate([pieces[k] for k in own]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(c), pa.int32()), pa.array(np.arange(a, a + len(c), dtype=np.int32)), pa.array(capacity[a : a + 512], pa.int32()), pa.array(n.astype(np.int32)), *lists, flat], names=[x.split()[0] for x in _PACKED.split(", ")])

    group = F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int")  # by text too: one id, or none, may be that of many rows
    return src.select(group.alias("pack_group"), "doc_id", "text").mapInArrow(encode, "pack_group int, doc_id long, ids binary").groupBy("pack_group").applyInArrow(bins, _PACKED)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
