"""Operator 6: line dedup by a sharded minimal perfect hash.

A first pass counts the distinct line hashes and finds each one's first document. All of
them are split by hash into shards of about a million, and each shard becomes a
minimal perfect hash of levels: a hash puts each key on a bit of an array twice
as long as there are keys, keys that share a bit go to the next level, and the rank of
a key's bit is its number. By that number a shard keeps a compact fingerprint, the
count, and the first document.

A second pass sends each document's distinct line hashes to their shards, where they probe
these arrays; no table of lines is joined. Probes are rebalanced by shard and sorted by it, so that a
task meets a shard once and holds one at a time, and those of a line that a third of all documents
have are dealt to several tasks. Only what has to go comes back, as a list of hashes for each
document that loses lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import kernel
from quern.llm.work import new_folder, small_batches, written

#: A line that the corpus holds more often than MOST stays only where it first occurs.
MOST = 1
#: No line of 50 words is shorter (in UTF-8 bytes, blanks between words included).
PASSAGE_BYTES = 99
#: Keys of a shard, about.
SHARD_KEYS = 1 << 20
GAMMA, LEVELS = 2.0, 40

_U = np.uint64
_LAST = np.iinfo(np.int64).max


def _bit(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (kernel.mix64(keys + _U(level + 1) * _U(0x9E3779B97F4A7C15)) % _U(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys: each has its own number from 0 to n - 1."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray) -> None:
        self.sizes, self.bits = sizes, bits
        self.begin = np.cumsum(sizes) - sizes
        ones = np.bitwise_count(bits.view(np.uint64)).astype(np.int64)
        self.rank = np.cumsum(ones) - ones  # ones before each word

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        sizes, parts = [], []
        for level in range(LEVELS):
            if not len(keys):
                break
            size = -(-int(GAMMA * len(keys)) // 64) * 64 or 64
            at = _bit(keys, level, size)
            once = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(np.packbits(once, bitorder="little"))
            keys = keys[~once[at]]
        if len(keys):
            raise ValueError("keys repeat")
        return cls(np.array(sizes, np.int64), np.concatenate(parts) if parts else np.zeros(0, np.uint8))

    def number(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key of the set; of another key any number, or -1."""
        out = np.full(len(keys), -1, np.int64)
        words = self.bits.view(np.uint64)
        left = np.arange(len(keys))
        for level, (size, begin) in enumerate(zip(self.sizes, self.begin)):
            if not len(left):
                break
            at = _bit(keys[left], level, int(size)) + begin
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            there = (words[word] >> bit) & _U(1) == 1
            below = words[word[there]] & ((_U(1) << bit[there]) - _U(1))
            out[left[there]] = self.rank[word[there]] + np.bitwise_count(below)
            left = left[~there]
        return out


@dataclass
class Lines:
    """Lines of a pass over documents, in order."""

    h: np.ndarray  # hash of the line without blanks around, never 0; 0 where that is under the least bytes
    start: np.ndarray
    stop: np.ndarray
    ends: np.ndarray  # 1 where a line feed follows, 0 for a document's last line
    doc: np.ndarray
    first: np.ndarray  # first line of each document


def lines_of(data: np.ndarray, off: np.ndarray, least: int = 1) -> Lines:
    """A line feed parts two lines, so a document has one line more than line feeds."""
    feeds = np.flatnonzero(data == 10)
    upto = np.searchsorted(feeds, off)
    docs = np.arange(len(off) - 1)
    stop, ends, doc = (np.empty(len(feeds) + len(docs), t) for t in (np.int64, np.int64, np.int64))
    of = np.repeat(docs, np.diff(upto))
    at, last = np.arange(len(feeds)) + of, upto[1:] + docs
    stop[at], ends[at], doc[at] = feeds, 1, of
    stop[last], ends[last], doc[last] = off[1:], 0, docs
    first = upto[:-1] + docs
    start = np.append(0, stop[:-1] + 1)
    start[first] = off[:-1]
    a, b = _stripped(data, start, stop)
    h = kernel.span_hashes(data, a, b)
    h[h == 0] = 1
    h[b - a < max(least, 1)] = 0
    return Lines(h, start, stop, ends, doc, first)


def without(data: np.ndarray, x: Lines, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the documents with only the lines to keep, joined by line feeds."""
    later = np.cumsum(keep[::-1])[::-1] - keep  # kept lines after each, in all documents
    beyond = np.append(x.first[1:], len(keep))
    rest = np.append(later + keep, 0)[beyond][x.doc]  # those in later documents
    flags, size = np.empty(2 * len(keep), bool), np.empty(2 * len(keep), np.int64)
    flags[::2], flags[1::2] = keep, keep & (later > rest)
    size[::2], size[1::2] = x.stop - x.start, x.ends
    kept = (size * flags).reshape(-1, 2).sum(1)
    return data[np.repeat(flags, size)], np.append(0, np.cumsum(np.add.reduceat(kept, x.first)))


_BLANK = np.zeros(256, bool)
_BLANK[[9, 11, 12, 13, 32]] = True


def _stripped(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without blanks (space, tab, carriage return, form feed, vertical tab) around."""
    a, b = a.copy(), b.copy()
    k = np.flatnonzero(a < b)
    while len(k := k[_BLANK[data[a[k]]]]):
        a[k] += 1
        k = k[a[k] < b[k]]
    k = np.flatnonzero(a < b)
    while len(k := k[_BLANK[data[b[k] - 1]]]):
        b[k] -= 1
        k = k[a[k] < b[k]]
    return a, b


def _source(docs: DataFrame, id_col: str, text_col: str, *others: F.Column) -> DataFrame:
    return docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(_LAST)).alias("place"), docs[text_col].cast("string").alias("text"), *others)


def line_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1) -> DataFrame:
    """(h, n, first): how often each line of ``least`` bytes or more, and not blank, occurs, and the smallest id that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel.frugal()
        for b in batches:
            data, off, _ = kernel.utf8(b.column(1))
            place = np.asarray(b.column(0))
            for i, j in kernel.passes(off):
                x = lines_of(data[off[i] : off[j]], off[i : j + 1] - off[i], least)
                own = np.flatnonzero(x.h)
                h, p = x.h[own].view(np.int64), place[i + x.doc[own]]
                order = np.argsort(h, kind="stable")
                h, p = h[order], p[order]
                begin = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
                n = np.diff(np.append(begin, len(h)))
                low = np.minimum.reduceat(p, begin) if len(h) else p
                yield pa.RecordBatch.from_arrays([pa.array(h[begin]), pa.array(n), pa.array(low)], names=["h", "n", "first"])

    return _source(docs, id_col, text_col).mapInArrow(run, "h long, n long, first long").groupBy("h").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


_SHARD = "shard int, sizes array<long>, bits binary, prints binary, counts binary, firsts binary"


def _print(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (kernel.mix64(h * _U(0xD6E8FEB86659FD93)) >> _U(32)).astype(np.uint32)


def _shard(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    h = np.asarray(table["h"]).view(np.uint64)
    p = PerfectHash.of(h)
    at = np.empty(len(h), np.int64)
    at[p.number(h)] = np.arange(len(h))
    counts = np.minimum(np.asarray(table["n"])[at], 0xFFFFFFFF).astype(np.uint32)
    row = [[key[0].as_py()], [p.sizes.tolist()], [p.bits.tobytes()], [_print(h[at]).tobytes()], [counts.tobytes()], [np.asarray(table["first"])[at].tobytes()]]
    return pa.table([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 4))], names=["shard", "sizes", "bits", "prints", "counts", "firsts"])


def build_index(counts: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[str, int]:
    """Folder and number of the shards, which hold all counted lines."""
    lines = written(counts, "lines")
    shards = max(1, -(-lines.count() // shard_keys))
    folder = new_folder(counts.sparkSession, "line-index")
    shard = F.pmod("h", F.lit(shards)).cast("int")
    lines.withColumn("shard", shard).groupBy("shard").applyInArrow(_shard, _SHARD).withColumn("part", F.col("shard")).write.partitionBy("part").option("compression", "zstd").parquet(folder)
    return folder, shards


class Index:
    """A task's view of an index: the shard it probed last."""

    def __init__(self, folder: str) -> None:
        self.fs, self.at = pafs.FileSystem.from_uri(folder)
        self.held, self.arrays, self.loads = None, None, 0

    def shard(self, k: int):
        """Hash, fingerprints, counts and first documents of shard k; None where it has no lines."""
        if k != self.held:
            self.held, self.arrays = k, None  # the last one's memory first
            files = [f.path for f in self.fs.get_file_info(pafs.FileSelector(f"{self.at}/part={k}", allow_not_found=True)) if f.path.endswith(".parquet")]
            if files:
                row = pa.concat_tables([pq.ParquetFile(self.fs.open_input_file(p)).read() for p in files])
                sizes, (bits, prints, counts, firsts) = row["sizes"][0].as_py(), (row[c][0].as_buffer() for c in ("bits", "prints", "counts", "firsts"))
                self.arrays = PerfectHash(np.array(sizes, np.int64), np.frombuffer(bits, np.uint8)), np.frombuffer(prints, np.uint32), np.frombuffer(counts, np.uint32), np.frombuffer(firsts, np.int64)
            self.loads += 1
        return self.arrays

    def probe(self, k: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (0 where the shard hasn't the line) and first document of each hash of shard k."""
        count, first = np.zeros(len(h), np.int64), np.full(len(h), _LAST)
        if (found := self.shard(k)) is not None:
            p, prints, counts, firsts = found
            n = p.number(h)
            ok = n >= 0
            ok[ok] = prints[n[ok]] == _print(h[ok])
            count[ok], first[ok] = counts[n[ok]], firsts[n[ok]]
        return count, first


def probes(src: DataFrame, shards: int, least: int = 1) -> DataFrame:
    """(shard, h, place, row): the distinct line hashes of each row of (place, text, row), by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel.frugal()
        for b in batches:
            data, off, _ = kernel.utf8(b.column(1))
            place, row = np.asarray(b.column(0)), np.asarray(b.column(2))
            for i, j in kernel.passes(off):
                x = lines_of(data[off[i] : off[j]], off[i : j + 1] - off[i], least)
                own = np.flatnonzero(x.h)
                h, d = x.h[own].view(np.int64), x.doc[own]
                order = np.lexsort((h, d))
                h, d = h[order], d[order]
                new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))[: len(h)]
                h, d = h[new], d[new] + i
                yield pa.RecordBatch.from_arrays([pa.array(np.mod(h, shards).astype(np.int32)), pa.array(h), pa.array(place[d]), pa.array(row[d])], names=["shard", "h", "place", "row"])

    return src.mapInArrow(run, "shard int, h long, place long, row long").hint("rebalance", "shard").sortWithinPartitions("shard")


def answers(index: Index, batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(row, h, own) of the probes of repeated lines; ``own`` where the line's first document is the probe's."""
    for b in batches:
        shard, h, place, row = (np.asarray(c) for c in b.columns)
        cut = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard))
        for i, j in zip(cut[:-1], cut[1:]):
            count, first = index.probe(int(shard[i]), h[i:j].view(np.uint64))
            often = np.flatnonzero(count > most)
            at = often + i
            yield pa.RecordBatch.from_arrays([pa.array(row[at]), pa.array(h[at]), pa.array(first[often] == place[at])], names=["row", "h", "own"])


def repeated(probed: DataFrame, folder: str, most: int) -> DataFrame:
    """(row, gone, once): for each row the hashes of which all lines go, and those of which the first stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from answers(Index(folder), batches, most)

    found = probed.mapInArrow(run, "row long, h long, own boolean")
    return found.groupBy("row").agg(F.expr("collect_set(h) FILTER (WHERE NOT own)").alias("gone"), F.expr("collect_set(h) FILTER (WHERE own)").alias("once"))


def _listed(lists: pa.Array, x: Lines) -> np.ndarray:
    """Lines whose hash is in their document's list."""
    lists = lists.fill_null([]) if lists.null_count else lists
    size, flat = np.diff(np.asarray(lists.offsets)), np.asarray(lists.flatten()).view(np.uint64)
    if not len(flat):
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        both = lambda h, d: kernel.mix64(h + d.astype(np.uint64) * _U(0xD6E8FEB86659FD93))
        own = np.flatnonzero((x.h != 0) & (size[x.doc] > 0))
        return own[np.isin(both(x.h[own], x.doc[own]), both(flat, np.repeat(np.arange(len(size)), size)))]


def kept_lines(x: Lines, gone: pa.Array, once: pa.Array) -> np.ndarray:
    """Which lines stay, given each document's lists."""
    keep = np.ones(len(x.h), bool)
    keep[_listed(gone, x)] = False
    rows = _listed(once, x)
    keep[rows] = False
    order = np.lexsort((rows, x.h[rows], x.doc[rows]))
    r = rows[order]
    new = np.append(True, (x.h[r[1:]] != x.h[r[:-1]]) | (x.doc[r[1:]] != x.doc[r[:-1]]))[: len(r)]
    keep[r[new]] = True
    return keep


def deduplicated(docs: DataFrame, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", shard_keys: int = SHARD_KEYS, least: int = 1) -> DataFrame:
    """All rows and columns of ``docs`` with lines removed from the text, and two more: ``lines_before`` and ``lines_removed``.

    Line feeds part lines. Lines are the same that agree in all bytes but blanks (space, tab, carriage
    return, form feed, vertical tab) around. One that occurs more than ``most`` times in all rows
    stays only at its first place in the row of the smallest id that has it; rows
    that share that id each keep one. Blank lines always stay, and lines under ``least`` bytes where that is given. Null ids come last. A null
    text stays null, with no lines; an empty one is one line. Texts are
    read whole; an empty table gives none. Two added columns replace any of those names.
    """
    small_batches(docs.sparkSession)
    row = F.xxhash64(F.coalesce(docs[id_col].cast("long"), F.lit(_LAST)), docs[text_col].cast("string")).alias("row")  # rows alike in both lose the same
    folder, shards = build_index(line_counts(docs, id_col, text_col, least), shard_keys)
    lost = repeated(probes(_source(docs, id_col, text_col, row), shards, least), folder, most)
    others = [c for c in docs.columns if c not in ("lines_before", "lines_removed")]
    whole = _source(docs, id_col, text_col, row, *(docs[c].alias(f"c{k}") for k, c in enumerate(others) if c != text_col)).drop("place")
    names = {c: (f"c{k}" if c != text_col else "text") for k, c in enumerate(others)}
    schema = whole.drop("row", "text").schema.add("text", "string").add("lines_before", "long").add("lines_removed", "long")
    whole = whole.join(lost, "row", "left").select("text", "gone", "once", *(c for c in whole.columns if c not in ("row", "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel.frugal()
        for b in batches:
            data, off, null = kernel.utf8(b.column(0))
            for i, j in kernel.passes(off):
                own = data[off[i] : off[j]]
                x = lines_of(own, off[i : j + 1] - off[i], least)
                keep = kept_lines(x, b.column(1).slice(i, j - i), b.column(2).slice(i, j - i))
                text, at = without(own, x, keep)
                lines = np.diff(np.append(x.first, len(keep)))
                gone = lines - np.add.reduceat(keep, x.first, dtype=np.int64)
                lines[null[i:j]] = 0
                mask = pa.array(~null[i:j]).buffers()[1] if null[i:j].any() else None
                out = pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(text), mask).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.columns[3:]), out, pa.array(lines), pa.array(gone)], names=schema.names)

    return whole.mapInArrow(run, schema).select(*(F.col(names[c]).alias(c) for c in others), "lines_before", "lines_removed")


def without_repeated_lines(docs: DataFrame, most: int = MOST, least: int = 1) -> DataFrame:
    """``docs`` with its columns after ``deduplicated``, n_chars set anew, less the rows that lost lines and have only blanks left."""
    d = deduplicated(docs, most, least=least).where("lines_removed = 0 or trim(BOTH ' \t\r\n' FROM text) <> ''")
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return d.select(*docs.columns)


def without_repeated_passages(docs: DataFrame) -> DataFrame:
    """``without_repeated_lines`` for passages, lines of PASSAGE_BYTES or more, each of which stays in one place only.

    For documents without near copies: of those it would leave the parts that differ.
    """
    return without_repeated_lines(written(docs, "documents"), 1, PASSAGE_BYTES)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text", "lines_before", "lines_removed")


OP6_SQL = f"""
WITH line AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents
), keyed AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS k FROM line
), placed AS (
  SELECT *, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS place FROM keyed
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keep), '') AS text, count(*) AS lines_before, count(*) FILTER (WHERE NOT keep) AS lines_removed
FROM (SELECT *, k = '' OR n <= {MOST} OR place = 1 AS keep FROM placed) GROUP BY doc_id
"""
