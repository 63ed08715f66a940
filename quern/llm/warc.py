"""Operator 5: WARC files, one gzip member for each record.

The reader goes through a file once, from its start: bytes arrive in blocks, an
incremental zlib decompressor ends with each member, and within the member
the header block gives the content's length. The content's digest, and of
HTTP responses also the payload's, is computed as bytes come and held against the header. Memory holds one part of a record, whatever the sizes of record and file.

The writer makes one file for each task. Only files of tasks that ended well are in its
manifest, so that a lost executor leaves no file that a reader takes.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.work import new_folder

#: Bytes read and decompressed at a time, and zlib's level in writing.
READ_BYTES, LEVEL = 1 << 20, 6
#: A longer payload comes in parts of so many bytes; and the longest that is read in one row.
PART_BYTES, ROW_BYTES = 64 << 20, 2_000_000_000

_DIGESTS = {"sha1": (hashlib.sha1, "b32"), "sha256": (hashlib.sha256, "b32"), "md5": (hashlib.md5, "b32")}


def digest(data: bytes, algorithm: str = "sha1") -> str:
    """A labelled digest as WARC headers carry it."""
    return f"{algorithm}:{base64.b32encode(_DIGESTS[algorithm][0](data).digest()).decode()}"


class _Check:
    """Bytes held against a declared digest, in base 32 or hex."""

    def __init__(self, declared: str | None) -> None:
        name, _, self.value = (declared or "").strip().partition(":")
        self.hash = _DIGESTS[name.lower()][0]() if name.lower() in _DIGESTS and self.value else None

    def add(self, data: bytes) -> None:
        if self.hash:
            self.hash.update(data)

    def right(self) -> bool | None:
        """None where no digest is declared, or of an algorithm that isn't known."""
        if self.hash is None:
            return None
        d = self.hash.digest()
        return self.value.rstrip("=").upper() == base64.b32encode(d).decode().rstrip("=") or self.value.lower() == d.hex()


def matches(declared: str, data: bytes) -> bool | None:
    """Whether data has the declared digest; None for an algorithm that isn't known."""
    c = _Check(declared)
    c.add(data)
    return c.right()


def record(kind: str, url: str, date: str, content: bytes, payload: bytes | None = None, extra: dict[str, str] | None = None, record_id: str | None = None) -> bytes:
    """One record, uncompressed."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id or uuid.uuid4().urn}", f"WARC-Date: {date}"]
    if url:
        lines.append(f"WARC-Target-URI: {url}")
    lines += [f"{k}: {v}" for k, v in (extra or {}).items()]
    lines.append(f"WARC-Block-Digest: {digest(content)}")
    if payload is not None:
        lines += [f"WARC-Payload-Digest: {digest(payload)}", "Content-Type: application/http; msgtype=response"]
    return "\r\n".join([*lines, f"Content-Length: {len(content)}", "", ""]).encode() + content + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Members:
    """The decompressed bytes of one gzip member after another."""

    def __init__(self, f: BinaryIO) -> None:
        self.f, self.left, self.at = f, b"", 0

    def more(self) -> bool:
        """Whether there is another member; then reads are from it."""
        if not self.left:
            self.left = self.f.read(READ_BYTES)
        self.z = zlib.decompressobj(31)
        self.start = self.at
        return bool(self.left)

    def some(self) -> bytes:
        """More bytes of the member; none at its end."""
        while not self.z.eof:
            if not self.left:
                self.left = self.f.read(READ_BYTES)
                if not self.left:
                    raise ValueError("the file ends within a gzip member")
            before = len(self.left)
            out = self.z.decompress(self.left, READ_BYTES)
            self.left = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            self.at += before - len(self.left)
            if out:
                return out
        return b""


class _Reading:
    """A record whose content comes bit by bit, and the rows that it makes."""

    def __init__(self, offset: int, part_bytes: int) -> None:
        self.offset, self.part_bytes, self.headers = offset, part_bytes, {}
        self.part, self.size, self.held, self.head = 0, 0, bytearray(), None
        self.checks = _Check(None), _Check(None)

    def begin(self, block: bytes) -> None:
        """Takes the header block; the last of a name counts."""
        lines = block.decode("utf-8", "replace").replace("\r\n ", " ").replace("\r\n\t", " ").split("\r\n")
        self.headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        self.checks = _Check(self.headers.get("warc-block-digest")), _Check(self.headers.get("warc-payload-digest"))
        # of an HTTP message the body is the payload: what comes before it is only looked through
        self.head = bytearray() if self.headers.get("content-type", "").lower().startswith("application/http") else None

    def add(self, data: bytes) -> Iterator[dict]:
        self.size += len(data)
        self.checks[0].add(data)
        if self.head is not None:
            self.head += data
            if (cut := self.head.find(b"\r\n\r\n")) < 0:
                del self.head[:-3]
                return
            data, self.head = bytes(self.head[cut + 4 :]), None
        self.checks[1].add(data)
        self.held += data
        while len(self.held) > self.part_bytes:
            yield self.row(bytes(self.held[: self.part_bytes])) | {"last": False}
            del self.held[: self.part_bytes]
            self.part += 1

    def row(self, payload: bytes) -> dict:
        return {"offset": self.offset, "headers": self.headers, "part": self.part, "last": True, "payload": payload, "content_length": None, "block_ok": None, "payload_ok": None, "error": None}

    def end(self, error: str | None = None) -> dict:
        """The last row, with what only the whole content tells."""
        return self.row(bytes(self.held)) | {"content_length": self.size, "block_ok": self.checks[0].right(), "payload_ok": self.checks[1].right(), "error": error}


def read_records(f: BinaryIO, part_bytes: int = PART_BYTES) -> Iterator[dict]:
    """Rows of an open file: offset, headers (lower-cased names, the last of a name counts), part, last, payload, content_length, block_ok, payload_ok, error.

    A record is one row, or several where its payload is longer than ``part_bytes``; lengths, verdicts and
    errors are in the last. A fault within a member is that record's ``error``, and the next member
    follows; where the compressed bytes are damaged or end early, no later
    record can be found, and that record is the last.
    """
    m = _Members(f)
    while m.more():
        r = _Reading(m.start, part_bytes)
        try:
            buf, cut, error = bytearray(), -1, None
            while cut < 0 and buf[:5] == b"WARC/"[: len(buf)] and (x := m.some()):
                seen = max(0, len(buf) - 3)
                buf += x
                cut = buf.find(b"\r\n\r\n", seen)
            if cut < 0 or not buf.startswith(b"WARC/"):
                error = "no WARC header block"
            else:
                r.begin(bytes(buf[:cut]))
                length = r.headers.get("content-length", "")
                if not (length.isascii() and length.isdigit()):
                    error = "no usable content length"
                else:
                    left, chunk, after = int(length), bytes(buf[cut + 4 :]), b""
                    del buf
                    while True:
                        own = chunk[:left]
                        left -= len(own)
                        after = (after + chunk[len(own) :])[:5]
                        yield from r.add(own)
                        if not (chunk := m.some()):
                            break
                    error = "content shorter than its length" if left else "record doesn't end where its length says" if after != b"\r\n\r\n" else None
            while m.some():
                pass
        except (zlib.error, ValueError) as e:
            yield r.end(f"damaged: {e}"[:200])
            return
        yield r.end(error)


_READ = "path string, offset long, warc_type string, record_id string, date string, url string, headers map<string,string>, part int, last boolean, content_length long, block_ok boolean, payload_ok boolean, payload binary, error string"
_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int32(), pa.bool_(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary(), pa.string()]


def _open(path: str) -> BinaryIO:
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return fs.open_input_file(at) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_stream(at, compression=None)


def read_warc(paths: DataFrame, path_col: str = "path", part_bytes: int = PART_BYTES) -> DataFrame:
    """One row for each record of the files named in ``paths``, each file read by one task.

    Columns: path, offset of the member in the file, warc_type, record_id,
    date, url, headers, part, last, content_length, block_ok, payload_ok, payload, error. A payload over ``part_bytes``
    comes in several rows, numbered by ``part``, of which the last has the length and verdicts. A digest that
    isn't declared, or whose algorithm isn't known, is neither right nor wrong: null. A record whose
    digest is wrong keeps its payload and has no ``error``, which is for
    framing. An empty file and an empty table have no rows; a file named twice is
    read twice; a null path is none; a path that can't be opened fails the job.
    """
    names = [x.split()[0] for x in _READ.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for path in b.column(0).to_pylist():
                with _open(path) as f:
                    for r in read_records(f, part_bytes):
                        h = r["headers"]
                        rows.append((path, r["offset"], h.get("warc-type"), h.get("warc-record-id"), h.get("warc-date"), h.get("warc-target-uri"), list(h.items()), *(r[k] for k in ("part", "last", "content_length", "block_ok", "payload_ok", "payload", "error"))))
                        held += len(r["payload"])
                        if len(rows) >= 4096 or held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=names)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=names)

    src = paths.select(F.col(path_col).cast("string").alias("path")).where("path is not null")
    return src.mapInArrow(run, _READ)


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Writes a response record for each page, a file for each task, and returns the manifest (path, records).

    The page's id is in the header WARC-Page-ID, left out where it is null; a null
    URL is left out too, and line breaks in URLs are removed. A null body is a record of type
    metadata without content, so that it isn't taken for an empty one.
    """
    src = pages.select(pages[id_col].cast("string"), pages[url_col].cast("string"), pages[body_col].cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, n, path = None, 0, f"{folder}/{uuid.uuid4().hex}.warc.gz"
        try:
            for b in batches:
                for page, url, body in zip(*(c.to_pylist() for c in b.columns)):
                    if f is None:
                        fs, at = pafs.FileSystem.from_uri(path)
                        fs.create_dir(at.rpartition("/")[0], recursive=True)
                        f = fs.open_output_stream(at, compression=None)
                    extra = {} if page is None else {"WARC-Page-ID": page}
                    url = (url or "").replace("\r", "").replace("\n", "")
                    if body is None:
                        f.write(member(record("metadata", url, "2026-01-01T00:00:00Z", b"", None, extra)))
                    else:
                        payload = body.encode()
                        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
                        f.write(member(record("response", url, "2026-01-01T00:00:00Z", http + payload, payload, extra)))
                    n += 1
        finally:
            if f is not None:
                f.close()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n])], names=["path", "records"])

    spark = pages.sparkSession
    manifest = f"{folder}/manifest"
    src.mapInArrow(run, "path string, records long").write.parquet(manifest)
    return spark.read.parquet(manifest)


def pages_through_warc(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, content_length, payload_sha1, verified) of pages written as WARC and read again.

    ``content_length`` is the payload's, in bytes; ``verified`` says that
    framing and both digests held. A null body comes back null, with length and digest null;
    null ids and URLs come back null, except that an empty URL comes back null too.
    """
    spark = pages.sparkSession
    files = write_warc(pages, new_folder(spark, "warc")).select("path")
    n = max(1, files.count())  # a row for each file
    got = read_warc(files.repartition(n, "path"), part_bytes=ROW_BYTES)  # a body that came from a row fits one
    whole = F.col("warc_type") == "response"
    return got.select(
        F.col("headers")["warc-page-id"].cast("long").alias("page_id"), "url", F.when(whole, F.col("payload").cast("string")).alias("html"), F.when(whole, F.octet_length("payload").cast("long")).alias("content_length"),
        F.when(whole, F.sha1("payload")).alias("payload_sha1"), (F.col("error").isNull() & F.col("block_ok") & F.coalesce("payload_ok", ~whole)).alias("verified"),
    )


def op5_warc_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_through_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP5_SQL = "SELECT page_id, url, html, octet_length(encode(html)) AS content_length, sha1(html) AS payload_sha1, true AS verified FROM pages"
