r"""Operator 9: secret scans through nested encodings.

A text is the first layer on a worklist. Each layer is scanned by all rules, and then
unwrapped: percent escapes and Unicode escapes (\uXXXX, \xXX, &#N;) are decoded in
place, so that what stands around them stays context; runs of base64, of any data that
has a mark once decoded and decompressed, become layers of their own. New layers join the list until none is left; decompressed ones do in pieces. A
layer whose text was seen in the document is not taken again, which ends cycles.
Every character of a layer knows the characters of the document that it came from, so a finding
at any depth is given as a span of the document.

Most documents have nothing to find. RE2 passes over the Arrow column tell which
may have a rule's mark or an encoded run, and Python sees only those.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, tee

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.work import small_batches

#: The shortest run taken for base64.
BASE64_RUN = 20
#: Compressed data is unfolded and scanned in pieces of so many bytes, each with so many of the one before.
PIECE_BYTES, OVERLAP_BYTES = 16 << 20, 1 << 20
#: The shortest line of a blob wrapped to lines.
WRAPPED_RUN = 8
_RUN, _BREAK = "[A-Za-z0-9+/_-]", r"\r?\n[ \t]*"

#: Rules by kind. A group named v is the secret; else the whole match is. The mark is an RE2 expression that any match contains.
RULES = [
    ("aws_access_key", "(?:AKIA|ASIA)[0-9A-Z]{16}", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"),
    ("github_token", "gh[pousr]_[A-Za-z0-9]{36}", r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}"),
    ("slack_token", "xox[abprs]-", r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}"),
    ("google_api_key", "AIza", r"(?<![A-Za-z0-9])AIza[0-9A-Za-z_-]{35}(?![A-Za-z0-9_-])"),
    ("secret_key", "sk[-_]", r"(?<![A-Za-z0-9])(?:sk-|sk_live_|sk_test_)[A-Za-z0-9_-]{16,}"),
    ("json_web_token", "eyJ", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("private_key", "PRIVATE KEY-----", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
    ("bearer_token", "(?i:bearer)", r"(?i:(?<![A-Za-z0-9])bearer\s+)(?P<v>[A-Za-z0-9._~+/-]{16,}=*)"),
    ("url_password", "://", r"(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9+.-]{0,30}://[^\s/:@?#]{1,256}:(?P<v>[^\s/@?#]{1,256})@"),
    ("assigned_secret", r"""(?i:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)["']?\s*[:=]""", r"""(?i:(?<![A-Za-z0-9])[A-Za-z0-9_-]{0,64}(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key))["']?\s*[:=]\s*["']?(?P<v>[A-Za-z0-9_/+.=-]{16,})"""),
]
_RULES = [(kind, re.compile(rule)) for kind, _, rule in RULES]
_ANY_RULE = "|".join(f"(?:{mark})" for _, mark, _ in RULES)
_ANY_LAYER = rf"%[0-9A-Fa-f][0-9A-Fa-f]|\\[ux][0-9A-Fa-f{{]|&#[0-9xX]|{_RUN}{{{BASE64_RUN}}}|{_RUN}{{{WRAPPED_RUN}}}{_BREAK}{_RUN}"

_MAY = re.compile(f"{_ANY_RULE}|{_ANY_LAYER}")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
_BASE64 = re.compile(rf"{_RUN}{{{BASE64_RUN},}}={{0,2}}")
_WRAPPED = re.compile(rf"(?<!{_RUN}){_RUN}{{{WRAPPED_RUN},}}+(?:{_BREAK}{_RUN}++)+={{0,2}}")
_PART = re.compile(rf"[A-Za-z0-9+]{{{BASE64_RUN},}}")
_LINE = re.compile(rf"{_RUN}+={{0,2}}")
#: The rules where text starts that is glued to what stands before.
_GLUED = [(kind, re.compile(re.sub(r"\(\?<![^)]*\)", "", rule))) for kind, _, rule in RULES]
#: How compressed data begins.
_MAGIC = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00")


class Layer:
    """A text with, for each character, where in the document its source begins and ends."""

    def __init__(self, text: str, begin: np.ndarray, end: np.ndarray, path: tuple[str, ...], cuts: Iterable[int] = ()) -> None:
        self.text, self.begin, self.end, self.path = text, begin, end, path
        self.cuts = cuts  # where text may start, whatever stands before

    def span(self, a: int, b: int) -> tuple[int, int]:
        return int(self.begin[a:b].min()), int(self.end[a:b].max())


def _in_place(layer: Layer, name: str, found: list[tuple[int, int, str, list[int]]]) -> Layer:
    """The layer with spans (from, to) replaced; the last element gives how many characters each new one stems from."""
    text, begin, end, at = [], [], [], 0
    for a, b, new, sizes in found:
        text += [layer.text[at:a], new]
        begin.append(layer.begin[at:a])
        end.append(layer.end[at:a])
        stop = a + np.cumsum(sizes)
        begin.append(layer.begin[stop - sizes])
        end.append(layer.end[stop - 1])
        at = b
    text.append(layer.text[at:])
    return Layer("".join(text), np.concatenate([*begin, layer.begin[at:]]), np.concatenate([*end, layer.end[at:]]), (*layer.path, name))


def _percent(layer: Layer) -> Layer | None:
    found = []
    for m in _PERCENT.finditer(layer.text):
        try:
            new = bytes.fromhex(m[0].replace("%", "")).decode()
        except UnicodeDecodeError:
            continue
        found.append((m.start(), m.end(), new, [3 * len(c.encode()) for c in new]))
    return _in_place(layer, "url", found) if found else None


def _unicode(layer: Layer) -> Layer | None:
    found, skip = [], -1
    for m in _UNICODE.finditer(layer.text):
        if m.start() < skip:
            continue
        code, stop = int(m[4]) if m[4] else int(m[1] or m[2] or m[3] or m[5], 16), m.end()
        if 0xD800 <= code < 0xDC00 and m[1] and (low := re.compile(r"\\u([dD][c-fC-F][0-9A-Fa-f]{2})").match(layer.text, stop)):
            code, stop = 0x10000 + ((code - 0xD800) << 10) + int(low[1], 16) - 0xDC00, low.end()
        if code > 0x10FFFF or 0xD800 <= code < 0xE000:
            continue
        found.append((m.start(), stop, chr(code), [stop - m.start()]))
        skip = stop
    return _in_place(layer, "unicode", found) if found else None


def _text(data: bytes) -> tuple[str, np.ndarray]:
    """The data as UTF-8, where a byte that isn't stays as a lone surrogate, and the size of each character."""
    text = data.decode("utf-8", "surrogateescape")
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
    size[(c >= 0xDC80) & (c < 0xDD00)] = 1
    return text, size


def _views(data: bytes) -> Iterator[tuple[str, np.ndarray, int]]:
    """Texts that the data may be, sizes of their characters in bytes, and the byte at which they begin: UTF-8, and UTF-16 where much of it is zero bytes."""
    yield *_text(data), 0
    if data.count(0) * 4 >= len(data) > 3:
        for at, kind in ((0, "utf-16-le"), (0, "utf-16-be"), (1, "utf-16-le"), (1, "utf-16-be")):
            text = data[at : len(data) - (len(data) - at) % 2].decode(kind, "replace")
            c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            size = 2 + 2 * (c >= 0x10000)
            if int(size.sum()) <= len(data) - at:
                yield text, size, at


class _Zlib:
    """zlib and gzip data with the methods of the other decompressors."""

    def __init__(self, bits: int) -> None:
        self.d, self.full = zlib.decompressobj(bits), False

    def decompress(self, data: bytes, most: int) -> bytes:
        out = self.d.decompress(self.d.unconsumed_tail + data, most)
        self.full = len(out) == most
        return out

    @property
    def eof(self) -> bool:
        return self.d.eof

    @property
    def unused_data(self) -> bytes:
        return self.d.unused_data

    @property
    def needs_input(self) -> bool:
        return not self.d.eof and not self.full and not self.d.unconsumed_tail


_OPENERS = [("gzip", b"\x1f\x8b", lambda: _Zlib(31)), ("zlib", b"x", lambda: _Zlib(15)), ("bzip2", b"BZh", bz2.BZ2Decompressor), ("xz", b"\xfd7zXZ", lzma.LZMADecompressor)]


def _members(chunks: Iterable[bytes], magic: bytes, opener, rest: list[int]) -> Iterator[bytes]:
    """What all members of compressed data hold, up to an error; ``rest`` gets how many bytes of the last chunk follow them."""
    d = opener()
    for chunk in chunks:
        while True:
            if d.eof:
                if not chunk:
                    break
                if chunk[: len(magic)] != magic[: len(chunk)]:
                    return
                d = opener()
            try:
                out = d.decompress(chunk, OVERLAP_BYTES)
            except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError):
                return
            chunk = b""
            if out:
                yield out
            if d.eof:
                chunk = d.unused_data
                rest[0] = len(chunk)
            elif d.needs_input:
                break


def unfolded(chunks: Iterable[bytes], rest: list[int]) -> tuple[list[str], Iterator[bytes]]:
    """Names of the compressed layers around data, and what is in the innermost, bit by bit."""
    names: list[str] = []
    while True:
        chunks = iter(chunks)
        head = next(chunks, b"")
        while 0 < len(head) < 16 and (more := next(chunks, b"")):
            head += more
        chunks = chain([head], chunks)
        for name, magic, opener in _OPENERS if _MAGIC.match(head) else ():
            if head.startswith(magic):
                kept, chunks = tee(chunks) if names else ((head,), chunks)
                inner = _members(chunks, magic, opener, [0] if names else rest)
                if first := next(inner, b""):
                    names.append(name)
                    chunks = chain([first], inner)
                    break
                return names, iter(kept)
        else:
            return names, chunks


def _pieces(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The data in pieces that overlap, cut at blanks where there are any."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        while len(held) >= PIECE_BYTES:
            low = PIECE_BYTES - OVERLAP_BYTES
            stop = max(held.rfind(b" ", low, PIECE_BYTES), held.rfind(b"\n", low, PIECE_BYTES))
            stop = PIECE_BYTES if stop < 0 else stop
            yield bytes(held[:stop])
            back = max(1, stop - OVERLAP_BYTES)
            start = max(held.rfind(b" ", 1, back), held.rfind(b"\n", 1, back))
            del held[: start if start > back - OVERLAP_BYTES and start > 0 else back]
    if held:
        yield bytes(held)


def _runs(text: str) -> Iterator[tuple[np.ndarray, list[int]]]:
    """Places of the characters of each run that may be base64, and where in it what is encoded may start, after glued text."""

    def run(spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[int]]:
        places = np.concatenate([np.arange(a, b) for a, b in spans])
        cuts = np.flatnonzero([text[k] in "/-_" for k in places]) + 1
        return places, [*cuts.tolist(), *np.cumsum([b - a for a, b in spans])[:-1].tolist()]

    for m in _WRAPPED.finditer(text):
        lines = [x.span() for x in _LINE.finditer(text, *m.span())]
        size = [b - a for a, b in lines]
        at = 0
        while at < len(lines) - 1:
            # lines of one width, but for the first, which may have text before it, and a shorter last one
            stop = at + 2
            while stop < len(lines) and size[stop] <= size[stop - 1] == size[at + 1]:
                stop += 1
            yield run(lines[at:stop])
            if stop - at > 2 or size[stop - 1] < size[at]:  # the last may be a word that follows
                yield run(lines[at : stop - 1])
            at = stop - 1
    for m in _BASE64.finditer(text):
        yield run([m.span()])
        if m[0].rstrip("=").translate(_NO_GLUE) != m[0].rstrip("="):
            yield from (run([part.span()]) for part in _PART.finditer(text, *m.span()))


_NO_GLUE = str.maketrans("", "", "/-_")


def _starts(text: str, first: np.ndarray, cuts: list[int]) -> list[int]:
    """Characters at which what is encoded may start: the given bytes, and each group of three soon after the start or what is no text."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    bad = ((c < 32) & ~np.isin(c, (9, 10, 12, 13, 27))) | ((c >= 127) & (c < 160)) | ((c >= 0xDC80) & (c < 0xDD00))
    last = np.maximum.accumulate(np.where(bad, np.arange(len(c)), -1)) if len(c) else np.zeros(0, int)
    soon = np.arange(len(c)) - last <= 12
    return np.flatnonzero(((first % 3 == 0) & soon) | np.isin(first, cuts)).tolist()


def _base64(layer: Layer) -> Iterator[Layer]:
    done: set[int] = set()  # where compressed data begins that was taken from a longer run
    for places, cuts in _runs(layer.text):
        run = "".join([layer.text[k] for k in places]) if places[-1] - places[0] >= len(places) else layer.text[places[0] : places[-1] + 1]
        run = run.rstrip("=")
        # what stands before a run without a break can shift it: all four phases are tried, and what isn't text is passed over
        for shift in range(4):
            core = run[shift:]
            core = core[: len(core) - (len(core) % 4 == 1)]
            if len(core) < BASE64_RUN - 3:
                break
            try:
                data = base64.urlsafe_b64decode(core.replace("+", "-").replace("/", "_") + "=" * (-len(core) % 4))
            except (binascii.Error, ValueError):
                continue
            own = places[shift : shift + len(core)]
            for text, size, at in _views(data):
                if not _MAY.search(text):
                    continue
                stop = np.cumsum(size) + at
                begin = layer.begin[own[(stop - size) * 4 // 3]]
                end = layer.end[own[np.minimum(-(-stop * 4 // 3), len(own)) - 1]]
                starts = _starts(text, stop - size, [(k - shift) // 4 * 3 for k in cuts if k >= shift and (k - shift) % 4 == 0])
                yield Layer(text, begin, end, (*layer.path, "base64"), starts)
            at = 0
            while (m := _MAGIC.search(data, at)) is not None:
                at = m.start() + 1
                rest = [-1]
                if (start := int(own[m.start() * 4 // 3])) in done:
                    continue
                names, inner = unfolded([data[m.start() :]], rest)
                if not names:
                    continue
                done.add(start)
                for piece in _pieces(inner):
                    for text, _, _ in _views(piece):
                        if not _MAY.search(text):
                            continue
                        # any part may stem from any other
                        part = own[m.start() * 4 // 3 : -(-(len(data) - max(rest[0], 0)) * 4 // 3)]
                        begin = np.broadcast_to(layer.begin[part].min(), len(text))
                        end = np.broadcast_to(layer.end[part].max(), len(text))
                        yield Layer(text, begin, end, (*layer.path, "base64", *names))
                at = max(at, len(data) - rest[0]) if rest[0] >= 0 else at


def _inner(layer: Layer) -> Iterator[Layer]:
    """The layers in a layer."""
    yield from (x for f in (_percent, _unicode) if (x := f(layer)) is not None)
    yield from _base64(layer)


def scan(text: str) -> list[tuple[str, int, int, tuple[str, ...], str]]:
    """(kind, start, stop, layers, secret) of a text's findings, each at its shallowest layer, by place."""
    places = np.arange(len(text) + 1)
    # the newest layers first, so that of a long one few pieces are held
    work, seen, found = [iter([Layer(text, places[:-1], places[1:], ())])], {}, {}

    def add(key: tuple, path: tuple[str, ...]) -> None:
        if key not in found or len(path) < len(found[key]):
            found[key] = path

    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
            continue
        mark = (hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), int(layer.begin[0]) if len(layer.begin) else 0)
        if seen.get(mark, len(layer.path) + 1) <= len(layer.path):
            continue
        seen[mark] = len(layer.path)
        for kind, rule in _RULES:
            for m in rule.finditer(layer.text):
                a, b = m.span("v") if "v" in rule.groupindex else m.span()
                add((kind, *layer.span(a, b), layer.text[a:b]), layer.path)
        for kind, rule in _GLUED if layer.cuts else ():
            for m in filter(None, (rule.match(layer.text, at) for at in layer.cuts)):
                a, b = m.span("v") if "v" in rule.groupindex else m.span()
                add((kind, *layer.span(a, b), layer.text[a:b]), layer.path)
        work.append(_inner(layer))
    return sorted((kind, a, b, path, value) for (kind, a, b, value), path in found.items())


_FOUND = "doc_id long, kind string, start long, stop long, layers array<string>, secret_sha256 string"


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, start, stop, layers, secret_sha256): one row for each secret and place.

    ``start`` and ``stop`` are characters of the document, ``layers`` the encodings around the secret from the outside, and the secret
    itself is never given out, only its SHA-256. Null and empty texts have none. Repeated
    rows give theirs each; a null id stays null. Texts are read whole, whatever their length. Other columns aren't read. An empty table has none.
    """

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(1)
            may = pc.or_(pc.match_substring_regex(text, _ANY_RULE), pc.match_substring_regex(text, _ANY_LAYER))
            rows = np.flatnonzero(np.asarray(pc.fill_null(may, False)))
            out: list[tuple] = []
            for k, one in zip(rows, text.take(pa.array(rows)).to_pylist()):
                out += [(k, *x) for x in scan(one)]
            if out:
                at, kind, start, stop, layers, value = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at)), pa.array(kind), pa.array(start, pa.int64()), pa.array(stop, pa.int64()), pa.array([list(x) for x in layers], pa.list_(pa.string())), pa.array([hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest() for v in value])],
                    names=[x.split()[0] for x in _FOUND.split(", ")],
                )

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, _FOUND)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
