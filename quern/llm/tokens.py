"""Byte-level BPE of whole Arrow columns, with each distinct word encoded once.

A whitespace character after any other always begins a new piece of the
vocabulary's pattern, so a text may be cut there and its parts encoded apart:
the ids are those of the whole text. A direct-mapped table in each worker,
keyed by a 64-bit hash of the part, holds the ids of parts seen before.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken

from quern.llm import kernel

#: Rank file of a byte-level BPE vocabulary of at most 65,535 ids; its size is the id of the end of a document.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Slots of a worker's table, and ids that it holds before it begins anew.
SLOTS, HELD = 1 << 21, 1 << 23
PASS_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLAIN = np.ones(256, bool)
_PLAIN[:33] = _PLAIN[127] = False
_WIDE_SPACE = "[\u0085   -     　]"


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    """The rank file, to be sent to the workers (under a MB)."""
    with open(path, "rb") as f:
        return f.read()


class Tokenizer:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: bytes) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.eos = len(ranks)
        self.bpe = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        by_id = [b for b, _ in sorted(ranks.items(), key=lambda x: x[1])] + [b""]
        self.size = np.array([len(b) for b in by_id], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.all = np.frombuffer(b"".join(by_id), np.uint8)
        self._clear()

    def _clear(self) -> None:
        self.key = np.zeros(SLOTS, np.uint64)
        self.at = np.zeros(SLOTS, np.int32)
        self.count = np.zeros(SLOTS, np.int32)
        self.ids = np.zeros(1 << 20, np.uint16)
        self.used = 0

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where each part's begin and how many they are; all parts that allow it go through the encoder as one text."""
        last = data[ends - 1]
        regular = _SPACE[data[starts]] & ~_SPACE[last] & (last < 0x80)
        begin, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        rows = np.flatnonzero(regular)
        n = ends[rows] - starts[rows]
        stop = np.cumsum(n)
        joined = data[np.repeat(starts[rows] - (stop - n), n) + np.arange(n.sum())].tobytes()
        ids = [np.array(self.bpe.encode_ordinary(joined.decode()), np.uint16)]
        cut = np.searchsorted(np.cumsum(self.size[ids[0]]), stop) + 1
        begin[rows], count[rows] = np.append(0, cut)[:-1], np.diff(cut, prepend=0)
        at = len(ids[0])
        for k in np.flatnonzero(~regular):
            ids.append(np.array(self.bpe.encode_ordinary(data[starts[k] : ends[k]].tobytes().decode()), np.uint16))
            begin[k], count[k] = at, len(ids[-1])
            at += count[k]
        return np.concatenate(ids), begin, count

    def _parts(self, data: np.ndarray, off: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and the first part of each document (n + 1)."""
        space = _SPACE[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = space[1:] & _PLAIN[data[:-1]]
        for k in np.flatnonzero(whole):
            cut[off[k] : off[k + 1]] = False
        cut[off[:-1][np.diff(off) > 0]] = True
        starts = np.flatnonzero(cut[:-1])
        first = np.searchsorted(starts, off)
        return starts, np.append(starts[1:], len(data)), first

    def _look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Slot of each part, after the parts that the table lacked were encoded.

        Parts that need a slot another part of the call holds come back as -1 - k
        for the k-th of ``self.extra``.
        """
        h = kernel.span_hashes(data, starts, ends) | np.uint64(1)
        slot = (h >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)
        miss = np.flatnonzero(self.key[slot] != h)
        self.extra = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if len(miss):
            _, first, inv = np.unique(h[miss], return_index=True, return_inverse=True)
            new = miss[first]
            flat, at, count = self._encode(data, starts[new], ends[new])
            if self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), np.uint16)])
            at += self.used
            self.ids[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
            self.extra = (at, count)
            hit = np.ones(len(h), bool)
            hit[miss] = False
            busy = np.zeros(SLOTS, bool)
            busy[slot[hit]] = True
            free = np.flatnonzero(~busy[slot[new]])
            s = slot[new[free]]
            self.key[s], self.at[s], self.count[s] = h[new[free]], at[free], count[free]
            slot[miss] = -1 - inv
        return slot

    def encode(self, text: pa.Array | pa.ChunkedArray):
        """(documents from, to, ids, offsets) of each pass over the column; a null has no ids."""
        wide = np.asarray(pc.fill_null(pc.match_substring_regex(text, _WIDE_SPACE), False))
        data, off, _ = kernel.utf8(text)
        for i, j in kernel.passes(off, PASS_BYTES):
            if self.used > HELD:
                self._clear()
            ids, counts = self._pass(data[off[i] : off[j]], off[i : j + 1] - off[i], wide[i:j])
            yield i, j, ids, counts

    def _pass(self, data: np.ndarray, off: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint16), np.zeros(len(off), np.int64)
        starts, ends, first = self._parts(data, off, wide)
        slot = self._look_up(data, starts, ends)
        old, (at, n) = slot >= 0, self.extra
        begin, count = np.empty(len(slot), np.int64), np.empty(len(slot), np.int64)
        begin[old], count[old] = self.at[slot[old]], self.count[slot[old]]
        begin[~old], count[~old] = at[-1 - slot[~old]], n[-1 - slot[~old]]
        end = np.cumsum(count)
        where = np.repeat(begin - (end - count), count) + np.arange(end[-1])
        return self.ids[where], np.append(0, end)[first]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids; the end of a document has none."""
        n = self.size[ids]
        end = np.cumsum(n)
        return self.all[np.repeat(self.begin[ids] - (end - n), n) + np.arange(end[-1] if len(end) else 0)].tobytes()


_held: dict[int, Tokenizer] = {}


def tokenizer(vocabulary: bytes) -> Tokenizer:
    """This worker's encoder of the vocabulary, with its table."""
    kernel.frugal()
    key = hash(vocabulary)
    if key not in _held:
        _held.clear()
        _held[key] = Tokenizer(vocabulary)
    return _held[key]
