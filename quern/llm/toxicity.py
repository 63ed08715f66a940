"""Operator 10: toxicity by a bidirectional gated recurrent network.

A document's words are cut into windows of ``WINDOW`` words that overlap by
``WINDOW - STRIDE``. A word's input joins a word embedding with the mean of
its character 4- and 5-gram embeddings, and with how much more often its
grams, and the word, occur in toxic documents. A gated recurrent network reads
each window in both directions, attention pools its states, and the highest
window decides over the document. Everything is trained here, in numpy, on a
bounded sample of labelled documents; only documents carry labels, so each
epoch learns from the windows that score highest in their documents.

Inputs depend on the word alone. So each pass over about a megabyte of text
computes the gates' input projection once for each distinct word, and the
recurrence runs over all windows at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import kernel
from quern.llm.work import small_batches, written

WINDOW, STRIDE = 64, 48
HIDDEN, CHAR_DIM, WORD_DIM = 16, 8, 8
BUCKETS = 1 << 15
#: At most so many labelled documents of each class train the network, and so many bytes of their texts.
MAX_TOXIC, MAX_CLEAN, MAX_BYTES = 1500, 2500, 12 << 20
EPOCHS, BATCH, RATE = 8, 64, 0.01

_IN = CHAR_DIM + 2 + WORD_DIM + 1
_G = 3 * HIDDEN
_TAB = (kernel.random_table(31, 5 * 256) >> np.uint64(32)).astype(np.uint32).reshape(5, 256)


@dataclass
class Words:
    """Distinct words of a pass, and the windows of its documents over them."""

    bucket: np.ndarray  # of each word
    grams: np.ndarray  # bucket of each character gram, by word
    gram_word: np.ndarray
    ids: np.ndarray  # (windows, WINDOW), a word's number
    length: np.ndarray  # of each window
    doc: np.ndarray  # of each window


def _grams(low: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = e - s + 2
    end = np.cumsum(n)
    begin = end - n
    buf = np.empty(int(end[-1]), np.uint8)
    word = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(buf)) - begin[word]
    buf[:] = low[np.clip(s[word] + place - 1, 0, len(low) - 1)]
    buf[begin], buf[end - 1] = 94, 36
    pad = np.concatenate([buf, np.zeros(4, np.uint8)])
    h = _TAB[0][buf]
    for k in range(1, 4):
        h = h ^ _TAB[k][pad[k : k + len(buf)]]
    left = n[word] - place
    five = h ^ _TAB[4][pad[4 : 4 + len(buf)]] ^ np.uint32(0x5BD1E995)
    a, b = np.flatnonzero(left >= 4), np.flatnonzero(left >= 5)
    g, w = np.concatenate([h[a], five[b]]), np.concatenate([word[a], word[b]])
    order = np.argsort(w, kind="stable")
    return (g[order] & np.uint32(BUCKETS - 1)).astype(np.int32), w[order]


def read(data: np.ndarray, off: np.ndarray) -> Words | None:
    """Words and windows of lower-cased texts; None where there are no words."""
    low, s, e, first = kernel.words(data, off)
    if not len(s):
        return None
    h = kernel.span_hashes(low, s, e)
    uniq, at, inv = np.unique(h, return_index=True, return_inverse=True)
    grams, gram_word = _grams(low, s[at], e[at])
    count = np.diff(first)
    windows = np.where(count > WINDOW, 1 + -(-(count - WINDOW) // STRIDE), np.minimum(count, 1))
    doc = np.repeat(np.arange(len(count)), windows)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = k * STRIDE
    length = np.minimum(WINDOW, count[doc] - start)
    inv = inv.astype(np.int32)
    ids = np.empty((len(doc), WINDOW), np.int32)
    for i in range(0, len(doc), 4096):  # some windows at a time
        at = (first[:-1][doc[i : i + 4096]] + start[i : i + 4096])[:, None] + np.arange(WINDOW)
        ids[i : i + 4096] = inv[np.minimum(at, len(inv) - 1)]
    return Words((uniq & np.uint64(BUCKETS - 1)).astype(np.int32), grams, gram_word.astype(np.int32), ids, length, doc)


def _gram_bounds(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Words that have grams, and where their grams begin."""
    count = np.bincount(w.gram_word, minlength=len(w.bucket))
    has = np.flatnonzero(count)
    return has, (np.cumsum(count) - count)[has]


def inputs(m: dict, w: Words) -> np.ndarray:
    """(words, _IN) inputs of the network."""
    x = np.zeros((len(w.bucket), _IN), np.float32)
    has, begin = _gram_bounds(w)
    stop = np.append(begin[1:], len(w.grams))
    for i in range(0, len(has), 1 << 14):  # some words at a time, since each has many grams
        own, first = has[i : i + (1 << 14)], begin[i : i + (1 << 14)]
        grams = w.grams[first[0] : stop[i : i + (1 << 14)][-1]]
        n = (stop[i : i + (1 << 14)] - first)[:, None].astype(np.float32)
        first = first - first[0]
        x[own, :CHAR_DIM] = np.add.reduceat(m["char"][grams], first, axis=0) / n
        odds = m["gram_odds"][grams]
        x[own, CHAR_DIM] = np.add.reduceat(odds, first) / n[:, 0]
        x[own, CHAR_DIM + 1] = np.maximum.reduceat(odds, first)
    x[:, CHAR_DIM + 2 : -1] = m["word"][w.bucket]
    x[:, -1] = m["word_odds"][w.bucket]
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _run(p: np.ndarray, u: np.ndarray, ids: np.ndarray, mask: np.ndarray | None, backward: bool, keep: list | None) -> np.ndarray:
    """States (WINDOW, windows, HIDDEN) of one direction; ``keep`` takes what the gradient needs."""
    steps = ids.shape[1]
    out = np.empty((steps, len(ids), HIDDEN), p.dtype)
    h = np.zeros((len(ids), HIDDEN), p.dtype)
    for t in range(steps - 1, -1, -1) if backward else range(steps):
        g, a = p[ids[:, t]], h @ u
        zr = _sigmoid(g[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(g[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
        new = n + z * (h - n)
        if backward:
            new *= mask[:, t, None]
        if keep is not None:
            keep.append((t, h, z, r, n, a[:, 2 * HIDDEN :]))
        out[t] = h = new
    return out


def projected(m: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the words give the gates of either direction."""
    return tuple(x @ m["wx"][:, c] + m["b"][c] for c in (slice(0, _G), slice(_G, None)))


def logits(m: dict, x: np.ndarray, w: Words, size: int = 1024) -> np.ndarray:
    """A logit for each window, ``size`` of them at a time."""
    p = projected(m, x)
    return np.concatenate([forward(m, p, w, slice(i, i + size)) for i in range(0, len(w.ids), size)])


def forward(m: dict, p: tuple[np.ndarray, np.ndarray], w: Words, rows: np.ndarray | slice = slice(None), keep: dict | None = None) -> np.ndarray:
    """A logit for each window of ``rows``, given what is projected of the words."""
    ids, length = w.ids[rows], w.length[rows]
    mask = np.arange(ids.shape[1]) < length[:, None]
    kf, kb = ([], []) if keep is not None else (None, None)
    hf = _run(p[0], m["uf"], ids, None, False, kf)
    hb = _run(p[1], m["ub"], ids, mask.astype(p[1].dtype), True, kb)
    s = hf @ m["v"][:HIDDEN] + hb @ m["v"][HIDDEN:]
    s[~mask.T] = -np.inf
    s -= s.max(0)
    a = np.exp(s)
    a /= a.sum(0)
    pooled = np.concatenate([np.einsum("tn,tnh->nh", a, hf), np.einsum("tn,tnh->nh", a, hb)], 1)
    if keep is not None:
        keep |= {"ids": ids, "mask": mask, "f": kf, "b": kb, "hf": hf, "hb": hb, "a": a, "pooled": pooled}
    return pooled @ m["o"] + m["ob"]


def _summed(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that rows belong at, and the sum of each one's."""
    if not len(at):
        return np.zeros(0, np.int64), rows[:0]
    order = np.argsort(at, kind="stable")
    at = at[order]
    begin = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return at[begin], np.add.reduceat(rows[order], begin)


def gradient(m: dict, x: np.ndarray, w: Words, k: dict, d: np.ndarray) -> dict:
    """Gradients of the parameters, for the loss's gradients ``d`` by logit; of embeddings the rows that have one, and theirs."""
    out = {"o": k["pooled"].T @ d, "ob": d.sum(keepdims=True)[0]}
    dp = d[:, None] * m["o"]
    dpx, dx, dv = np.zeros((len(x), 2 * _G), x.dtype), None, []
    da = np.einsum("nh,tnh->tn", dp[:, :HIDDEN], k["hf"]) + np.einsum("nh,tnh->tn", dp[:, HIDDEN:], k["hb"])
    ds = k["a"] * (da - (k["a"] * da).sum(0))
    for side, states in (("f", k["hf"]), ("b", k["hb"])):
        part = slice(0, HIDDEN) if side == "f" else slice(HIDDEN, None)
        dv.append(np.einsum("tn,tnh->h", ds, states))
        dh_all = k["a"][:, :, None] * dp[None, :, part] + ds[:, :, None] * m["v"][part]
        u, du, dh = m["u" + side], np.zeros_like(m["u" + side]), np.zeros_like(states[0])
        each = np.empty((k["ids"].shape[1], len(dh), _G), x.dtype)
        cols = slice(0, _G) if side == "f" else slice(_G, None)
        for t, h, z, r, n, an in reversed(k[side]):
            dh = dh + dh_all[t]
            if side == "b":
                dh = dh * k["mask"][:, t, None]
            dg = each[t]
            dn = dh * (1 - z) * (1 - n * n)
            dg[:, :HIDDEN] = dh * (h - n) * z * (1 - z)
            dg[:, HIDDEN : 2 * HIDDEN] = dn * an * r * (1 - r)
            dg[:, 2 * HIDDEN :] = dn
            through = dg.copy()
            through[:, 2 * HIDDEN :] *= r
            du += h.T @ through
            dh = dh * z + through @ u.T
        at, own = _summed(k["ids"].T.ravel(), each.reshape(-1, _G))
        dpx[at, cols] = own
        out["u" + side] = du
    out["v"] = np.concatenate(dv)
    out["wx"], out["b"] = x.T @ dpx, dpx.sum(0)
    dx = dpx @ m["wx"].T
    out["word"] = _summed(w.bucket, dx[:, CHAR_DIM + 2 : -1])
    n = np.maximum(np.bincount(w.gram_word, minlength=len(w.bucket)), 1)
    out["char"] = _summed(w.grams, (dx[:, :CHAR_DIM] / n[:, None])[w.gram_word])
    return out


def new_model(seed: int = 0) -> dict:
    r = np.random.default_rng(seed)
    f = lambda *shape, s=0.1: (r.standard_normal(shape) * s).astype(np.float32)
    return {
        "char": f(BUCKETS, CHAR_DIM, s=0.05), "word": f(BUCKETS, WORD_DIM, s=0.05), "gram_odds": np.zeros(BUCKETS, np.float32), "word_odds": np.zeros(BUCKETS, np.float32),
        "wx": f(_IN, 2 * _G, s=0.3), "b": np.zeros(2 * _G, np.float32), "uf": f(HIDDEN, _G, s=0.2), "ub": f(HIDDEN, _G, s=0.2), "v": f(2 * HIDDEN), "o": f(2 * HIDDEN, s=0.3), "ob": np.zeros((), np.float32), "threshold": np.float32(np.inf),
    }


def _odds(parts: Iterable[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, weight: float = 3.0) -> np.ndarray:
    """Log odds of toxicity given a bucket's presence, less those of all documents; a third of it.

    Parts are (bucket, document) pairs; no document is in two parts.
    """
    t, n = np.zeros(BUCKETS), np.zeros(BUCKETS, np.int64)
    for bucket, doc in parts:
        pair = np.unique(doc.astype(np.int64) * BUCKETS + bucket)
        b, y = pair % BUCKETS, toxic[pair // BUCKETS]
        t += np.bincount(b, y, BUCKETS)
        n += np.bincount(b, minlength=BUCKETS)
    base = toxic.mean()
    share = (t + weight * base) / (n + weight)
    return ((np.log(share / (1 - share)) - np.log(base / (1 - base))) / 3).astype(np.float32)


def _gram_parts(w: Words, doc: np.ndarray, word: np.ndarray, pairs: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams of the words of some documents at a time; pairs of document and word are sorted by document."""
    count = np.bincount(w.gram_word, minlength=len(w.bucket))
    first = np.cumsum(count) - count
    i = 0
    while i < len(doc):
        j = int(np.searchsorted(doc, doc[min(i + pairs, len(doc)) - 1], side="right"))
        n, begin = count[word[i:j]], first[word[i:j]]
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield w.grams[at], np.repeat(doc[i:j], n)
        i = j


def _arrow(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data, off, _ = kernel.utf8(pc.utf8_lower(pa.array(texts, pa.string())))
    return data, off


def train(texts: list[str], toxic: np.ndarray, epochs: int = EPOCHS, seed: int = 0, labelled: tuple[int, int] | None = None) -> dict:
    """A model from labelled texts. Without documents of both classes it finds nothing toxic.

    ``labelled`` is how many clean and toxic documents the sample stands for. The threshold is
    of the best F1 over as many, so that it doesn't depend on how the sample was drawn.

    One half of the documents gives the odds, the other trains the network, so
    that the network learns how far to trust odds of documents it hasn't seen.
    """
    m, r = new_model(seed), np.random.default_rng(seed)
    toxic = np.asarray(toxic, np.float64)
    order = np.concatenate([r.permutation(np.flatnonzero(toxic == y)) for y in (1, 0)])
    halves = order[::2], order[1::2]
    if min((toxic[x].sum() for x in halves), default=0) < 1 or min(((1 - toxic[x]).sum() for x in halves), default=0) < 1:
        return m
    w = read(*_arrow([texts[i] for i in halves[0]]))
    if w is None:
        return m
    pairs = [np.unique((w.doc[i : i + 4096, None] * np.int64(len(w.bucket)) + w.ids[i : i + 4096])[np.arange(WINDOW) < w.length[i : i + 4096, None]]) for i in range(0, len(w.ids), 4096)]
    doc, word = np.divmod(np.unique(np.concatenate(pairs)), len(w.bucket))
    del pairs
    m["word_odds"] = _odds([(w.bucket[word], doc)], toxic[halves[0]])
    m["gram_odds"] = _odds(_gram_parts(w, doc, word), toxic[halves[0]])

    del w, doc, word
    w, y = read(*_arrow([texts[i] for i in halves[1]])), toxic[halves[1]]
    if w is None:
        return m
    moments = {k: (np.zeros_like(m[k]), np.zeros_like(m[k])) for k in ("char", "word", "wx", "b", "uf", "ub", "v", "o", "ob")}
    grams_of = np.bincount(w.gram_word, minlength=len(w.bucket))
    first_gram, step = np.cumsum(grams_of) - grams_of, 0
    for epoch in range(epochs + 1):
        x = inputs(m, w)
        logit = logits(m, x, w)
        best = np.lexsort((-logit, w.doc))
        best = best[np.unique(w.doc[best], return_index=True)[1]]
        if epoch == epochs:
            break
        pick = r.permutation(np.concatenate([best, r.integers(0, len(w.doc), len(best))]))
        pick = pick[(y[w.doc[pick]] == 0) | np.isin(pick, best)]
        weight = (y == 0).sum() / max(1, y.sum())
        for i in range(0, len(pick), BATCH):
            rows, keep = pick[i : i + BATCH], {}
            used, inv = np.unique(w.ids[rows], return_inverse=True)
            n = grams_of[used]
            own = np.repeat(first_gram[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            part = Words(w.bucket[used], w.grams[own], np.repeat(np.arange(len(used)), n), inv.reshape(len(rows), -1), w.length[rows], w.doc[rows])
            px = inputs(m, part)
            q, t = _sigmoid(forward(m, projected(m, px), part, keep=keep)), y[part.doc]
            d = ((q - t) * np.where(t > 0, weight, 1) / len(rows)).astype(np.float32)
            step += 1
            for k, g in gradient(m, px, part, keep, d).items():
                at, g = g if isinstance(g, tuple) else (..., g)  # embeddings of words that the batch hasn't stay
                a, b = moments[k]
                a[at] += 0.1 * (g - a[at])
                b[at] += 0.001 * (g * g - b[at])
                m[k][at] -= RATE * (a[at] / (1 - 0.9**step)) / (np.sqrt(b[at] / (1 - 0.999**step)) + 1e-8)
    high, t = logit[best], y[w.doc[best]]
    order = np.argsort(-high)
    clean, bad = labelled or ((1 - toxic).sum(), toxic.sum())
    stands = np.where(t > 0, bad / t.sum(), clean / (1 - t).sum())[order]  # documents that one of the sample stands for
    hit = np.cumsum(stands * t[order])
    f1 = 2 * hit / (np.cumsum(stands) + bad)
    k = int(np.argmax(f1))
    m["threshold"] = np.float32((high[order[k]] + (high[order[k + 1]] if k + 1 < len(order) else high[order[k]] - 1)) / 2)
    return m


def scores(m: dict, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The highest logit of each text's windows (-inf without words), and the window's first word."""
    data, off, _ = kernel.utf8(pc.utf8_lower(text))
    n = len(off) - 1
    out, at = np.full(n, -np.inf, np.float32), np.zeros(n, np.int64)
    for i, j in kernel.passes(off):
        w = read(data[off[i] : off[j]], off[i : j + 1] - off[i])
        if w is None:
            continue
        x = inputs(m, w)
        logit = logits(m, x, w)
        begin = np.flatnonzero(np.diff(w.doc, prepend=-1))
        top = np.maximum.reduceat(logit, begin)
        out[i + w.doc[begin]] = top
        where = np.flatnonzero(logit == np.repeat(top, np.diff(np.append(begin, len(logit)))))
        docs, k = np.unique(w.doc[where], return_index=True)
        at[i + docs] = (where[k] - begin) * STRIDE
    return out, at


def sample(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_bytes: int = MAX_BYTES
) -> tuple[list[str], np.ndarray, tuple[int, int]]:
    """Texts and labels of labelled documents, and how many clean and toxic ones there are.

    Drawn by hash of the id: at most ``max_toxic`` and ``max_clean`` of the classes, and of those, in that order, as many as
    ``max_bytes`` hold, each class its part; a longer document is passed over. An id that is labelled both ways counts
    as not labelled, and of the texts of an id that repeats one is taken, by hash.
    """
    y = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("__toxic")).where("__id is not null and __toxic in (0, 1)")
    y = y.groupBy("__id").agg(F.min("__toxic").alias("__toxic"), F.max("__toxic").alias("__top")).where("__toxic = __top").drop("__top")
    n = y.agg(F.sum(1 - F.col("__toxic")), F.sum("__toxic")).first()
    few = [y.where(f"__toxic = {k}").orderBy(F.xxhash64("__id"), "__id").limit(m) for k, m in ((1, max_toxic), (0, max_clean))]
    few = F.broadcast(few[0].union(few[1]))  # of bounded size
    rows = docs.select(docs[id_col].cast("long").alias("__id"), docs[text_col].cast("string").alias("__text")).join(few, "__id").where("__text is not null")
    rows = rows.groupBy("__id", "__toxic").agg(F.min(F.struct(F.xxhash64("__text").alias("h"), F.col("__text").alias("text"))).alias("x"))
    rows = written(rows.select("__id", "__toxic", "x.text", F.octet_length("x.text").alias("size"), F.xxhash64("__id").alias("place")), "sample")
    found = rows.select("__id", "__toxic", "size", "place").orderBy("place", "__id").toArrow()  # some thousand rows
    toxic, size, ids = (found[c].to_numpy() for c in ("__toxic", "size", "__id"))
    take = np.zeros(len(ids), bool)
    for k, most in ((1, max_toxic), (0, max_clean)):
        left = max_bytes * most // (max_toxic + max_clean)
        for i in np.flatnonzero(toxic == k):
            if size[i] <= left:
                left -= size[i]
                take[i] = True
    if not take.any():
        return [], np.zeros(0, np.int32), (0, 0)
    chosen = rows.where(F.col("__id").isin(ids[take].tolist())).orderBy("place", "__id").select("__toxic", "text").toArrow()
    return chosen["text"].to_pylist(), chosen["__toxic"].to_numpy(), (n[0] or 0, n[1] or 0)


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds: int) -> dict:
    """A model of ``sample``, which takes the bounds."""
    kernel.frugal()
    small_batches(docs.sparkSession)
    texts, toxic, labelled = sample(docs, labels, id_col, text_col, **bounds)
    model = train(texts, toxic, labelled=labelled)
    del texts
    kernel.frugal()
    return model


_SCORED = "doc_id long, toxic boolean, score double, word long"


def scored(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, toxic, score, word) of every row: the probability of its worst window, and that window's first word.

    Every text is read whole. Without words (null, empty, only punctuation) the
    score is 0 and nothing is toxic. Equal windows: the first is named. Repeated
    rows are scored each, alike; a null id stays null. Other columns aren't
    read, and an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        kernel.frugal()
        for b in batches:
            logit, word = scores(m, b.column(1))
            p = 1 / (1 + np.exp(-np.clip(logit, -60, 60).astype(np.float64)))
            p[np.isneginf(logit)] = 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(logit >= m["threshold"]), pa.array(np.round(p, 6)), pa.array(word)], names=["doc_id", "toxic", "score", "word"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, _SCORED)


def toxic_documents(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """``scored`` rows that are toxic, by a model fitted on ``labels`` (doc_id, toxic)."""
    return scored(docs, fitted(docs, labels, **bounds)).where("toxic")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds: int) -> DataFrame:
    """``docs``, all columns, less its toxic rows; a row without words stays."""
    model = fitted(docs, labels, id_col, text_col, **bounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clean(text):
        return ~(pd_series(scores(shared.value, pa.array(text, pa.string()))[0] >= shared.value["threshold"]))

    return docs.where(clean(docs[text_col].cast("string")))


def pd_series(a: np.ndarray):
    import pandas as pd

    return pd.Series(a)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
