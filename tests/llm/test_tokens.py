"""Tokens, token tables, packing and mixing: exact against the plain encoder, round trips, edge cases."""

from __future__ import annotations

import glob
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quern.llm import mixing, packing, tokens, tokentable

T = tokens.Tokenizer(tokens.read_vocabulary())
ODD = ["", "  a  b\n\n c ", "x y  z", "a　 b", "don't 'll  ' s", "é è\n\té", " ", "\n", None, "ab\x7f cd", "🙂 🙂🙂  x", "z \x1c y", "<|endoftext|> a", "a  b  c"]


def ids_of(column):
    return [x.tolist() for i, j, ids, off in T.encode(column) for x in np.split(ids, off[1:-1])]


def plain(t):
    return T.bpe.encode_ordinary(t) if t else []


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.sampled_from("ab 'sé\n\t　1!<|>🙂 \x1c"), max_size=40), min_size=1, max_size=30))
def test_encoding_is_the_plain_encoders(texts):
    assert ids_of(pa.array(texts, pa.string())) == [plain(t) for t in texts]


def test_odd_texts_and_round_trip():
    got = ids_of(pa.array(ODD))
    assert got == [plain(t) for t in ODD]
    assert [T.decode(np.array(x, np.uint16)).decode() for x in got] == [t or "" for t in ODD]


def test_slots_that_collide(monkeypatch):
    monkeypatch.setattr(tokens, "SLOTS", 8)
    monkeypatch.setattr(tokens, "HELD", 100)
    t = tokens.Tokenizer(tokens.read_vocabulary())
    texts = [f"word{k} and more{k} words{k % 7}" for k in range(300)]
    for _ in range(2):
        assert [x.tolist() for i, j, ids, off in t.encode(pa.array(texts)) for x in np.split(ids, off[1:-1])] == [plain(x) for x in texts]


DOCS = "doc_id long, text string, lang string, source string, n_chars long, tokens string, bin string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, "clash", "clash") for i, t, s in rows], DOCS)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_table(spark, tmp_path, encoding):
    rows = [(k, f"text number {k} " * 30, "s") for k in range(3000)] + [(None, "no id", None), (5000, None, "s"), (5001, "", "s"), (7, "repeated", "s")]
    path = f"{tmp_path}/t"
    tokentable.write_tokens(tokentable.encoded(docs(spark, rows).coalesce(1).sortWithinPartitions("doc_id")), path, encoding, row_group_bytes=20_000, page_rows=100)
    got = tokentable.read_tokens(spark, path)
    want = sorted((i, tuple(plain(t))) for i, t, _ in rows if i is not None)
    assert sorted((r.doc_id, tuple(r.tokens)) for r in got.where("doc_id is not null").collect()) == want
    assert got.where("doc_id is null").count() == 1 and got.where("n_tokens <> size(tokens)").count() == 0
    meta = pq.ParquetFile(glob.glob(f"{path}/part-*.parquet")[0]).metadata
    assert meta.num_row_groups > 1
    column = next(c for c in (meta.row_group(0).column(k) for k in range(meta.num_columns)) if c.path_in_schema.startswith("tokens"))
    assert ("DELTA_BINARY_PACKED" in column.encodings) == (encoding == "delta") and any("DICTIONARY" in e for e in column.encodings) == (encoding == "dictionary")
    assert meta.row_group(0).column(0).has_offset_index and meta.row_group(0).column(0).has_column_index
    few = tokentable.read_tokens(spark, path, [3, 8], ["doc_id", "n_tokens"])
    plan = few._jdf.queryExecution().toString()
    assert few.count() == 2 and "PushedFilters: [In(doc_id" in plan and "tokens:array" not in plan.split("ReadSchema")[-1]
    with pytest.raises(ValueError):
        tokentable.write_tokens(got, path, "other")
    odd = docs(spark, [(1, "very long " * 200_000, None), (2, None, "s"), (2, None, "s")])
    tokentable.write_tokens(tokentable.encoded(odd), path + "2", encoding)
    long = {r.doc_id: r for r in tokentable.read_tokens(spark, path + "2").collect()}
    assert long[1].tokens == plain("very long " * 200_000) and long[2].tokens == [] and tokentable.read_tokens(spark, path + "2").count() == 3
    tokentable.write_tokens(tokentable.encoded(odd.where("false")), path + "3", encoding)
    assert tokentable.read_tokens(spark, path + "3").count() == 0


def brute_pack(lengths, caps, bin_cost):
    """The rule word for word, by looking through all open bins."""
    order = sorted(range(len(lengths)), key=lambda k: -lengths[k])
    bins, of = [], [0] * len(lengths)
    for at, k in enumerate(order):
        n = lengths[k]
        fit = [b for b in range(len(bins)) if bins[b][0] >= n]
        if fit:
            b = min(fit, key=lambda b: (bins[b][0], -bins[b][2]))
        else:
            rest = [lengths[x] for x in order[at + 1 :]]
            cost = {c: (c + bin_cost) / max(1, n + min(c - n, sum(x for x in rest if x <= c - n))) for c in caps if c >= n}
            c = min(cost, key=lambda c: (cost[c], c))
            bins.append([c, 0, at])
            b = len(bins) - 1
        bins[b][0] -= n
        bins[b][1] += n
        bins[b][2] = at
        of[k] = b
    return of, [min(c for c in caps if c >= b[1]) for b in bins]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=40), st.sampled_from([(16,), (4, 8, 16), (5, 7, 16)]), st.sampled_from([0, 2, 10]))
def test_packing_against_brute_force(lengths, caps, bin_cost):
    of, size = packing.pack(lengths, caps, bin_cost)
    assert (of, size) == brute_pack(lengths, caps, bin_cost)


def test_packed_holds_every_token_once(spark):
    rows = [(k, "some words of text " * (k % 40), "s") for k in range(60)] + [(100, "long " * 3000, "s"), (None, "null id", "s"), (3, "some words of text " * 3, "s"), (101, None, "s"), (102, "", "s")]
    d = docs(spark, rows)
    got = packing.packed(d, (64, 256, 1024)).collect()
    parts = {}
    for r in got:
        assert r.capacity in (64, 256, 1024) and r.n_tokens == len(r.tokens) == sum(r.lengths) <= r.capacity
        assert r.capacity == min(c for c in (64, 256, 1024) if c >= r.n_tokens)
        at = 0
        for i, s, n in zip(r.doc_ids, r.starts, r.lengths):
            parts.setdefault(i, []).append((s, r.tokens[at : at + n]))
            at += n
    for i in {x for x, t, _ in rows if t}:
        want = Counter(k for x, t, _ in rows if x == i and t for k in [*plain(t), T.eos])
        assert Counter(k for _, p in parts[i] for k in p) == want
    assert [k for _, p in sorted(parts[100]) for k in p] == [*plain("long " * 3000), T.eos]
    key = lambda r: (r.pack_group, r.bin, r.doc_ids, r.tokens)
    assert sorted(map(key, got), key=repr) == sorted(map(key, packing.packed(d.repartition(5), (64, 256, 1024)).collect()), key=repr)
    assert packing.packed(d.where("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**63))
def test_permutation(n, key):
    got = mixing.permuted(np.arange(n), n, np.uint64(key))
    assert sorted(got.tolist()) == list(range(n))


def test_mixing_against_brute_force(spark):
    rows = [(k, f"word{k} in source " * (5 + k % 9), f"s{k % 3}" if k % 3 else None) for k in range(90)] + [(None, "no id at all", "s1"), (200, None, "s1"), (201, "", "s2"), (4, "a second text of that id", "s1"), (4, "a second text of that id", "s1")]
    d = docs(spark, rows)
    block, slots = 32, 16
    got = mixing.mixed(d, block=block, slots=slots, stream_blocks=8).collect()
    total = Counter()
    for _, t, s in rows:
        if t:
            total[s] += len(plain(t)) + 1
    assert sorted(Counter((r.shard, r.slot) for r in got).values()) == [1] * len(got) and len(got) % slots == 0
    blocks = {}
    for r in got:
        assert len(r.tokens) == block and set(r.tokens[r.n_tokens :]) <= {T.eos}
        assert blocks.setdefault((r.source, r.block), r.tokens) == r.tokens
    # the draws of each shard: the same pseudorandom numbers, held against the running sum of weights
    order = sorted(total, key=lambda s: (s is None, s or ""))
    share, whole = mixing.shares(spark.createDataFrame([(s, float(total[s]) ** mixing.FLATTEN) for s in order], "source string, weight double"))
    spans = {r.source: (r.low, r.high) for r in share.collect()}
    assert sorted(spans.values())[0][0] == 0 and all(a[1] == b[0] for a, b in zip(sorted(spans.values()), sorted(spans.values())[1:])) and max(h for _, h in spans.values()) == whole
    for shard in {r.shard for r in got}:
        at = [int(u * whole) for u in mixing.uniforms(shard, slots, mixing.SEED)]
        for s in order:
            assert sum(r.shard == shard and r.source == s for r in got) == sum(spans[s][0] <= x < spans[s][1] for x in at)
    # each pass over a source takes each block once, and a complete one has all tokens
    for s in order:
        epochs = {}
        for r in got:
            if r.source == s:
                epochs.setdefault(r.epoch, []).append(r)
        for e, rs in epochs.items():
            assert max(Counter(r.block for r in rs).values()) == 1
        n_blocks = max(r.block for r in got if r.source == s) + 1
        for e in range(max(epochs)):
            full = epochs[e]
            assert sum(r.n_tokens for r in full) == total[s] and len(full) >= n_blocks
            want = Counter(k for _, t, x in rows if x == s and t for k in [*plain(t), T.eos])
            assert Counter(k for r in full for k in r.tokens[: r.n_tokens]) == want
    again = mixing.mixed(d.repartition(7), block=block, slots=slots, stream_blocks=8).collect()
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mixing_weights_and_documents(spark):
    d = docs(spark, [(k, "text of it " * 20, f"s{k % 3}") for k in range(30)])
    got = mixing.mixed_documents(d, {"s0": 3, "s1": 1}, block=16, slots=64, shards=20)
    n = Counter(r.source for r in got.collect())
    assert set(n) == {"s0", "s1"} and 0.7 < n["s0"] / 1280 < 0.8
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"] and got.select("doc_id").distinct().count() == 1280
    assert all(r.n_chars == len(r.text) for r in got.collect())
    assert mixing.mixed(d.where("false")).count() == 0 and mixing.mixed(d, {"s0": 0}).count() == 0
    assert mixing.mixed_documents(d.where("false")).count() == 0
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            mixing.mixed(d, {"s0": bad})


def test_mixed_documents_hold_every_character_once(spark):
    """A pass over each source, put together again, is its texts, wherever blocks cut characters; nulls, repeats and a long text included."""
    rows = [(k, "é🙂漢字 " * (3 + k % 5) + f"{k}", "s" if k % 2 else None) for k in range(40)] + [(3, "same", "s"), (3, "same", "s"), (None, "no id 🙂", "s"), (50, None, "s"), (51, "", None), (52, "長い🙂" * 20000, "s")]
    d = docs(spark, rows)
    kw = {"block": 7, "slots": 64, "stream_blocks": 16}
    text = {(r.doc_id // 64, r.doc_id % 64): r.text for r in mixing.mixed_documents(d, **kw).collect()}
    slots = mixing.mixed(d, **kw).collect()
    whole = {s: max(r.epoch for r in slots if r.source == s) for s in ("s", None)}
    for s in ("s", None):
        once = {r.block: text[r.shard, r.slot] for r in slots if r.source == s and (r.epoch == 0 or whole[s] == 0)}
        want = Counter(c for _, t, x in rows if x == s for c in t or "")
        got = Counter(c for t in once.values() for c in t.replace("\n\n", ""))
        if whole[s] > 0:
            assert got == want
        else:
            assert not got - want
    assert max(whole.values()) > 0


def test_many_sources_and_many_passes(spark):
    """More sources than a shard has slots, and one tiny source drawn over and over by several tasks."""
    d = docs(spark, [(k, f"text {k}", f"s{k}") for k in range(300)])
    got = mixing.mixed(d, block=8, slots=32, shards=4).collect()
    assert len(got) == 128 and len({(r.shard, r.slot) for r in got}) == 128
    got = mixing.mixed(d, {"s7": 1.0}, block=8, slots=32, shards=4).collect()
    assert len(got) == 128 and {r.doc_ids[0] for r in got} == {7} and {r.epoch for r in got} == set(range(128))
