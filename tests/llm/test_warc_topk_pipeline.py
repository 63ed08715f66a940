"""WARC, exact search, the pipeline, and the SQL of the corpus queries."""

from __future__ import annotations

import gzip
import io
import os
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp

import corpus_pipeline
from quern.llm import queries, topk, warc

ONE = warc.record("response", "http://a.example/", "2026-01-01T00:00:00Z", b"HTTP/1.1 200 OK\r\n\r\nbody", b"body")
TWO = warc.record("metadata", "", "2026-01-01T00:00:00Z", b"")


class Dribble(io.BytesIO):
    """A file that gives a few bytes at a time."""

    def read(self, n=-1):
        return super().read(min(n, 7) if n >= 0 else 7)


def records(data, cls=io.BytesIO):
    return list(warc.read_records(cls(data)))


def test_records_member_by_member():
    data = warc.member(ONE) + warc.member(TWO) + warc.member(ONE)
    for cls in (io.BytesIO, Dribble):
        got = records(data, cls)
        assert [r["error"] for r in got] == [None] * 3
        assert [r["offset"] for r in got] == [0, len(warc.member(ONE)), len(warc.member(ONE) + warc.member(TWO))]
        h = got[0]["headers"]
        assert got[0]["payload"] == b"body" and got[0]["content_length"] == 23 and got[0]["block_ok"] and got[0]["payload_ok"] and warc.matches(h["warc-payload-digest"], b"body")
    assert records(b"") == []
    assert gzip.decompress(data) == ONE + TWO + ONE


def test_faults():
    assert records(warc.member(b"no header"))[0]["error"] == "no WARC header block"
    assert records(warc.member(ONE.replace(b"Content-Length: 23", b"Content-Length: 99")))[0]["error"] == "content shorter than its length"
    assert records(warc.member(ONE.replace(b"Content-Length: 23", b"Content-Length: 5")))[0]["error"] == "record doesn't end where its length says"
    assert records(warc.member(ONE.replace(b"Content-Length: 23", b"Content-Length: -1")))[0]["error"] == "no usable content length"
    got = records(warc.member(b"bad") + warc.member(ONE))
    assert got[0]["error"] and got[1]["error"] is None
    assert records(warc.member(ONE)[:-5])[0]["error"].startswith("damaged")
    assert records(b"not gzip at all")[0]["error"].startswith("damaged")
    big = warc.record("resource", "u", "d", os.urandom(3 << 20))
    assert records(warc.member(big))[0]["error"] is None


@pytest.mark.parametrize("head", [b"", b"HTTP/1.1 200 OK\r\nX: " + b"y" * 3000 + b"\r\n\r\n"])
def test_long_records_come_in_parts(head):
    """Bodies and header blocks of any length, in parts that make the body again, with digests over all of them."""
    body = os.urandom(5 << 20)
    one = warc.record("response", "http://a.example/", "2026-01-01T00:00:00Z", head + body, body, {"X-Long": "z" * (3 << 20)}) if head else warc.record("resource", "u", "d", body, extra={"X-Long": "z" * (3 << 20)})
    got = list(warc.read_records(io.BytesIO(warc.member(one, 1) + warc.member(TWO)), 1 << 20))
    parts = got[:-1]
    assert [r["part"] for r in parts] == list(range(5)) and [r["last"] for r in parts] == [False] * 4 + [True] and b"".join(r["payload"] for r in parts) == body
    assert parts[-1]["block_ok"] is True and parts[-1]["payload_ok"] is (True if head else None) and parts[-1]["content_length"] == len(head + body) and parts[-1]["error"] is None
    assert all(r["content_length"] is None and len(r["payload"]) == 1 << 20 for r in parts[:-1]) and got[-1]["error"] is None
    cut = list(warc.read_records(io.BytesIO(warc.member(one.replace(body[-8:], b"otherend"), 1)), 1 << 20))
    assert cut[-1]["block_ok"] is False
    damaged = list(warc.read_records(io.BytesIO(warc.member(one, 1)[:-1000]), 1 << 20))
    assert damaged[-1]["last"] and damaged[-1]["error"].startswith("damaged")


def test_digests():
    assert warc.matches("sha1:" + "A" * 32, b"x") is False and warc.matches("crc:1", b"x") is None
    assert warc.matches("sha256:2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881", b"x") and zlib


def test_pages_through_warc(spark):
    rows = [(1, "http://a.example/", "<p>é</p>", "x"), (2, None, "", "x"), (3, "u\nv", None, "x"), (None, "http://b.example/", "z" * 300000, "x"), (1, "http://a.example/", "<p>é</p>", "x")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    got = warc.pages_through_warc(d).collect()
    assert all(r.verified for r in got)
    assert sorted((r.page_id or 0, r.url or "", r.html) for r in got if r.html is not None) == sorted((a or 0, b or "", c) for a, b, c, _ in rows if c is not None)
    assert [(r.url, r.content_length) for r in got if r.page_id == 3] == [("uv", None)]
    assert warc.pages_through_warc(d.where("false")).count() == 0


def brute_top(q, qi, base, bi, k, own):
    out = []
    for x, i in zip(q, qi):
        s = [(-round(float(x @ y), topk.PLACES) + 0.0, j) for y, j in zip(base, bi) if not (own and i == j)]
        out.append([j for _, j in sorted(s)[:k]])
    return out


@settings(max_examples=40, deadline=None)
@given(hnp.arrays(np.float64, st.tuples(st.integers(1, 30), st.just(3)), elements=st.integers(-2, 2).map(float)), st.integers(1, 6), st.booleans())
def test_tiles_against_brute_force(x, k, own):
    ids = np.arange(len(x))[::-1].copy()
    old = topk.BASE_TILE
    topk.BASE_TILE = 4
    try:
        got, _ = topk.top_of(x, x, ids, k, ids if own else None)
    finally:
        topk.BASE_TILE = old
    assert [[j for j in r if j >= 0] for r in got.tolist()] == brute_top(x, ids, x, ids, k, own)


def test_search(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((60, 4)).round(1)
    x[7], x[8] = x[3], 0
    odd = [(93, [], "c"), (94, [2.0], "c"), (95, [3.0, 4.0], "c"), (96, [4.0, 3.0], "c")]
    rows = odd + [(k, [float(a) for a in v], "c") for k, v in enumerate(x)] + [(3, [float(a) for a in x[3]], "c"), (None, [1.0] * 4, "c"), (90, None, "c"), (91, [1.0, None, 1.0, 1.0], "c"), (92, [float("nan")] * 4, "c")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    u = topk._unit(x.astype(np.float32).astype(np.float64))
    ids = np.append(np.arange(60), 3)
    u = np.concatenate([u, u[3:4]])
    want = sorted((int(i), p + 1, int(j)) for i, row in zip(ids, brute_top(u, ids, u, ids, 5, True)) for p, j in enumerate(row))
    got = topk.search(d, d, 5, skip_own=True, group_rows=7)
    assert sorted((r.query_id, r["rank"], r.match_id) for r in got.collect()) == sorted([*want, (95, 1, 96), (96, 1, 95)])
    assert topk.search(d, d.where("false")).count() == 0 and topk.search(d.where("false"), d).count() == 0
    assert topk.search(d.where("vec_id = 0"), d.where("vec_id in (1, 2)"), 5).count() == 2


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    from tests.test_sql import compared

    compared(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], DATA)


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert docs.columns == columns
        if name in ("toxicity", "line_dedup", "near_dedup"):
            left = {r.doc_id for r in docs.select("doc_id").collect()}
            assert left <= ids and len(left) > len(ids) / 2
            ids = left
    assert docs.count() > 0 and docs.where("n_tokens > capacity").count() == 0


def test_pipeline_keeps_one_place_of_rare_passages(spark):
    import random

    r = random.Random(3)
    say = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    passage, tiny, short = say(60), " ".join("abcdefghijklmnopqrstuvwxy" * 2), "a short line of few words"
    own = {k: [say(150), say(150)] for k in range(4)}
    text = {k: "\n".join([own[k][0], passage, *([tiny] if k > 1 else []), short, own[k][1]]) for k in own}
    near = text[1].replace(own[1][0], own[1][0] + " end")
    docs = spark.createDataFrame([*((k, t) for k, t in text.items()), (9, near), (10, passage), (11, None)], "doc_id long, text string")
    got = docs
    for _, stage in corpus_pipeline.STAGES[1:3]:
        got = stage(spark, got, "")
    want = {k: "\n".join([own[k][0], *([passage] if k == 0 else []), *([tiny] if k == 2 else []), short, own[k][1]]) for k in own} | {11: None}
    assert {x.doc_id: x.text for x in got.collect()} == want


ODD = [(None, "no id, " + "kept text here " * 9), (1, None), (2, ""), (3, " \n\t\n "), (4, "a plain text of several words that stays"), (4, "a plain text of several words that stays"), (4, "the same id with another text, which stays as well"), (5, "long " * 60000 + "tail"), (6, "?!"), (7, "tie one two three"), (8, "tie one two three"), (-9, "é🙂 " * 50)]


@pytest.mark.parametrize("name", ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"])
def test_stages_take_odd_rows(spark, tmp_path, name):
    """Nulls in all columns, empty, blank and very long texts, ties, repeated rows, and columns whose names an operator uses itself."""
    own = "doc_id long, text string, lang string, source string, n_chars long, row long, place string, gone string, tokens string, lines_removed string, __gone string, toxic string, score string, stream string"
    rows = [(i, t, None if k % 3 else "en", None if k % 2 else "s", None, k, *["x"] * 8) for k, (i, t) in enumerate(ODD)]
    d = spark.createDataFrame(rows, own)
    spark.createDataFrame([(4, None, 0), (5, None, 1), (None, None, 1), (7, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, d, str(tmp_path)).collect()
    ids = sorted(str(r.doc_id) for r in got) if name not in ("packing",) else None
    if name == "toxicity":
        assert ids == sorted(str(i) for i, _ in ODD) and set(got[0].asDict()) == set(d.columns)
    elif name == "line_dedup":
        assert ids == sorted(str(i) for i, _ in ODD)  # nothing occurs often enough
    elif name == "near_dedup":
        assert ids == sorted(str(i) for i, _ in ODD if i != 8)
    elif name == "mixing":
        whole = "".join(r.text for r in got)
        assert "tail" in whole and "kept text" in whole and {r.source for r in got} == {None, "s"}
    else:
        held = [i for r in got for i in r.doc_ids]
        assert {None, 3, 4, 5, 6, 7, 8, -9} == set(held) and held.count(4) == 3
        assert sum(r.n_tokens for r in got) == sum(sum(r.lengths) for r in got)
    assert stage(spark, d.where("false"), str(tmp_path)).count() == 0


def test_pipeline_of_empty_documents(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
