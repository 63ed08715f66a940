"""Operator 3: exact top-k search by tiled matrix products.

Queries and base vectors are each split into groups, and every pair of groups
is a cell that one task computes, so that g x g cells move each vector g times. Within a cell,
tiles of queries are multiplied with tiles of the base, and of each product only what
reaches a query's k-th best so far is kept. Cells give a list of k for each query; lists
of the same queries are merged in a tree, FAN_IN at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

K = 10
#: Vectors of a group, about; queries and base vectors of a tile.
GROUP_ROWS, QUERY_TILE, BASE_TILE = 1 << 14, 256, 4096
FAN_IN = 8
#: The query's set: vectors whose id is divisible by this, against all.
EVERY = 20
#: Scores are compared as rounded to so many places, so that the order of additions doesn't break ties.
PLACES = 6

_TOP = "query_id long, ids array<long>, scores array<double>"


def top_of(q: np.ndarray, base: np.ndarray, ids: np.ndarray, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores (queries, k) of the base vectors of the largest products, best first, equals by id.

    ``own`` are ids of the queries, which don't find themselves. Places without a vector have the id -1 and the score -inf.
    """
    best_s = np.full((len(q), k), -np.inf)
    best_i = np.full((len(q), k), -1, np.int64)
    slack = 2 * 10.0**-PLACES
    for a in range(0, len(base), BASE_TILE):
        s = q @ base[a : a + BASE_TILE].T
        tile = ids[a : a + BASE_TILE]
        if own is not None:
            r, c = np.nonzero(own[:, None] == tile)
            s[r, c] = -np.inf
        bar = best_s[:, -1] - slack
        if s.shape[1] > k:  # partial selection: what the tile alone can add
            bar = np.maximum(bar, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - slack)
        r, c = np.nonzero((s >= bar[:, None]) & (s > -np.inf))
        if not len(r):
            continue
        row = np.concatenate([np.repeat(np.arange(len(q)), k), r])
        val = np.concatenate([best_s.ravel(), np.round(s[r, c], PLACES) + 0.0])
        num = np.concatenate([best_i.ravel(), tile[c]])
        order = np.lexsort((num, -val, row))
        begin = np.searchsorted(row[order], np.arange(len(q)))
        pick = order[begin[:, None] + np.arange(k)]
        best_s, best_i = val[pick], num[pick]
    return best_i, best_s


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(n > 0, n, 1)[:, None]


def _lists(ids: np.ndarray, best_i: np.ndarray, best_s: np.ndarray) -> list[pa.Array]:
    have = best_i >= 0
    have &= best_s > -np.inf
    off = pa.array(np.append(0, np.cumsum(have.sum(1))).astype(np.int32))
    return [pa.array(ids), pa.ListArray.from_arrays(off, pa.array(best_i[have])), pa.ListArray.from_arrays(off, pa.array(best_s[have]))]


def search(queries: DataFrame, base: DataFrame, k: int = K, cosine: bool = True, skip_own: bool = False, id_col: str = "vec_id", vector_col: str = "embedding", group_rows: int = GROUP_ROWS) -> DataFrame:
    """(query_id, rank, match_id, score): the k base vectors of the largest cosine (or inner product) for every query.

    Scores are rounded to PLACES; equals are ranked by id. With ``skip_own`` a query doesn't find base vectors of its
    own id. Every query row is searched, and repeated rows are each found and each searched. Rows without an
    id, a vector, or with a null, NaN or infinite element in it take no part, nor do empty vectors. Only vectors of one length are
    compared: a query finds those of its own, and where no base vector has that, nothing. A zero vector has the cosine 0 with all. Fewer base vectors than k give fewer
    rows; an empty table gives none. Other columns aren't read.
    """
    if k < 1:
        raise ValueError("k must be positive")
    fine = (F.size("v") > 0) & F.col("id").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    def side(df: DataFrame) -> DataFrame:
        return df.select(df[id_col].cast("long").alias("id"), df[vector_col].cast("array<double>").alias("v")).where(fine)

    left, right = side(queries), side(base)
    n, m = left.count(), right.count()
    if not n or not m:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, match_id long, score double")
    a, b = -(-n // group_rows), -(-m // group_rows)
    spread = lambda g: F.pmod(F.xxhash64("id", "v"), F.lit(g)).cast("int")
    left = left.select(spread(a).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("b"), F.lit(True).alias("query"), "id", "v")
    right = right.select(F.explode(F.sequence(F.lit(0), F.lit(a - 1))).alias("a"), spread(b).alias("b"), F.lit(False).alias("query"), "id", "v")

    def cell(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tab = pa.Table.from_batches(list(batches))
        is_query = np.asarray(tab["query"].combine_chunks().cast(pa.uint8())).astype(bool)
        ids = np.asarray(tab["id"])
        v = tab["v"].combine_chunks()
        del tab
        size = np.diff(np.asarray(v.offsets))
        row = np.cumsum(is_query) - 1  # of a query in its group, alike in all cells
        for n in np.unique(size[is_query]):
            same = np.flatnonzero(size == n)
            x = np.asarray((v if len(same) == len(size) else v.take(pa.array(same))).flatten()).reshape(len(same), n)
            if cosine:
                x = _unit(x)
            ask = is_query[same]
            q, qi, qr, y, yi = x[ask], ids[same][ask], row[same][ask], x[~ask], ids[same][~ask]
            for i in range(0, len(q), QUERY_TILE):
                own = qi[i : i + QUERY_TILE]
                found = top_of(q[i : i + QUERY_TILE], y, yi, k, own if skip_own else None)
                lists = _lists(own, *found)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), key[0].as_py(), np.int32)), pa.array(np.full(len(own), key[1].as_py(), np.int32)), pa.array(qr[i : i + QUERY_TILE]), *lists], names=["a", "b", "row", "query_id", "ids", "scores"])

    schema = "a int, b int, row long, " + _TOP
    # a query's row in its group tells repeated ids apart: rows are ordered alike in all cells of the group
    cells = left.unionByName(right).repartition("a", "b").sortWithinPartitions("a", "b", "query", "id", "v").groupBy("a", "b").applyInArrow(cell, schema)

    def merge(table: pa.Table) -> pa.Table:
        row, qid = np.asarray(table["row"]), np.asarray(table["query_id"])
        ids, sc = table["ids"].combine_chunks(), table["scores"].combine_chunks()
        size = np.diff(np.asarray(ids.offsets))
        r, num, val = np.repeat(row, size), np.asarray(ids.flatten()), np.asarray(sc.flatten())
        order = np.lexsort((num, -val, r))
        r, num, val = r[order], num[order], val[order]
        rows, first = np.unique(row, return_index=True)
        begin = np.searchsorted(r, rows)
        place = np.arange(len(r)) - begin[np.searchsorted(rows, r)]
        keep = place < k
        off = pa.array(np.append(0, np.cumsum(np.bincount(np.searchsorted(rows, r[keep]), minlength=len(rows)))).astype(np.int32))
        first_of = np.full(len(rows), table["a"][0].as_py(), np.int32)
        return pa.table([pa.array(first_of), pa.array(np.full(len(rows), table["b"][0].as_py(), np.int32)), pa.array(rows), pa.array(qid[first]), pa.ListArray.from_arrays(off, pa.array(num[keep])), pa.ListArray.from_arrays(off, pa.array(val[keep]))], names=["a", "b", "row", "query_id", "ids", "scores"])

    while b > 1:
        cells = cells.withColumn("b", F.expr(f"b div {FAN_IN}").cast("int")).groupBy("a", "b").applyInArrow(merge, schema)
        b = -(-b // FAN_IN)
    flat = cells.select("query_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("at", "x"))
    return flat.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.ids").alias("match_id"), F.col("x.scores").alias("score"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors.where(f"vec_id % {EVERY} = 0"), vectors, skip_own=True)


OP3_SQL = f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), pair AS (
  SELECT a.vec_id AS query_id, b.vec_id AS match_id, round(list_cosine_similarity(a.e, b.e), {PLACES}) AS score FROM v a, v b WHERE a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, match_id) AS rank FROM pair)
SELECT query_id, CAST(rank AS INTEGER) AS rank, match_id, score FROM ranked WHERE rank <= {K}
"""
