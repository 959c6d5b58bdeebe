"""Exact top-k inner-product search by the threshold algorithm over sorted per-dimension lists.

Every block of candidates holds one list per dimension, sorted by component.  A query reads all lists
in step from the end that suits the sign of its weight, scores each newly met vector in full (random access), and stops
when the sum of the last-read contributions - a bound for every vector not yet met - is below its kth score.
A tie with the bound goes on, since an unseen vector of equal score could have the smaller id.

Blocks: queries and candidates meet in a grid of (candidate block, query block) cells, each of bounded size, so memory
stays bounded and a lost executor costs its cells only.  Partial top-k lists (k rows per query and block) are then ranked.

Defined cases: vectors that are null, or hold a null or non-finite component, or have no id, take no part.
Vectors of different lengths do not meet.  Repeated rows (same id and vector) count once; a query never meets its own id.
Empty tables give an empty result.  Components saturate at the range of a long, and scores at +-(2**63 - 1).
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a candidate block and of a query block.
BLOCK_ROWS, QUERY_ROWS = 8192, 1024
_LONG = np.iinfo(np.int64)


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, q array<long>): usable vectors with each component as floor(scale * x)."""
    v = F.col(vec_col)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return (
        vectors.where(F.col(id_col).isNotNull() & fine)
        .select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("q"))
    )


def _products(m: np.ndarray, q: np.ndarray, kind: str) -> np.ndarray:
    if kind == "f":  # exact: every partial sum is below 2**53
        return (m @ q).astype(np.int64)
    if kind == "i":
        return m @ q
    return np.array([min(max(int(x), -_LONG.max), _LONG.max) for x in m @ q], np.int64)


def search_block(ids: np.ndarray, m: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """Threshold algorithm for one block: yields (query_id, ids, scores, number of vectors scored)."""
    n, d = m.shape
    top = max(float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (m, queries))
    bound = top * top * max(d, 1)
    kind = "f" if bound < 2**52 else "i" if bound < 2**62 else "o"
    m, queries = (x.astype({"f": np.float64, "i": np.int64, "o": object}[kind]) for x in (m, queries))
    up = np.argsort(m, axis=0, kind="stable")
    down = up[::-1]
    up_v, down_v = np.take_along_axis(m, up, 0), np.take_along_axis(m, down, 0)
    for query_id, q in zip(query_ids, queries, strict=True):
        seen = ids == query_id
        best_s, best_i, scored, depth, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0, 16
        falling = q >= 0
        while depth < n:
            end = min(n, depth + step)
            met = np.zeros(n, bool)
            if d:
                met[np.where(falling, down[depth:end], up[depth:end])] = True
            else:
                met[:], end = True, n
            new = np.flatnonzero(met & ~seen)
            if len(new):
                seen[new] = True
                s = np.concatenate([best_s, _products(m[new], q, kind)])
                i = np.concatenate([best_i, ids[new]])
                keep = np.lexsort((i, -s))[:k] if len(s) <= 4 * k else _head(s, i, k)
                best_s, best_i, scored = s[keep], i[keep], scored + len(new)
            limit = sum((q * np.where(falling, down_v[end - 1], up_v[end - 1])).tolist())
            if len(best_s) == k and best_s[-1] > limit:
                break
            depth, step = end, step * 2
        yield query_id, best_i, best_s, scored


def _head(s: np.ndarray, i: np.ndarray, k: int) -> np.ndarray:
    kth = np.partition(s, len(s) - k)[len(s) - k]
    near = np.flatnonzero(s >= kth)
    return near[np.lexsort((i[near], -s[near]))[:k]]


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    d = t.column("d")[0].as_py()
    flat = t.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return t.column("vec_id").to_numpy(), flat.reshape(t.num_rows, d)


def threshold_topk(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query, ties to the smaller id."""
    base = quantised(vectors, id_col, vec_col, scale).withColumn("d", F.size("q"))
    n, nq = vectors.agg(F.count("*"), F.count_if(is_query(F.col("vec_id")))).first()
    blocks, q_blocks = max(1, -(-n // block_rows)), max(1, -(-nq // query_rows))
    spread = lambda col, m, salt: F.pmod(F.xxhash64(F.lit(salt), col), F.lit(m)).cast("int")
    cells = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    found = base.dropDuplicates(["vec_id", "q"])
    left = found.select("vec_id", "q", "d", spread("vec_id", blocks, 1).alias("cb"), cells(q_blocks).alias("qb"))
    queries = found.where(is_query(F.col("vec_id")))
    right = queries.select("vec_id", "q", "d", spread("vec_id", q_blocks, 2).alias("qb"), cells(blocks).alias("cb"))

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [[], [], []]
        if a.num_rows and b.num_rows:
            ids, m = _matrix(a)
            for query_id, i, s, _ in search_block(ids, m, *_matrix(b), k):
                out[0].append(np.full(len(i), query_id, np.int64))
                out[1].append(i)
                out[2].append(s)
        cols = [np.concatenate([np.zeros(0, np.int64), *x]) for x in out]
        return pa.table(cols, ["query_id", "vec_id", "score"])

    key = ["cb", "qb", "d"]
    part = left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(cell, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


