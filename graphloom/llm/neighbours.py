"""Nearest neighbours by a block matrix join with int8 tiles.

Queries and candidates are dealt into blocks; each pair of blocks is a tile. Vectors are quantised to
int8 with a scale of their own, so a tile is one integer matrix product, and the rounding of each
component by at most half a step bounds how far a product may be off. Pairs whose upper bound is below
the k-th best lower bound of their query cannot be among its k nearest; the others are recomputed from
the original vectors in double precision, summed in the order of the components, and kept in a heap
for each query. The heaps of all tiles of a query are merged. The result is exact.

Vectors that are null, zero, empty or hold null or non-finite components take no part, nor do rows
without an id. Only vectors of the same number of components are compared. A query never finds its
own row. Rows that repeat an id are each a candidate and, where the id is a query's, a query of its own;
what they find is listed under the one id. Other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Vectors of a block, and candidates of a product inside a tile.
BLOCK, STEP = 4096, 1024


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 components, step of each vector, and sum of absolute components."""
    step = np.abs(v).max(1) / 127
    q = np.rint(v / step[:, None]).astype(np.int8)
    return q, step, np.abs(q.astype(np.int64)).sum(1).astype(np.float64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, summed component by component."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def best(k: int, pairs) -> list[tuple[float, int]]:
    """The k best (score, id), largest score first, then smallest id."""
    return heapq.nsmallest(k, pairs, key=lambda p: (-p[0], p[1]))


def search_tile(k: int, q_rows: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c_rows: np.ndarray, c: np.ndarray) -> list[list[tuple[float, int]]]:
    """The k best candidates of each query within a tile."""
    q8, q_step, q_sum = quantise(q)
    exact = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64  # holds each sum exactly
    heaps: list[list[tuple[float, int]]] = [[] for _ in q_rows]
    floor = np.full(len(q_rows), -np.inf)
    for at in range(0, len(c_ids), STEP):
        ids, v = c_ids[at : at + STEP], c[at : at + STEP]
        c8, c_step, c_sum = quantise(v)
        scale = q_step[:, None] * c_step[None, :]
        near = scale * (q8.astype(exact) @ c8.astype(exact).T)
        off = scale * (0.5 * (q_sum[:, None] + c_sum[None, :]) + 0.25 * q.shape[1]) * (1 + 1e-9)
        own = q_rows[:, None] == c_rows[None, at : at + STEP]
        low, high = np.where(own, -np.inf, near - off), np.where(own, -np.inf, near + off)
        if low.shape[1] > k:
            floor = np.maximum(floor, -np.partition(-low, k - 1, axis=1)[:, k - 1])
        rows, cols = np.nonzero((high >= floor[:, None]) & ~own)
        for part in range(0, len(rows), 200_000):
            r, j = rows[part : part + 200_000], cols[part : part + 200_000]
            s = products(q[r], v[j])
            starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            for b, e in zip(starts, np.r_[starts[1:], len(r)], strict=True):
                i = r[b]
                if e - b > 4 * k:  # of many, those that cannot be ahead go before the heap
                    cutoff = np.partition(s[b:e], e - b - k)[e - b - k]
                    keep = b + np.flatnonzero(s[b:e] >= cutoff)
                    keep = keep[np.lexsort((ids[j[keep]], -s[keep]))[:k]]
                else:
                    keep = np.arange(b, e)
                heaps[i] = best(k, [*heaps[i], *zip(s[keep].tolist(), ids[j[keep]].tolist(), strict=True)])
                if len(heaps[i]) == k:  # the k-th is a lower bound too; what equals it stays in, for ties
                    floor[i] = max(floor[i], heaps[i][-1][0] - 1e-12 * abs(heaps[i][-1][0]))
    return heaps


def nearest(vectors: DataFrame, k: int = 20, is_query=None) -> DataFrame:
    """(query_id, rank, vec_id, score) for vectors (vec_id, embedding); ``is_query`` tells the query
    rows, by default those whose vec_id is divisible by 20."""
    v = F.col("embedding").cast("array<double>")
    sound = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where("vec_id is not null and embedding is not null").where(sound)
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col("embedding").alias("v"), F.size("embedding").alias("dim"))
    rows = cut(rows, "vectors")  # where the numbers of the rows stay what they are
    n_c = rows.count()
    queries = rows.where(F.col("id") % 20 == 0 if is_query is None else is_query(F.col("id")))
    n_q = queries.count()
    c_blocks, q_blocks = max(1, -(-n_c // BLOCK)), max(1, -(-n_q // BLOCK))
    block = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumns({"qb": block(q_blocks, 1), "side": F.lit(0)}).withColumn("cb", every(c_blocks))
    right = rows.withColumns({"cb": block(c_blocks, 2), "side": F.lit(1)}).withColumn("qb", every(q_blocks))

    def tile(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = {"row": [], "query_id": [], "ids": [], "scores": []}
        if len(q) and len(c):
            stack = lambda s: np.array(s.tolist(), np.float64)
            found_by = search_tile(k, q["row"].to_numpy(), stack(q["v"]), c["id"].to_numpy(), c["row"].to_numpy(), stack(c["v"]))
            for row, i, found in zip(q["row"], q["id"], found_by, strict=True):
                out["row"].append(row)
                out["query_id"].append(i)
                out["ids"].append([x for _, x in found])
                out["scores"].append([s for s, _ in found])
        return pd.DataFrame(out, dtype=object)

    keys = ["dim", "qb", "cb"]
    tiles = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(tile, "row long, query_id long, ids array<long>, scores array<double>")

    def merge(batches):
        own, held = None, []
        done: list[tuple] = []

        def close():
            done.extend((own[1], r + 1, i, s) for r, (s, i) in enumerate(best(k, held)))

        def frame():
            out = pd.DataFrame(done, columns=["query_id", "rank", "vec_id", "score"])
            done.clear()
            return out

        for pdf in batches:
            for *q, ids, scores in zip(pdf["row"], pdf["query_id"], pdf["ids"], pdf["scores"], strict=True):
                if q != own:
                    close()
                    own, held = q, []
                held = best(k, [*held, *zip(map(float, scores), map(int, ids), strict=True)])
            yield frame()
        close()
        yield frame()

    merged = tiles.repartition("row").sortWithinPartitions("row")
    return merged.mapInPandas(merge, "query_id long, rank int, vec_id long, score double")
