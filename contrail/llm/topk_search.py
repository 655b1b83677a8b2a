"""Exact top-k search by Fagin's threshold algorithm (operator 6).

Vectors become integers, floor(256 * component). Candidates are dealt out by hash into blocks; each block keeps one sorted
list a dimension. A query reads the lists in step, from the end that its component's sign favours; each vector met for
the first time is scored in full (random access). The sum of the query's components times the values at the current
depth bounds all vectors not yet met; when the k-th score so far beats that bound the block is done. The best of all
blocks are merged. Depth grows by doubling, so that NumPy scores whole strides at a time.

Vectors that are null, or hold null or non-finite components, take no part, as queries or candidates; nor do vectors of
another length than most. Ties go to the smaller id. A query's own id is never its candidate, so repeated rows of one id
do not find each other; repeated rows of another id are one candidate each; different vectors under one query id share one ranking. Fewer candidates than k give all of them. An
empty table gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, BLOCK, QUERY_BLOCK, STRIDE = 5, 4096, 2048, 8
FOUND = "query_id bigint, vec_id bigint, score bigint"


def usable(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): vectors without null or non-finite components, as floor(scale * component)."""
    x = F.col("embedding")
    finite = F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    whole = F.transform(x, lambda y: F.floor(F.lit(float(scale)) * y.cast("double")).cast("bigint"))
    return vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite).select(F.col("vec_id").cast("bigint").alias("vec_id"), whole.alias("v"))


class Lists:
    """One sorted list of (value, row) for each dimension of a block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.order = np.argsort(self.vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(self.vectors, self.order, axis=0)

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best, ties to the smaller id."""
        n = len(self.ids)
        dims = np.flatnonzero(query)
        up = query[dims] > 0
        met = self.ids == query_id
        best, scores, depth, stride = np.empty(0, np.int64), np.empty(0, np.int64), 0, STRIDE
        if not len(dims):
            best = np.flatnonzero(~met)[:k]
            return self.ids[best], np.zeros(len(best), np.int64)
        while depth < n:
            stop = min(n, depth + stride)
            low, high = self.order[depth:stop, dims[~up]], self.order[n - stop : n - depth, dims[up]]
            new = np.unique(np.concatenate([low.ravel(), high.ravel()]))
            new = new[~met[new]]
            met[new] = True
            best, scores = np.r_[best, new], np.r_[scores, self.vectors[new] @ query]
            order = np.lexsort((best, -scores))[:k]
            best, scores = best[order], scores[order]
            if len(best) == k or met.all():
                edge = np.where(up, self.values[n - stop, dims], self.values[stop - 1, dims])
                if met.all() or scores[-1] > edge @ query[dims]:
                    break
            depth, stride = stop, stride * 2
        return self.ids[best], scores


def _search(k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        if candidates.num_rows and queries.num_rows:
            matrix = lambda t: np.asarray(t.column("v").combine_chunks().flatten()).reshape(t.num_rows, -1)
            lists = Lists(np.asarray(candidates.column("vec_id")), matrix(candidates))
            for query_id, query in zip(np.asarray(queries.column("vec_id")), matrix(queries), strict=True):
                found.append((query_id, *lists.top(query_id, query, k)))
        ids = np.repeat([x[0] for x in found], [len(x[1]) for x in found]).astype(np.int64) if found else np.empty(0, np.int64)
        flat = [np.concatenate([x[c] for x in found]) if found else np.empty(0, np.int64) for c in (1, 2)]
        return pa.table({"query_id": ids, "vec_id": flat[0].astype(np.int64), "score": flat[1].astype(np.int64)})

    return run


def search(vectors: DataFrame, is_query: Column, k: int = K, block: int = BLOCK, query_block: int = QUERY_BLOCK, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each row for which is_query holds, over all other rows."""
    rows = usable(vectors, scale)
    sizes = {r["d"]: (r["n"], r["q"]) for r in rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).orderBy(F.desc("n"), "d").limit(1).collect()}
    width, (n, q) = next(iter(sizes.items()), (0, (0, 0)))
    rows = rows.filter(F.size("v") == width)
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-q // query_block))
    key = lambda m: F.pmod(F.xxhash64("vec_id", "v"), F.lit(m))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(m - 1).cast("bigint")))
    candidates = rows.select("vec_id", "v", key(blocks).alias("block"), every(query_blocks).alias("query_block"))
    queries = rows.filter(is_query).dropDuplicates(["vec_id", "v"]).select("vec_id", "v", every(blocks).alias("block"), key(query_blocks).alias("query_block"))
    found = candidates.groupBy("block", "query_block").cogroup(queries.groupBy("block", "query_block")).applyInArrow(_search(k), FOUND)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
