"""Exact top-k search by block-at-a-time pruning.

Vectors become whole numbers, floor(256 * x). Each shard of vectors is put in an order that keeps similar ones
together and cut into ranges of BLOCK rows: the blocks, each with a forward index (its rows as one matrix) and
the largest and smallest value of each term. A query orders blocks by their summed term maxima (for negative
weights: minima), scores whole blocks, and stops once a bound falls below its k-th score, so results are exact.
Queries and shards meet in a grid: a shard holds SHARD rows and a query group GROUP rows, whatever the table's
size; each cell gives at most k rows a query, which are merged by score and id.

Rows with a null id, a null vector or null or non-finite components take no part; a shorter vector counts as
padded with zeros (an empty one scores 0 everywhere); repeated ids are rows of their own, but never candidates of a query
of their id, and equal rows (id and vector) ask once; ties go to the smaller id; queries without candidates give no rows; an empty table gives an empty result. Scores are
exact as long as they fit in 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BLOCK, SHARD, GROUP = 64, 8192, 4096
_NONE = np.iinfo(np.int64).min


class Blocks:
    """A shard: rows in range blocks with forward indexes and term bounds."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        lead = np.abs(rows).argmax(1) if rows.shape[1] else np.zeros(len(rows), np.int64)
        order = np.lexsort((ids, np.take_along_axis(rows, lead[:, None], 1)[:, 0] if rows.shape[1] else ids, lead))
        self.ids, self.rows = ids[order], rows[order]
        self.at = np.arange(0, len(ids), BLOCK)
        self.top, self.low = np.maximum.reduceat(self.rows, self.at), np.minimum.reduceat(self.rows, self.at)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of each query's k best rows, best first; missing places have the score _NONE."""
        bound = _dot(np.maximum(queries, 0), self.top) + _dot(np.minimum(queries, 0), self.low)
        order = np.argsort(-bound, 1, kind="stable")
        best = np.full((len(queries), k), _NONE, np.int64)
        who = np.full((len(queries), k), np.iinfo(np.int64).max, np.int64)
        live = np.arange(len(queries))
        for r in range(len(self.at)):
            block = order[live, r]
            go = bound[live, block] >= best[live, -1]
            live, block = live[go], block[go]
            if not len(live):
                break
            by = np.argsort(block, kind="stable")
            cut = np.flatnonzero(np.diff(block[by])) + 1
            for group in np.split(by, cut):
                q, a = live[group], self.at[block[group[0]]]
                ids = self.ids[a : a + BLOCK]
                score = _dot(queries[q], self.rows[a : a + BLOCK])
                score[query_ids[q][:, None] == ids] = _NONE
                better = np.flatnonzero((score >= best[q, -1:]).any(1))
                if len(better):
                    q, score = q[better], score[better]
                    s = np.concatenate([best[q], score], 1)
                    i = np.concatenate([who[q], np.broadcast_to(ids, score.shape)], 1)
                    place = np.argsort(i, 1, kind="stable")
                    s, i = np.take_along_axis(s, place, 1), np.take_along_axis(i, place, 1)
                    place = np.argsort(~s, 1, kind="stable")[:, :k]  # ~s falls as s rises, without overflow
                    best[q], who[q] = np.take_along_axis(s, place, 1), np.take_along_axis(i, place, 1)
        return best, who


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, exactly: in floats where no sum can pass 2**53."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dims), np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return out


def quantised(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and v, the vector in whole numbers, of each row that takes part."""
    x = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    x = x.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))))
    return x.select("vec_id", F.transform("v", lambda y: F.floor(y * scale)).alias("v"))


def search(table: DataFrame, is_query: Column | None = None, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each query (default: ids divisible by 50)."""
    rows = materialize(quantised(table))
    asked = F.col("vec_id") % 50 == 0 if is_query is None else is_query
    n, n_query, dims = rows.agg(F.count("*"), F.coalesce(F.sum(asked.cast("long")), F.lit(0)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    shards, groups = max(1, -(-n // SHARD)), max(1, -(-n_query // GROUP))
    shard, group = F.pmod(F.xxhash64("vec_id"), F.lit(shards)), F.pmod(F.xxhash64(F.col("vec_id"), F.lit(1)), F.lit(groups))
    left = rows.select(shard.cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), "vec_id", "v")
    right = rows.where(asked).distinct().withColumn("ask", F.xxhash64("vec_id", "v")).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), group.cast("int").alias("part"), "vec_id", "v", "ask")

    def cell(docs: pa.Table, queries: pa.Table) -> pa.Table:
        if not docs.num_rows or not queries.num_rows:
            score, found, ids = np.zeros((0, k), np.int64), np.zeros((0, k), np.int64), np.zeros(0, np.int64)
            asks = ids
        else:
            ids, asks = queries["vec_id"].to_numpy(), queries["ask"].to_numpy()
            score, found = Blocks(docs["vec_id"].to_numpy(), _matrix(docs["v"], dims)).search(ids, _matrix(queries["v"], dims), k)
        ok = score != _NONE
        return pa.table({"query_id": np.repeat(ids, k).reshape(-1, k)[ok], "ask": np.repeat(asks, k).reshape(-1, k)[ok], "vec_id": found[ok], "score": score[ok]})

    cell.__annotations__ = {"docs": pa.Table, "queries": pa.Table, "return": pa.Table}
    found = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(cell, "query_id long, ask long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "ask").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, q.e AS ask, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 50 = 0) q JOIN v ON true AND v.vec_id <> q.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, ask ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
