"""Exact nearest neighbours of a stated set of queries, by matrix products of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselle.session import cut

BLOCK = 4096
PART = 65_536


def _cells(dim: int, k: int):
    """Rows sorted by (cell, role): the best k of each query (role 0) among the items (role 1) of its cell."""

    def best(ids, x, held, others, y):
        c = np.round(x @ y.T, 9)
        c[ids[:, None] == others[None, :]] = -2
        rank = np.lexsort((np.broadcast_to(others, c.shape), -c), axis=1)[:, :k]
        got = np.take_along_axis(c, rank, axis=1), others[rank]
        if held is None:
            return got
        s, i = np.concatenate([held[0], got[0]], axis=1), np.concatenate([held[1], got[1]], axis=1)
        rank = np.lexsort((i, -s), axis=1)[:, :k]
        return np.take_along_axis(s, rank, axis=1), np.take_along_axis(i, rank, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, x, held = None, np.zeros(0, np.int64), np.zeros((0, dim)), None

        def emit():
            q, s, i = np.repeat(ids, held[0].shape[1]), held[0].reshape(-1), held[1].reshape(-1)
            ok = s > -2
            return pa.RecordBatch.from_arrays([pa.array(q[ok]), pa.array(i[ok]), pa.array(s[ok])], names=["query", "id", "similarity"])

        for b in batches:
            if not b.num_rows:
                continue
            c, role, i = (b.column(n).to_numpy() for n in range(3))
            y = np.asarray(b.column(3).flatten()).reshape(-1, dim).astype(np.float64)
            y /= np.linalg.norm(y, axis=1, keepdims=True)
            mark = c * 2 + role
            cuts = [0, *(np.flatnonzero(mark[1:] != mark[:-1]) + 1), len(mark)]
            for lo, hi in zip(cuts, cuts[1:]):
                if c[lo] != cell:
                    if held is not None:
                        yield emit()
                    cell, ids, x, held = c[lo], np.zeros(0, np.int64), np.zeros((0, dim)), None
                if role[lo] == 0:
                    ids, x = np.concatenate([ids, i[lo:hi]]), np.concatenate([x, y[lo:hi]])
                else:
                    for a in range(lo, hi, 4096 if len(ids) else hi):
                        if len(ids):
                            held = best(ids, x, held, i[a : min(hi, a + 4096)], y[a : min(hi, a + 4096)])
        if held is not None:
            yield emit()

    return run


def batch_nearest(items: DataFrame, asked: Column, k: int, dim: int = 64) -> DataFrame:
    """(query, id, similarity, rank) of the k nearest others of every item that meets ``asked``, against all items.

    Asked rows and items are dealt out by a hash of the id over blocks of about BLOCK and PART rows, and every block of queries meets every
    part of the items in a cell of its own: one pass, whatever the number of blocks. A cell holds its queries' k best only, which are
    then merged. Vectors of the wrong size, all zero or with a null or NaN take no part; no asked row gives an empty result.
    """
    ok = (F.size("embedding") == dim) & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v)) & F.exists("embedding", lambda v: v != 0)
    items = items.where(ok & F.col("id").isNotNull())
    queries = cut(items.where(asked).select(F.col("id").cast("bigint").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")))
    items = items.select(F.col("id").cast("bigint").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    high, wide = max(1, -(-queries.count() // BLOCK)), max(8, -(-items.count() // PART))
    block, part = F.pmod(F.xxhash64("id"), F.lit(high)), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(wide))
    one = queries.select(F.explode(F.sequence(block * wide, block * wide + wide - 1)).alias("cell"), F.lit(0).alias("role"), "id", "embedding")
    two = items.select(F.explode(F.sequence(part, part + (high - 1) * wide, F.lit(wide).cast("bigint"))).alias("cell"), F.lit(1).alias("role"), "id", "embedding")
    rows = one.union(two).repartition(high * wide, "cell").sortWithinPartitions("cell", "role")
    near = rows.mapInArrow(_cells(dim, k), "query bigint, id bigint, similarity double")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
