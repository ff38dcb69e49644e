"""Approximate nearest neighbours by collision counting over query-centred windows.

Index: the vectors are dealt to shards of bounded size; in a shard each of ``PROJECTIONS`` random projections
has its own sorted array. Search: around the query's own projection a window opens in every array and
widens level by level (virtual rehashing: no bucket is ever built, a wider radius only extends the
windows at both ends). A vector met in at least the threshold number of windows is verified by its true
distance. A shard's search ends when k verified vectors lie within the level's radius, or when the
windows cover the shard. Every shard answers every query; the shards' k best are merged.

Threshold and windows: a vector at distance s falls in a window of half-width HALF * R with probability
P(|z| <= HALF * R / s), z standard normal. A vector at distance R must be met with probability ``CATCH`` or more.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
with a null vec_id; vectors of different lengths are not compared; of rows that repeat a vec_id the
smallest vector counts; equal distances go to the smaller vec_id; a distance beyond the range of doubles is infinite;
further columns are ignored.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .vectors import distances, matrix, numeric, usable

PROJECTIONS, HALF, GROWTH, CATCH, SEED = 64, 1.0, 1.12, 0.93, 3
#: A shard's rows: the table in 64 parts, but never fewer or more than these.
LEAST_ROWS, MOST_ROWS = 8192, 65536
#: Queries that meet a shard at once.
QUERY_BLOCK = 16384


def threshold(m: int = PROJECTIONS) -> int:
    """Collisions that a vector at exactly the radius reaches with probability CATCH."""
    p = 2 * NormalDist().cdf(HALF) - 1
    return max(1, math.floor(m * p + NormalDist().inv_cdf(1 - CATCH) * math.sqrt(m * p * (1 - p))))


class Shard:
    """Sorted arrays of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, m: int = PROJECTIONS):
        self.ids, self.vectors = ids, vectors
        # huge vectors are projected in smaller units, so that no projection overflows
        self.unit = 2.0**-600 if np.abs(vectors).max(initial=0.0) > 2.0**400 else 1.0
        self.axes = np.random.default_rng(SEED).normal(size=(vectors.shape[1], m))
        projected = ((vectors * self.unit) @ self.axes).T
        self.order = np.argsort(projected, axis=1, kind="stable").astype(np.int32)
        values = np.take_along_axis(projected, self.order, axis=1)
        # all arrays in one, each shifted beyond the last: one binary search serves every projection
        self.low_end = values[:, 0]
        self.width = float((values[:, -1] - values[:, 0]).max(initial=0.0)) * 2 + 1.0
        self.shift = np.arange(m) * self.width
        self.flat = (values - self.low_end[:, None] + self.shift[:, None]).ravel()
        self.need = threshold(m)
        # the first radius: a small part of the typical distance to a few members
        some = vectors[:: max(1, len(vectors) // 64)][:64] * self.unit
        spread = np.sqrt(((some - some.mean(axis=0)) ** 2).sum(axis=1)).mean()
        self.start = max(float(spread) / 8, 1e-9 * float(np.abs(some).max(initial=0.0)), 1e-300)

    def positions(self, at: np.ndarray, side: str) -> np.ndarray:
        """Where each projection's value falls in its own sorted array."""
        n = self.order.shape[1]
        inside = np.clip(at - self.low_end, -0.25 * self.width, 0.74 * self.width)  # stays within the array's own stretch
        return np.searchsorted(self.flat, inside + self.shift, side=side) - np.arange(len(at)) * n

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest found, nearest first."""
        n = len(self.ids)
        at = np.nan_to_num((query * self.unit) @ self.axes)
        low = self.positions(at, "left")
        high = low.copy()
        count = np.zeros(n, np.int32)
        distance = np.full(n, np.inf)
        mine = self.ids == own
        seen = mine.copy()
        radius, rest = self.start, n - int(mine.sum())
        while True:
            lo, hi = np.minimum(self.positions(at - HALF * radius, "left"), low), np.maximum(self.positions(at + HALF * radius, "right"), high)
            parts = [self.order[j, lo[j] : low[j]] for j in np.flatnonzero(lo < low).tolist()]
            parts += [self.order[j, high[j] : hi[j]] for j in np.flatnonzero(hi > high).tolist()]
            low, high = lo, hi
            if parts:
                count += np.bincount(np.concatenate(parts), minlength=n).astype(np.int32)
            covered = bool((low == 0).all() and (high == n).all())
            new = np.flatnonzero(~seen & ((count >= self.need) | covered))
            if len(new):
                seen[new] = True
                distance[new] = distances(self.vectors[new], query)
            if covered or rest <= 0:
                break
            if int((distance * self.unit <= radius).sum()) >= k:
                break
            radius *= GROWTH if radius > 4 * self.start else 1.6
        found = np.flatnonzero(seen & ~mine)
        if len(found) > k:
            kth = np.partition(distance[found], k - 1)[k - 1]
            found = found[distance[found] <= kth]
        best = found[np.lexsort((self.ids[found], distance[found]))][:k]
        return self.ids[best], distance[best]


def _distinct(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids in ascending order and their vectors; of repeated ids the smallest vector."""
    ids, x = table.column("vec_id").to_numpy(), matrix(table.column("embedding"))
    order = np.lexsort((*x.T[::-1], ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    keep = np.append(True, ids[1:] != ids[:-1])
    return ids[keep], x[keep]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of each query's k nearest in ``vectors``.

    Both tables have vec_id and embedding; a query is never its own neighbour."""

    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), numeric(df).alias("embedding"))
        return rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).withColumn("dim", F.size("embedding"))

    rows, asked = clean(vectors), clean(queries)
    n, n_asked = rows.count(), asked.count()
    shard_rows = min(MOST_ROWS, max(LEAST_ROWS, n // 64))
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_asked // QUERY_BLOCK))
    # rows meet every block of queries and queries every shard: the stated query set against all rows, in blocks
    left = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def run(members: pa.Table, wanted: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if members.num_rows and wanted.num_rows:
            shard = Shard(*_distinct(members))
            for own, query in zip(*_distinct(wanted), strict=True):
                ids, distances = shard.search(query, own, k)
                out[0].append(np.full(len(ids), own))
                out[1].append(ids)
                out[2].append(distances)
        none = [np.empty(0)]
        return pa.table({
            "query_id": pa.array(np.concatenate(out[0] or none).astype(np.int64)), "vec_id": pa.array(np.concatenate(out[1] or none).astype(np.int64)),
            "score": pa.array(np.concatenate(out[2] or none))})

    keys = ("dim", "shard", "block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
