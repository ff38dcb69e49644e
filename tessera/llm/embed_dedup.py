"""Embedding near-dedup with an inverted multi-index.

Equal vectors are one class, with a number of its own. Independent codebooks on the two halves of the unit vectors, fitted on a bounded
sample of classes (``SAMPLE``), form a product grid; every class is filed in the cell of its two nearest centroids.
A class visits cells in multi-sequence order (ascending sum of the two halves' distances) until the target
recall: the number of visits is that at which ``RECALL`` of the sample's true links, and of links made by
turning sample vectors to exactly the threshold, are reached; where that takes more than ``MAX_VISITS`` the codebooks are
halved until it doesn't (a grid of so few cells is visited whole). Beyond ``CELL_ROWS * MAX_CENTROIDS ** 2`` classes cells grow and
are cut into blocks. Pairs that meet in a cell are verified in
double precision. A pair that meets in two cells counts in the smaller one, so link counts need no list of
pairs; a cell gives sums for each class and a spanning forest of its links.

Cells whose members or visitors exceed a block are cut into blocks by hash, each pair of blocks a task's
group of its own, so that a hot cell spreads out.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their
own component; vectors of different lengths don't link; a row with a null vec_id links with nothing and has a
null component; rows that repeat a vec_id count as different vectors with one id; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize
from .simhash import reduce_links
from .vectors import matrix, numeric, usable

SAMPLE, RECALL, MAX_VISITS = 20000, 0.95, 64
#: Classes that a cell should hold, and the most centroids of a half.
CELL_ROWS, MAX_CENTROIDS = 64, 1024
MEMBER_BLOCK, VISITOR_BLOCK = 2048, 8192


@dataclass
class Grid:
    """The codebooks of the two halves and how many cells a class visits."""

    first: np.ndarray
    second: np.ndarray
    visits: int

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return _squared(unit[:, :half], self.first), _squared(unit[:, half:], self.second)

    def traverse(self, unit: np.ndarray) -> np.ndarray:
        """(rows, visits) cell numbers, nearest first.

        Multi-sequence order needs no more than the ``visits`` nearest centroids of a half, and of these only
        pairs of ranks (i, j) with (i + 1) * (j + 1) <= visits."""
        d1, d2 = self.distances(unit)
        t = min(self.visits, d1.shape[1] * d2.shape[1])
        o1, o2 = np.argsort(d1, axis=1, kind="stable")[:, :t], np.argsort(d2, axis=1, kind="stable")[:, :t]
        ranks = np.array([(i, j) for i in range(o1.shape[1]) for j in range(o2.shape[1]) if (i + 1) * (j + 1) <= t])
        c1, c2 = o1[:, ranks[:, 0]], o2[:, ranks[:, 1]]
        total = np.take_along_axis(d1, c1, axis=1) + np.take_along_axis(d2, c2, axis=1)
        near = np.argsort(total, axis=1, kind="stable")[:, :t]
        cells = c1.astype(np.int64) * len(self.second) + c2
        return np.take_along_axis(cells, near, axis=1)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    # scale first: squares of huge or tiny components would leave the range of doubles
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Lloyd's centroids of the rows of x."""
    distinct = np.unique(x, axis=0)
    c = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)].copy()
    for _ in range(rounds):
        own = _squared(x, c).argmin(axis=1)
        sums, counts = np.zeros_like(c), np.bincount(own, minlength=len(c))
        np.add.at(sums, own, x)
        c[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return c


def fit_grid(sample: np.ndarray, n_classes: int, threshold: float, seed: int = 9) -> Grid:
    """Codebooks from sampled unit vectors, and the visits that reach the target recall."""
    rng = np.random.default_rng(seed)
    k = int(min(MAX_CENTROIDS, max(2, round(math.sqrt(n_classes / CELL_ROWS)))))
    half = sample.shape[1] // 2
    some = sample[rng.choice(len(sample), min(2000, len(sample)), replace=False)]
    # links at exactly the threshold: the hardest there are
    turn = rng.normal(size=some.shape)
    turn -= (turn * some).sum(axis=1, keepdims=True) * some
    norm = np.sqrt((turn**2).sum(axis=1, keepdims=True))
    hardest = threshold * some + math.sqrt(max(0.0, 1 - threshold**2)) * turn / np.where(norm > 0, norm, 1)
    pairs = [(some, hardest)]
    true_a, true_b = np.nonzero(np.triu(some @ sample.T >= threshold, 0) & (some @ sample.T < 1 - 1e-12))
    if len(true_a) >= 100:
        pairs.append((some[true_a][:5000], sample[true_b][:5000]))
    while True:
        grid = Grid(codebook(sample[:, :half], k, rng), codebook(sample[:, half:], k, rng), 1)
        grid.visits = max(_visits_for(grid, a, b) for a, b in pairs)
        if grid.visits <= MAX_VISITS:
            return grid
        k = max(1, k // 2)


def _visits_for(grid: Grid, a: np.ndarray, b: np.ndarray) -> int:
    """Visits after which RECALL of the pairs met: a visits b's cell, or b visits a's."""
    (a1, a2), (b1, b2) = grid.distances(a), grid.distances(b)
    rank = np.empty(len(a))
    rows = np.arange(len(a))
    step = max(1, (1 << 21) // (len(grid.first) * len(grid.second)))
    for i in range(0, len(a), step):
        s = slice(i, i + step)
        r = rows[s] - i

        def position(d1, d2, h1, h2, r=r):
            at = d1[r, h1] + d2[r, h2]
            return ((d1[:, :, None] + d2[:, None, :]) < at[:, None, None]).sum(axis=(1, 2))

        there = position(a1[s], a2[s], b1[s].argmin(axis=1), b2[s].argmin(axis=1))
        back = position(b1[s], b2[s], a1[s].argmin(axis=1), a2[s].argmin(axis=1))
        rank[s] = np.minimum(there, back)
    return int(np.quantile(rank, RECALL, method="higher")) + 1


def _block_links(members: pa.Table, visitors: pa.Table, threshold: float) -> pa.Table:
    """(a, b, n): for b null, n vectors more that those of class a link with; else a link of the forest."""
    empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    if not members.num_rows or not visitors.num_rows:
        return empty
    y, x = unit_rows(matrix(members.column("embedding"))), unit_rows(matrix(visitors.column("embedding")))
    y_id, x_id = members.column("cid").to_numpy(), visitors.column("cid").to_numpy()
    y_size, x_size = members.column("size").to_numpy(), visitors.column("size").to_numpy()
    x_home = visitors.column("home").to_numpy()
    cell = int(members.column("cell")[0].as_py())
    y_visits = members.column("visits").combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    nodes, inverse = np.unique(np.concatenate([x_id, y_id]), return_inverse=True)
    x_node, y_node = inverse[: len(x)], inverse[len(x) :]
    added, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
    for i in range(0, len(x), 1024):
        p, q = np.nonzero(x[i : i + 1024] @ y.T >= threshold - 1e-9)
        p += i
        # the product of matrices rounds in its own way: decide the close ones pair by pair
        cos = np.einsum("ij,ij->i", x[p], y[q])
        same_home = x_home[p] == cell
        both = (y_visits[q] == x_home[p][:, None]).any(axis=1)
        mine = np.where(same_home, x_id[p] < y_id[q], ~both | (cell < x_home[p]))
        keep = (cos >= threshold) & mine & (x_id[p] != y_id[q])
        p, q = p[keep], q[keep]
        if len(p):
            np.add.at(added, x_node[p], y_size[q])
            np.add.at(added, y_node[q], x_size[p])
            known = np.flatnonzero(root != np.arange(len(nodes)))
            root = reduce_links(np.concatenate([x_node[p], known]), np.concatenate([y_node[q], root[known]]), len(nodes))
    on, linked = np.flatnonzero(added), np.flatnonzero(root != np.arange(len(nodes)))
    return pa.table({
        "a": pa.array(np.concatenate([nodes[on], nodes[linked]]), pa.int64()),
        "b": pa.concat_arrays([pa.nulls(len(on), pa.int64()), pa.array(nodes[root[linked]], pa.int64())]),
        "n": pa.array(np.concatenate([added[on], np.zeros(len(linked), np.int64)]), pa.int64())})


def near_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), numeric(vectors).alias("embedding"))
    on = F.col("vec_id").isNotNull() & usable(F.col("embedding"))
    rows = rows.withColumn("on", on).withColumn("k1", F.xxhash64("embedding")).withColumn("k2", F.xxhash64(F.lit(1), "embedding"))
    valid = rows.where("on")
    classes = valid.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))
    # several classes may have one smallest vec_id: numbered once and written, so that a class keeps its number
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()))
    n = classes.count()
    # as Arrow columns: rows of Python numbers would take ten times the driver's memory
    sample = classes.select("dim", "embedding").orderBy(F.xxhash64(F.lit(5), "k1"), "k2").limit(SAMPLE).toArrow()
    dims = sample.column("dim").to_numpy()
    grids = {}
    for d in np.unique(dims).tolist():
        x = matrix(sample.column("embedding").filter(pa.array(dims == d)))
        grids[d] = fit_grid(unit_rows(x), max(1, n * len(x) // len(dims)), threshold)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cells: list[np.ndarray | None] = [None] * len(dims)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                unit = unit_rows(matrix(batch.column("embedding").take(pa.array(at))))
                # a length that the sample lacks has one cell for all
                got = grids[d].traverse(unit) if d in grids else np.zeros((len(at), 1), np.int64)
                for i, row in zip(at.tolist(), got, strict=True):
                    cells[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int64()))], names=[*batch.schema.names, "visits"])

    kind = classes.schema["embedding"].dataType.simpleString()
    filed = materialize(classes.select("cid", "size", "embedding", "dim").mapInArrow(file, f"cid long, size long, embedding {kind}, dim int, visits array<long>"))
    home = F.col("visits")[0]
    spread = filed.select("dim", "cid", "size", home.alias("home"), F.explode("visits").alias("cell"))
    load = spread.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n_visitors"), F.count(F.when(F.col("home") == F.col("cell"), 1)).alias("n_members"))
    load = materialize(load.select("dim", "cell", F.ceil(F.col("n_members") / MEMBER_BLOCK).cast("int").alias("m_blocks"), F.ceil(F.col("n_visitors") / VISITOR_BLOCK).cast("int").alias("v_blocks")).where("m_blocks > 0"))

    def own_block(blocks: str):
        return F.pmod(F.xxhash64(F.lit(3), "cid"), F.col(blocks)).cast("int")

    def all_blocks(blocks: str):
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    keys = ("dim", "cell", "mb", "vb")
    members = filed.withColumn("cell", home).join(load, ["dim", "cell"]).withColumn("mb", own_block("m_blocks")).withColumn("vb", all_blocks("v_blocks")).select(*keys, "cid", "size", "embedding", "visits")
    again = filed.select(*(F.col(c).alias(c) for c in filed.columns))  # columns of its own, for the cogroup
    visitors = again.select("dim", "cid", "size", "embedding", home.alias("home"), F.explode("visits").alias("cell")).join(load, ["dim", "cell"]).withColumn("vb", own_block("v_blocks")).withColumn("mb", all_blocks("m_blocks")).select(*keys, "cid", "size", "embedding", "home")
    met = members.groupBy(*keys).cogroup(visitors.groupBy(*keys)).applyInArrow(lambda m, v: _block_links(m, v, threshold), "a long, b long, n long")
    met = materialize(met)
    counts = met.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("more"))
    labels = connected_components(met.where("b is not null").select("a", "b")).select(F.col("node").alias("cid"), F.col("component").alias("root"))
    info = classes.select("k1", "k2", "cid", "rep", "size").join(counts, "cid", "left").join(labels, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    lowest = info.groupBy("root").agg(F.min("rep").alias("component_id"))
    info = info.join(lowest, "root").select("k1", "k2", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id")
    linked = valid.select("vec_id", "k1", "k2").join(info, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("on")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
