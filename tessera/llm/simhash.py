"""SimHash near-dedup with pivot distance tables.

Fingerprints: words of the lower-cased text, shingles of ``width`` words, XXH64 of each; a bit is 1 if set in
over half of the hashes. Hashing is vectorised over all shingles of a batch.

Links: two fingerprints at ``radius`` or fewer differing bits. Distances to reference fingerprints
(pivots) are coordinates in which linked fingerprints differ by at most ``radius`` (triangle
inequality). Identical fingerprints are one class. Classes are dealt by blocks of their bits: of b blocks a linked pair
differs in ``radius`` at most, so it agrees on all the others of one choice of b - ``radius``; b grows by one or two with the table,
which changes the sizes of the cells and never the links (radius 2: 3, 6 or 10 copies of a class for any number of classes). In a cell
the distance table discards pairs whose largest coordinate difference exceeds ``radius`` and the survivors'
bits are compared; long cells are first split at the median distance to a pivot, with an overlap of ``radius``, and cells of more than
``HOT`` classes are cut into blocks, each pair of blocks a task's group of its own. A cell gives a spanning
forest of its links, never its pairs; the components of the forests are those of all links.

Defined cases: no words (null, empty or blank text) gives fingerprint zero, which links like any other; a
null doc_id gets its group's component (null where the group has no other id); repeated rows share a
class; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize

SEED = 42
#: Bytes of normalised text that are hashed at once.
SLAB = 1 << 18
#: Hashes whose bits are counted at once (a multiple of 255): small enough to stay in the cache.
BLOCK = 255 * 64
#: Fixed values of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Classes that cells should hold on average, that one task's group may hold before it is cut into blocks, of a block, and of a leaf.
CELL_ROWS, HOT, CUT, LEAF = 64, 8192, 2048, 256
#: Cells of so many classes are compared by shifts over all cells at once.
SHORT = 32
N_PIVOTS = 48

_NORMAL = bytes((b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b) for b in range(256))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64_slices(data: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of data[starts[i]:ends[i]] for all i."""
    n = len(starts)
    size = (ends - starts).astype(np.int64)
    padded = data + bytes(8)
    at64 = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    at32 = np.ndarray((len(data) + 1,), "<u4", buffer=padded, strides=(1,))
    at8 = np.frombuffer(padded, np.uint8)
    h = np.full(n, np.uint64(seed) + P5, np.uint64) + size.astype(np.uint64)
    for lane in range(3):
        on = np.flatnonzero((size >= 8 * (lane + 1)) & (size < 32))
        if not len(on):
            break
        k = _rotl(at64[starts[on] + 8 * lane] * P2, 31) * P1
        h[on] = _rotl(h[on] ^ k, 27) * P1 + P4
    on = np.flatnonzero(((size & 7) >= 4) & (size < 32))
    if len(on):
        k = at32[starts[on] + (size[on] & ~7)].astype(np.uint64) * P1
        h[on] = _rotl(h[on] ^ k, 23) * P2 + P3
    for i in range(3):
        on = np.flatnonzero(((size & 3) > i) & (size < 32))
        if len(on):
            k = at8[starts[on] + (size[on] & ~3) + i].astype(np.uint64) * P5
            h[on] = _rotl(h[on] ^ k, 11) * P1
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(size >= 32).tolist():
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]], seed)
    return h


def _bit_counts(h: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """(len(segments), 64) counts of set bits of h[segments[i]:segments[i + 1]]; no segment is empty."""
    # byte-wide counters hold 255 at most: cut the segments into pieces that short
    pieces = np.unique(np.concatenate([segments, np.arange(0, len(h), 255)]))
    counts = np.empty((len(pieces), 64), np.uint8)
    for low in range(0, len(h), BLOCK):
        # a byte for each bit; eight of these counters are added as one 64-bit integer
        spread = np.unpackbits(h[low : low + BLOCK].view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
        i, j = np.searchsorted(pieces, (low, low + BLOCK))
        counts[i:j] = np.add.reduceat(spread, pieces[i:j] - low, axis=0).view(np.uint8).reshape(-1, 64)
    return np.add.reduceat(counts.astype(np.int64), np.searchsorted(pieces, segments), axis=0)


def fingerprints(texts: list[str | None], width: int = 3) -> np.ndarray:
    """64-bit fingerprints of whole texts."""
    counts, totals = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    slab: list[bytes] = []
    owners: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if not slab:
            return
        data = b" ".join(slab)
        raw = np.frombuffer(data, np.uint8)
        space = np.flatnonzero(raw == 32)
        starts, ends = np.append(0, space + 1), np.append(space, len(raw))
        # number of each word's text, from where the joined texts start
        first = np.cumsum([0, *(len(x) + 1 for x in slab[:-1])])
        text_of = np.searchsorted(first, starts, side="right") - 1
        n_words = np.bincount(text_of, minlength=len(slab))
        begin = np.concatenate([[0], np.cumsum(n_words)[:-1]])
        n_shingles = np.maximum(n_words - width + 1, 1)
        shingle_text = np.repeat(np.arange(len(slab)), n_shingles)
        offset = np.arange(len(shingle_text)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles)
        word = begin[shingle_text] + offset
        last = np.minimum(word + width - 1, begin[shingle_text] + n_words[shingle_text] - 1)
        h = xxh64_slices(data, starts[word], ends[last])
        segments = np.cumsum(n_shingles) - n_shingles
        got = _bit_counts(h, segments)
        for i, owner in enumerate(owners):
            counts[owner] += got[i]
            totals[owner] += n_shingles[i]
        slab.clear()
        owners.clear()
        held = 0

    for i, text in enumerate(texts):
        words = (text or "").encode("utf-8").translate(_NORMAL).split(b" ")
        words = [w for w in words if w]
        if not words:
            continue
        # a long text goes in parts that repeat the width - 1 words where they meet
        total = 0
        start = 0
        for j, w in enumerate(words):
            total += len(w) + 1
            if total >= SLAB and j + 1 < len(words) and j + 1 - start >= width:
                slab.append(b" ".join(words[start : j + 1]))
                owners.append(i)
                flush()
                start, total = j + 2 - width, 0
        part = words[start:]
        if start == 0 or len(part) >= width:
            slab.append(b" ".join(part))
            owners.append(i)
            held += total
        if held >= SLAB:
            flush()
    flush()
    bits = (counts * 2 > totals[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


def with_fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprints as signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints(batch.column("text").to_pylist(), width).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def pivots(n: int = N_PIVOTS, seed: int = 7) -> np.ndarray:
    """Reference fingerprints, the same in every process."""
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False)


def distance_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """(len(fps), len(refs)) Hamming distances."""
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)


def reduce_links(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node of its component under links a[i] - b[i]."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        if np.array_equal(ra, rb):
            break
        low = np.minimum(ra, rb)
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def _verified(fps: np.ndarray, table: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of ``left`` x ``right`` (indices) that the table doesn't discard."""
    i, j = np.nonzero(np.abs(table[left, 0][:, None] - table[right, 0][None, :]) <= radius)
    i, j = left[i], right[j]
    keep = i < j
    i, j = i[keep], j[keep]
    for column in range(1, table.shape[1]):
        if len(i) < 64:
            break
        near = np.abs(table[i, column] - table[j, column]) <= radius
        i, j = i[near], j[near]
    near = np.bitwise_count(fps[i] ^ fps[j]) <= radius
    return i[near], j[near]


def link_forest(fps: np.ndarray, radius: int, refs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) index pairs, node > root, that connect what links of ``fps`` connect.

    Splits at the median distance to the most selective pivot; members within ``radius`` above it go to
    both sides. Where no pivot splits well (all members close together) the members themselves serve as
    pivots, and what even these can't split is compared block by block."""
    refs = pivots() if refs is None else refs
    table = distance_table(fps, refs)
    n = len(fps)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [(np.arange(n), 0)]

    def best_split(idx: np.ndarray, columns: list[np.ndarray]) -> tuple[int, np.ndarray, int]:
        size, best, at = len(idx), idx, 0
        for d in columns:
            m = int(np.partition(d, len(d) // 2)[len(d) // 2])
            for cut in (m - 1, m):
                larger = max(int(np.count_nonzero(d <= cut + radius)), int(np.count_nonzero(d > cut)))
                if larger < size:
                    size, best, at = larger, d, cut
        return size, best, at

    while todo:
        idx, depth = todo.pop()
        if len(idx) < 2:
            continue
        if len(idx) > LEAF:
            width = table.shape[1]
            size, d, at = best_split(idx, [table[idx, (4 * depth + c) % width] for c in range(4)])
            if size > 0.75 * len(idx):
                own = fps[idx[:: max(1, len(idx) // 8)][:8]]
                size, d, at = best_split(idx, [*(table[idx, c] for c in range(width)), *distance_table(fps[idx], own).T])
            if size <= 0.85 * len(idx):
                todo += [(idx[d <= at + radius], depth + 1), (idx[d > at], depth + 1)]
                continue
        for p in range(0, len(idx), 512):
            for q in range(p, len(idx), 512):
                found.append(_verified(fps, table, idx[p : p + 512], idx[q : q + 512], radius))
            if len(found) > 64:  # keep a forest, not the pairs
                root = reduce_links(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]), n)
                node = np.flatnonzero(root != np.arange(n))
                found = [(root[node], node)]
    a = np.concatenate([x for x, _ in found] or [np.empty(0, np.int64)])
    b = np.concatenate([y for _, y in found] or [np.empty(0, np.int64)])
    root = reduce_links(a, b, n)
    node = np.flatnonzero(root != np.arange(n))
    return node, root[node]


def cell_masks(n_classes: int, radius: int) -> list[int]:
    """Bit masks of the choices of blocks: any two fingerprints within ``radius`` agree under one of them.

    One to three blocks more than ``radius``: as many as keep cells of random fingerprints at ``CELL_ROWS``, if three suffice."""
    for more in (1, 2, 3):
        b = radius + more
        edges = [64 * i // b for i in range(b + 1)]
        blocks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
        masks = [sum(blocks[i] for i in kept) for kept in combinations(range(b), more)]
        if n_classes <= CELL_ROWS << min(m.bit_count() for m in masks):
            break
    return masks


def cell_links(fps: np.ndarray, keys: np.ndarray, radius: int, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) index pairs that connect what links of ``fps`` within runs of equal ``keys`` connect."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    length = np.diff(np.append(first, len(keys)))
    left = np.repeat(first + length, length) - np.arange(len(keys))  # rows from this one to the cell's end
    mates = np.repeat(length, length)
    some = np.flatnonzero((mates > 1) & (mates <= SHORT))
    table = np.zeros((len(keys), 8), np.int8)
    table[some] = distance_table(fps[some], refs[:8])
    nodes, roots = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    at = some
    for d in range(1, SHORT):
        at = at[left[at] > d]
        if not len(at):
            break
        i = at
        for column in range(table.shape[1]):
            i = i[np.abs(table[i, column] - table[i + d, column]) <= radius]
        i = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= radius]
        nodes.append(i + d)
        roots.append(i)
    for a, n in zip(first[length > SHORT].tolist(), length[length > SHORT].tolist(), strict=True):
        node, root = link_forest(fps[a : a + n], radius, refs)
        nodes.append(a + node)
        roots.append(a + root)
    return np.concatenate(nodes), np.concatenate(roots)


def runs(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table, keys) of whole runs of equal keys in the column ``name``."""
    carry: list[pa.RecordBatch] = []

    def joined(parts):
        table = pa.Table.from_batches(parts)
        return table, table.column(name).to_numpy()

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(name).to_numpy()
        other = np.flatnonzero(keys != keys[-1])
        last = int(other[-1]) + 1 if len(other) else 0
        if last:
            yield joined([*carry, batch.slice(0, last)])
            carry = []
        elif carry and carry[-1].column(name)[0].as_py() != keys[0]:
            yield joined(carry)
            carry = []
        carry.append(batch.slice(last))
    if carry:
        yield joined(carry)


def near_components(fps: DataFrame, radius: int, hot: int = HOT, block: int = CUT) -> DataFrame:
    """(fp, root) for the fingerprints of column fp that link with others."""
    classes = materialize(fps.select("fp").distinct())
    refs = pivots()
    masks = np.array(cell_masks(classes.count(), radius), np.uint64).view(np.int64).tolist()
    celled = classes.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))).alias("mask", "key"))
    heavy = celled.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot)
    blocks = F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int")
    own = celled.join(heavy, ["mask", "key"], "left").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64(F.lit(6), "fp"), F.col("blocks")).cast("int"))
    both = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # two cells that share a number only compare more pairs
    cell = F.xxhash64("mask", "key", F.least("own", "other"), F.greatest("own", "other"))
    dealt = both.select(cell.alias("cell"), "fp").repartition("cell").sortWithinPartitions("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, keys in runs(batches, "cell"):
            own = table.column("fp").to_numpy().view(np.uint64)
            node, root = cell_links(own, keys, radius, refs)
            yield pa.RecordBatch.from_arrays([pa.array(own[node].view(np.int64)), pa.array(own[root].view(np.int64))], names=["a", "b"])

    labels = connected_components(dealt.mapInArrow(run, "a long, b long"))
    return labels.select(F.col("node").alias("fp"), F.col("component").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits) and component_id (smallest doc_id reachable)."""
    fps = materialize(with_fingerprints(docs, width))
    labels = near_components(fps, radius)
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = materialize(classes.join(labels, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(lowest, "root").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one with the smallest doc_id.

    Rows with a null doc_id stay only where their group has no other id; rows that repeat the kept id stay."""
    kept = near_duplicates(docs, width, radius).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["__kept"]), "left_semi")
