"""MinHash candidates: which of many sets may be alike, without comparing all pairs.

A set of 32-bit hashes gets ``N`` minima: the least and the greatest product with each of N / 2 multipliers; of each, 8 bits are kept (its code). Two sets
agree on a code with a probability of about their Jaccard similarity. A band is a choice of codes; sets that agree
on all codes of any band share a bucket. Bands are the same for every number of sets, so which pairs meet doesn't depend on
the size of the table. Of bucket mates, those whose ``PLANES`` lowest bits of the codes differ in more than ``loose`` codes
aren't candidates; what is found is for the caller's test to verify.

Keys travel packed: a task sends each part of the key space one binary value with its (key, id, planes) records, so that a
shuffle moves few large rows instead of one for each set and band. A bucket gives the connected groups of its candidates, never
the pairs; equal groups of several bands are one. A pair is verified in the group of the first band that it shares, and only
while the two aren't connected yet. Buckets of more than ``HOT`` sets and groups of more than ``BLOCK`` members are cut into
blocks, each pair of blocks a task's group of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, materialize
from .simhash import reduce_links, runs

N = 64
MULTIPLIERS = np.random.default_rng(11).integers(0, 1 << 31, N // 2, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
NONE = np.uint32(0xFFFFFFFF)
#: Columns of the 64 codes, eight a long; how many bits of a code travel with the keys.
CODES = [f"s{i}" for i in range(N // 8)]
PLANES = 2
#: What travels for each set and band.
RECORD = np.dtype([("key", "<u4"), ("id", "<i8"), *((f"p{i}", "<u8") for i in range(PLANES))])
#: Bands that are dealt in one shuffle, bytes of keys in a part, sets whose keys a task packs at once.
AT_ONCE, PART_BYTES, PACKED_SETS = 8, 8 << 20, 1 << 17
#: The band of groups that another method found: all pairs of their members are candidates.
ANY = -1
#: Rows of a bucket that are compared by shifts over all buckets at once.
SHORT = 48
#: Buckets beyond this are dealt in blocks; rows of such a block, and of a block of a group's members.
HOT, BLOCK = 8192, 2048
#: Pairs that wait for an exact answer and get it at once.
TOGETHER = 4096


def minima(h: np.ndarray, segments: np.ndarray, step: int = 1) -> np.ndarray:
    """(segments, N) minima of the 32-bit hashes h[segments[i]:segments[i + 1]], of every step-th segment."""
    out = np.empty((N, len(segments[::step])), np.uint32)
    product = np.empty_like(h)
    for i, a in enumerate(MULTIPLIERS):
        np.multiply(h, a, out=product)
        out[i] = np.minimum.reduceat(product, segments)[::step]
        out[N // 2 + i] = ~np.maximum.reduceat(product, segments)[::step]
    return out.T


def codes(least: np.ndarray) -> np.ndarray:
    """(sets, N) bytes."""
    mixed = (least ^ (least >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return np.ascontiguousarray((mixed >> np.uint32(24)).astype(np.uint8))


def planes(code: np.ndarray) -> np.ndarray:
    """(PLANES, sets): bit i of the codes as 64-bit words."""
    return np.stack([np.packbits((code >> i) & 1, axis=1, bitorder="little").view("<u8").reshape(-1) for i in range(PLANES)])


def code_columns(code: np.ndarray) -> list[pa.Array]:
    longs = code.view("<i8")
    return [pa.array(np.ascontiguousarray(longs[:, i]), pa.int64()) for i in range(len(CODES))]


def codes_of(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    """(rows, N) bytes from the columns of ``CODES``."""
    return np.ascontiguousarray(np.stack([table.column(c).to_numpy() for c in CODES], axis=1)).view(np.uint8)


def differing(p: np.ndarray, i, j) -> np.ndarray:
    """In how many codes sets i and j differ, by their planes."""
    x = p[0][i] ^ p[0][j]
    for q in p[1:]:
        x |= q[i] ^ q[j]
    return np.bitwise_count(x)


def bucket_groups(keys: np.ndarray, p: np.ndarray, loose: int) -> np.ndarray:
    """For each row the first row of its group of candidates within its run of equal keys."""
    n = len(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    length = np.diff(np.append(first, n))
    left = np.repeat(first + length, length) - np.arange(n)  # rows from this one to the run's end
    at = np.flatnonzero(np.repeat(length <= SHORT, length))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for d in range(1, SHORT):
        at = at[left[at] > d]
        if not len(at):
            break
        near = at[differing(p, at, at + d) <= loose]
        found.append((near, near + d))
    for a, m in zip(first[length > SHORT].tolist(), length[length > SHORT].tolist(), strict=True):
        root = np.arange(m)
        for i in range(0, m, 256):
            rows = np.arange(i, min(i + 256, m))
            x, y = np.nonzero(differing(p, a + rows[:, None], (a + np.arange(m))[None, :]) <= loose)
            known = np.flatnonzero(root != np.arange(m))
            root = reduce_links(np.concatenate([rows[x], known]), np.concatenate([y, root[known]]), m)
        node = np.flatnonzero(root != np.arange(m))
        found.append((a + node, a + root[node]))
    none = np.empty(0, np.int64)
    return reduce_links(np.concatenate([none, *(x for x, _ in found)]), np.concatenate([none, *(y for _, y in found)]), n)


def _mixed(ids: np.ndarray) -> np.ndarray:
    x = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _groups(keys: np.ndarray, ids: np.ndarray, p: np.ndarray, loose: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, n, id) of the groups with two members or more; a group's number depends on its members alone."""
    root = bucket_groups(keys, p, loose)
    size = np.bincount(root, minlength=len(root))
    good = size[root] > 1
    total = np.zeros(len(root), np.uint64)
    np.add.at(total, root[good], _mixed(ids[good]))
    return total[root[good]].view(np.int64), size[root[good]], ids[good]


def _packed(bands: list[tuple[int, ...]], number: int, parts: int):
    """(part, data): the records of the sets whose keys fall in a part; each band has parts of its own."""

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        code = codes_of(table)
        rows = np.empty(len(code), RECORD)
        rows["id"] = table.column("id").to_numpy()
        for i, q in enumerate(planes(code)):
            rows[f"p{i}"] = q
        for k, band in enumerate(bands):
            key = np.zeros(len(code), np.uint32)
            for c in band:
                key = (key << np.uint32(8)) | code[:, c]
            rows["key"] = key
            part = ((key * np.uint32(0x9E3779B1)).astype(np.uint64) * np.uint64(parts)) >> np.uint64(32)
            part = part.astype(np.uint16 if parts <= 1 << 16 else np.uint32)
            order = np.argsort(part, kind="stable")
            edges = np.append(0, np.cumsum(np.bincount(part, minlength=parts)))
            some = np.flatnonzero(np.diff(edges))
            sent = rows[order]
            data = [sent[edges[i] : edges[i + 1]].tobytes() for i in some.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array((number + k) * parts + some, pa.int64()), pa.array(data, pa.binary())], names=["part", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= PACKED_SETS:
                yield from packed(held)
                held = []
        if held:
            yield from packed(held)

    return run


FOUND = "group long, band int, n long, id long, hot boolean, " + ", ".join(f"p{i} long" for i in range(PLANES))


def _found(group, band, n, ids, p=None) -> pa.RecordBatch:
    rows = len(ids)
    longs = [pa.nulls(rows, pa.int64())] * PLANES if p is None else [pa.array(q.view(np.int64)) for q in p]
    return pa.RecordBatch.from_arrays(
        [pa.array(group, pa.int64()), pa.array(np.full(rows, band), pa.int32()), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(np.full(rows, p is not None)), *longs],
        names=["group", "band", "n", "id", "hot", *(f"p{i}" for i in range(PLANES))])


def _unpacked(loose: int, parts: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of the buckets, and the rows of hot buckets as they are (n: how many)."""
        held: dict[int, list[bytes]] = {}  # a task has few parts, of PART_BYTES on average
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
                held.setdefault(part, []).append(data)
        for part in sorted(held):
            rows, band = np.frombuffer(b"".join(held.pop(part)), RECORD), part // parts
            # numbers of key and row are sorted faster than rows by key; most keys occur once
            order = np.sort((rows["key"].astype(np.uint64) << np.uint64(32)) | np.arange(len(rows), dtype=np.uint64))
            key = order >> np.uint64(32)
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            length = np.diff(np.append(first, len(key)))
            mates = np.repeat(length, length)
            at = (order & np.uint64(0xFFFFFFFF)).astype(np.int64)
            if (length > most).any():
                hot, n = rows[at[mates > most]], mates[mates > most]
                yield _found(hot["key"].astype(np.int64) << 8 | band, band, n, hot["id"], [np.ascontiguousarray(hot[f"p{i}"]) for i in range(PLANES)])
            rows = rows[at[(mates > 1) & (mates <= most)]]
            if len(rows):
                group, n, ids = _groups(rows["key"], rows["id"], np.stack([rows[f"p{i}"] for i in range(PLANES)]), loose)
                if len(ids):
                    yield _found(group, band, n, ids)

    return run


def _in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` (group, n, id, ...) once for each pair of blocks (bi <= bj) that its block ``own`` of the group is in."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = rows.withColumn("own", F.pmod(F.xxhash64(F.lit(4), "id"), blocks).cast("int"))
    both = own.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return both.withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other")).drop("other")


def _hot_groups(loose: int):
    def run(table: pa.Table) -> pa.Table:
        p = np.stack([table.column(f"p{i}").to_numpy().view(np.uint64) for i in range(PLANES)])
        group, n, ids = _groups(np.zeros(table.num_rows, np.int64), table.column("id").to_numpy(), p, loose)
        return pa.Table.from_batches([_found(group, table.column("band")[0].as_py(), n, ids)])

    return run


def candidates(sets: DataFrame, bands: list[tuple[int, ...]], loose: int, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(group, band, n, id): groups of sets (columns id, unique, and those of ``CODES``) that may be alike, each with n >= 2
    members; ``band`` is the first in which the group was found."""
    spark = sets.sparkSession
    size = sets.count() * RECORD.itemsize
    parts = max(1, -(-size // PART_BYTES))
    found = None
    for i in range(0, len(bands), AT_ONCE):
        some = bands[i : i + AT_ONCE]
        packed = sets.select("id", *CODES).mapInArrow(_packed(some, i, parts), "part long, data binary")
        dealt = packed.repartition(parts * len(some), "part")
        new = materialize(dealt.mapInArrow(_unpacked(loose, parts, hot), FOUND))
        found = new if found is None else found.unionByName(new)
        del packed, dealt
        free(spark)
    again = _in_blocks(found.where("hot"), block).groupBy("group", "bi", "bj").applyInArrow(_hot_groups(loose), FOUND)
    return found.where("not hot").unionByName(again).groupBy("group", "n", "id").agg(F.min("band").alias("band"))


def _forests(payload: str, bands: list[tuple[int, ...]], loose: int, read: Callable, quickly: Callable, exactly: Callable | None, together: Callable | None = None):
    """(a, b): spanning forests of the links of groups (runs of ``g``), by id. What quickly(x, y) leaves open (None) waits until
    it has linked what it can; exactly(x, y), or together(pairs) for many, then decides for the pairs that aren't connected yet."""
    chosen = np.array(bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        # open pairs of short groups wait beyond their table, so that many get their answers at once
        postponed: list[tuple] = []

        def answered(some: list[tuple]) -> None:
            """Links the (find, join, i, j, item i, item j) that aren't connected yet and that together() says are alike."""
            apart_yet = [x for x in some if x[0](x[2]) != x[0](x[3])]
            for (_, join, i, j, *_), answer in zip(apart_yet, together([x[4:] for x in apart_yet]), strict=True):
                if answer:
                    join(i, j)

        def edges() -> Iterator[pa.RecordBatch]:
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
                left.clear()
                right.clear()

        for table, key in runs(batches, "g"):
            ids, own, band = (table.column(c).to_numpy() for c in ("id", "own", "band"))
            apart = table.column("bi").to_numpy() != table.column("bj").to_numpy()
            code = codes_of(table)
            p = planes(code)
            raw = table.column(payload).combine_chunks()
            root = list(range(len(key)))
            items: list = [None] * len(key)

            def find(i: int, root=root) -> int:
                while root[i] != i:
                    root[i] = i = root[root[i]]
                return i

            def linked(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int]]:
                """Of the pairs those that are verified here: candidates, in the first band that they share, not yet connected."""
                near = ((differing(p, i, j) <= loose) | (band[i] == ANY)) & (~apart[i] | (own[i] != own[j]))
                i, j = i[near], j[near]
                for at in range(0, len(i), 1 << 14):
                    x, y = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
                    shared = (code[x] == code[y])[:, chosen].all(axis=2)
                    good = (band[x] == ANY) | (shared.any(axis=1) & (shared.argmax(axis=1) == band[x]))
                    yield from zip(x[good].tolist(), y[good].tolist(), strict=True)

            def join(i: int, j: int, find=find, root=root, ids=ids) -> None:
                a, b = find(i), find(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    left.append(ids[i])
                    right.append(ids[j])

            def verify(pairs: list[tuple[int, int]], at_once: bool = True) -> None:
                waiting = []
                for i, j in pairs:
                    if find(i) == find(j):
                        continue
                    for k in (i, j):
                        if items[k] is None:
                            items[k] = read(raw[k].as_py())
                    answer = quickly(items[i], items[j])
                    if answer:
                        join(i, j)
                    elif answer is None:
                        waiting.append((i, j))
                if together is None:
                    for i, j in waiting:
                        if find(i) != find(j) and exactly(items[i], items[j]):
                            join(i, j)
                    return
                waiting = [(find, join, i, j, items[i], items[j]) for i, j in waiting]
                if not at_once:
                    postponed.extend(waiting)
                    return
                for at in range(0, len(waiting), TOGETHER):
                    answered(waiting[at : at + TOGETHER])

            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            length = np.diff(np.append(first, len(key)))
            to_end = np.repeat(first + length, length) - np.arange(len(key))  # rows from this one to the group's end
            at = np.flatnonzero(np.repeat(length <= SHORT, length))
            pairs: list[tuple[int, int]] = []
            for d in range(1, SHORT):
                at = at[to_end[at] > d]
                if not len(at):
                    break
                pairs += linked(at, at + d)
            verify(sorted(pairs), at_once=False)
            for a, n in zip(first[length > SHORT].tolist(), length[length > SHORT].tolist(), strict=True):
                for i in range(a, a + n - 1, 64):  # a block of rows against all that follow
                    x = np.repeat(np.arange(i, min(i + 64, a + n)), n)
                    y = np.tile(np.arange(a, a + n), len(x) // n)
                    verify(list(linked(x[x < y], y[x < y])))
            while len(postponed) >= TOGETHER:
                answered(postponed[:TOGETHER])
                del postponed[:TOGETHER]
            yield from edges()
        if postponed:
            answered(postponed)
        yield from edges()

    return run


def links(grouped: DataFrame, sets: DataFrame, payload: str, bands: list[tuple[int, ...]], loose: int, read: Callable, quickly: Callable, exactly: Callable | None = None, block: int = BLOCK, together: Callable | None = None) -> DataFrame:
    """(a, b): spanning forests, by id, of the links among the members of groups (from ``candidates``, or of
    another method with band ``ANY``).

    ``sets`` has id, codes and the column ``payload``; whether two members link is for quickly(read(x), read(y)) to say, or
    where that is None for exactly(x, y); together(pairs), if given, says what exactly would for each of a list of pairs."""
    dealt = _in_blocks(grouped, block).join(sets.select("id", *CODES, payload), "id").withColumn("g", F.xxhash64("group", "bi", "bj"))
    members = dealt.select("g", "band", "bi", "bj", "own", "id", *CODES, payload).repartition("g").sortWithinPartitions("g", "id")
    return members.mapInArrow(_forests(payload, bands, loose, read, quickly, exactly, together), "a long, b long")
