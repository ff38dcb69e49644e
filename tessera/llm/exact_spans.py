"""Removal of byte strings that repeat across documents, by suffix arrays over content-dealt shards.

Every window of ``LENGTH`` bytes has an anchor: the least hash of the ``GRAM``-byte strings in it. Equal windows
have equal anchors, so all occurrences of a string meet in one shard wherever they stand. Consecutive windows
of one anchor form a segment (50 to 113 bytes, one for 18 bytes of text on average).

1. ``_anchors`` (map side): segments as (anchor, content hash, place). Where one batch holds a segment in several
   documents, all but the smallest document's are settled at once; that is the partial aggregation that
   keeps a passage shared by a third of all documents from flooding one task.
2. ``_settle``: rows sorted by (anchor, content, document) stream by. Of equal segments all but the smallest document's
   are covered wholly. An anchor with different segments leaves one question: which windows of a smallest
   document's segment occur in a different segment of a still smaller document.
3. ``_shards``: those segments' bytes, shard by shard, get a suffix array by induced sorting; permuted
   common prefixes cut it into groups of equal windows; windows of all but the least document go.
4. The spans are merged and cut from each text.

Defined cases: a null text is an empty one; a null doc_id counts as larger than all others (rows with null ids are one
document to each other); rows that repeat a doc_id never cover each other, and repeated rows get repeated
results; texts under LENGTH bytes lose nothing; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, materialize
from .suffix import repeats

LENGTH, GRAM = 50, 16
#: Windows in a segment at most; bytes of a text hashed at once; bytes of a batch settled together; of a shard.
RUN, SLAB, BATCH, SHARD = 64, 1 << 20, 1 << 23, 1 << 20
#: Rows of one anchor that are held before the settled ones are passed on.
HELD = 1 << 18
#: Fixed odd multipliers.
M1, M2, M3, B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0x9FB21C651E98DF25))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= M3
    x ^= x >> np.uint64(29)
    return x


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_B_INVERSE = np.uint64(pow(int(B), -1, 1 << 64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((B, _B_INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def segments(raw: bytes, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, content hash, first byte, windows) of the segments of ``raw``."""
    parts = []
    n_windows = len(raw) - LENGTH + 1
    for start in range(0, max(n_windows, 0), SLAB):
        upto = min(start + SLAB, n_windows)  # windows of this slab
        data = raw[start : upto + LENGTH - 1]
        n = len(data)
        words = np.ndarray((n - 7,), "<u8", buffer=data, strides=(1,)).copy()
        h = _mix((words[: n - GRAM + 1] * (M1 + np.uint64(2 * seed))) ^ ((words[GRAM - 8 :] * M2) >> np.uint64(7)) ^ (words[GRAM - 8 :] << np.uint64(23)))
        low, width, span = h, 1, LENGTH - GRAM + 1
        while width * 2 <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: upto - start], low[span - width : span - width + upto - start])
        cut = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        size = np.diff(np.append(cut, len(low)))
        if size.max() > RUN:  # periodic text: cut the long runs
            cut = np.concatenate([np.arange(a, a + s, RUN) for a, s in zip(cut.tolist(), size.tolist(), strict=True)])
            size = np.diff(np.append(cut, len(low)))
        power, inverse = _power_tables(len(h))
        total = np.append(np.uint64(0), np.cumsum(h * power, dtype=np.uint64))
        last = cut + size + LENGTH - GRAM  # grams of the segment end before this one
        content = _mix(((total[last] - total[cut]) * inverse[cut]) ^ (size.astype(np.uint64) * M2))
        parts.append((low[cut], content, cut + start, size))
    if not parts:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the spans [starts[i], ends[i]); touching spans are one run."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, s[1:] > e[:-1])
    first = np.flatnonzero(new)
    return s[first], e[np.append(first[1:] - 1, len(s) - 1)]


ANCHORS = "m long, seg long, doc long, th long, off int, n int"
#: n windows of a segment; or, below zero, a settled span of -n bytes, whose m is arbitrary.
SPANS = "doc long, th long, off int, len int, m long"


def _batch(columns: dict[str, np.ndarray], types: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, types[k]) for k, v in columns.items()], names=list(columns))


_TYPES = {"m": pa.int64(), "seg": pa.int64(), "doc": pa.int64(), "th": pa.int64(), "off": pa.int32(), "n": pa.int32(), "len": pa.int32()}


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def combine(docs: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        got = [segments(raw) for _, _, raw in docs]
        sizes = [len(g[0]) for g in got]
        m, seg = (np.concatenate([g[k] for g in got]).view(np.int64) for k in (0, 1))
        off, n = (np.concatenate([g[k] for g in got]) for k in (2, 3))
        row = np.repeat(np.arange(len(docs)), sizes)
        doc, th = np.array([d for d, _, _ in docs], np.int64)[row], np.array([t for _, t, _ in docs], np.int64)[row]
        order = np.lexsort((doc, seg, m))
        m, seg, doc, th, off, n, row = (c[order] for c in (m, seg, doc, th, off, n, row))
        if not len(m):
            return
        new = np.append(True, (m[1:] != m[:-1]) | (seg[1:] != seg[:-1]))
        least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        known = doc > least
        yield _batch({"m": m[~known], "seg": seg[~known], "doc": doc[~known], "th": th[~known], "off": off[~known], "n": n[~known]}, _TYPES)
        if known.any():
            # runs of settled segments of a document become spans; a place in the text deals them out
            r, a, b = row[known], off[known], off[known] + n[known] + LENGTH - 1
            wide = np.int64(1) << 40
            s, e = merged(r * wide + a, r * wide + b)
            r = s // wide
            s, e = s - r * wide, e - r * wide
            d, t = np.array([x for x, _, _ in docs], np.int64)[r], np.array([x for _, x, _ in docs], np.int64)[r]
            deal = _mix((d.view(np.uint64) * M1) ^ (s.astype(np.uint64) * M2)).view(np.int64)
            yield _batch({"m": deal, "seg": np.zeros(len(d), np.int64), "doc": d, "th": t, "off": s, "n": s - e}, _TYPES)

    held: list[tuple[int, int, bytes]] = []
    size = 0
    for batch in batches:
        for doc, th, text in zip(*(batch.column(c) for c in ("doc", "th", "text")), strict=True):
            raw = text.as_buffer().to_pybytes()
            if len(raw) < LENGTH:
                continue
            held.append((doc.as_py(), th.as_py(), raw))
            size += len(raw)
            if size >= BATCH:
                yield from combine(held)
                held, size = [], 0
    if held:
        yield from combine(held)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans that are settled (m null) and segments with an open question (len their windows, m set)."""
    names = ("m", "seg", "doc", "th", "off", "n")

    def out(doc, th, off, size, m) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(th, pa.int64()), pa.array(off, pa.int32()), pa.array(size, pa.int32()), m], names=["doc", "th", "off", "len", "m"])

    def close(c: list[np.ndarray], complete: bool) -> tuple[list[pa.RecordBatch], list[np.ndarray]]:
        """Whole anchors of c, sorted; or, if not complete, the part of one anchor: what must be held on."""
        m, seg, doc, th, off, n = c
        results = []
        span = n < 0
        if span.any():
            results.append(out(doc[span], th[span], off[span], -n[span], pa.nulls(int(span.sum()), pa.int64())))
            m, seg, doc, th, off, n = (x[~span] for x in (m, seg, doc, th, off, n))
        if not len(m):
            return results, [m, seg, doc, th, off, n]
        new_seg = np.append(True, (m[1:] != m[:-1]) | (seg[1:] != seg[:-1]))
        seg_no = np.cumsum(new_seg) - 1
        least = doc[np.flatnonzero(new_seg)][seg_no]
        gone = doc > least
        if gone.any():
            results.append(out(doc[gone], th[gone], off[gone], n[gone] + LENGTH - 1, pa.nulls(int(gone.sum()), pa.int64())))
        keep = ~gone
        m, seg, doc, th, off, n = (x[keep] for x in (m, seg, doc, th, off, n))
        if not complete:
            return results, [m, seg, doc, th, off, n]
        first = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(m))))
        open_ = (np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first))[group]
        if open_.any():
            results.append(out(doc[open_], th[open_], off[open_], n[open_], pa.array(m[open_], pa.int64())))
        return results, []

    carry: list[np.ndarray] | None = None
    for batch in batches:
        c = [batch.column(k).to_numpy() for k in names]
        if carry is not None:
            c = [np.concatenate([a, b]) for a, b in zip(carry, c, strict=True)]
        last = int(np.searchsorted(c[0], c[0][-1]))
        head, carry = [x[:last] for x in c], [x[last:] for x in c]
        if last:
            yield from close(head, True)[0]
        if len(carry[0]) > HELD:
            results, carry = close(carry, False)
            yield from results
    if carry is not None and len(carry[0]):
        yield from close(carry, True)[0]


def _covered(doc: np.ndarray, th: np.ndarray, off: np.ndarray, raw: list[bytes], depth: int = 0) -> list[tuple]:
    """(doc, th, off, len) arrays: spans of the segments whose windows occur in a smaller document's segment."""
    sizes = np.array([len(x) for x in raw], np.int64)
    if sizes.sum() > 8 * SHARD and depth < 6 and len(raw) > 1:
        # an anchor with too many different segments: its windows go on by their anchors under other hashes
        parts = [segments(x, depth + 1) for x in raw]
        row = np.repeat(np.arange(len(raw)), [len(p[0]) for p in parts])
        m, a, n = (np.concatenate([p[k] for p in parts]) for k in (0, 2, 3))
        order = np.argsort(m, kind="stable")
        bounds = np.flatnonzero(np.append(True, m[order][1:] != m[order][:-1]))
        out, some, held = [], [], 0
        for g in [*np.split(order, bounds[1:]), None]:
            if some and (g is None or held > SHARD):
                at = np.concatenate(some)
                out += _covered(doc[row[at]], th[row[at]], off[row[at]] + a[at], [raw[r][x : x + k + LENGTH - 1] for r, x, k in zip(row[at].tolist(), a[at].tolist(), n[at].tolist(), strict=True)], depth + 1)
                some, held = [], 0
            if g is not None:
                some.append(g)
                held += int(n[g].sum()) + len(g) * LENGTH
        return out
    data = np.frombuffer(b"".join(x + b"\0" for x in raw), np.uint8)
    starts = np.cumsum(sizes + 1) - sizes - 1
    at, group = repeats(data, starts, sizes, LENGTH)
    if not len(at):
        return []
    owner = np.searchsorted(starts, at, side="right") - 1
    d = doc[owner]
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    gone = np.sort(at[d > np.minimum.reduceat(d, first)[group]])
    if not len(gone):
        return []
    new = np.flatnonzero(np.append(True, (gone[1:] != gone[:-1] + 1)))
    a, b = gone[new], gone[np.append(new[1:] - 1, len(gone) - 1)]
    row = np.searchsorted(starts, a, side="right") - 1
    return [(doc[row], th[row], off[row] + a - starts[row], b - a + LENGTH)]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settled spans from rows (m, doc, th, off, raw) sorted by m: whole anchors, about SHARD bytes at a time."""
    held: list[list] = [[], [], [], []]
    size, last = 0, None

    def flush() -> Iterator[pa.RecordBatch]:
        doc, th, off = np.array(held[0], np.int64), np.array(held[1], np.int64), np.array(held[2], np.int64)
        for d, t, a, n in _covered(doc, th, off, held[3]):
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(t, pa.int64()), pa.array(a.astype(np.int32)), pa.array(n.astype(np.int32)), pa.nulls(len(d), pa.int64())], names=["doc", "th", "off", "len", "m"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("m", "doc", "th", "off", "raw")), strict=True):
            if size >= SHARD and row[0] != last:
                yield from flush()
                held, size = [[], [], [], []], 0
            last = row[0]
            for column, value in zip(held, row[1:], strict=True):
                column.append(value)
            size += len(row[4])
    if held[0]:
        yield from flush()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for doc, th, text, wanted in zip(*(batch.column(c) for c in ("doc", "th", "text", "wanted")), strict=True):
            raw = text.as_buffer().to_pybytes()
            doc, th = doc.as_py(), th.as_py()
            for w in wanted.as_py():
                out[0].append(w["m"])
                out[1].append(doc)
                out[2].append(th)
                out[3].append(w["off"])
                out[4].append(raw[w["off"] : w["off"] + w["len"] + LENGTH - 1])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["m", "doc", "th", "off", "raw"])


def identified(docs: DataFrame) -> DataFrame:
    """(doc, th, text): ids without nulls, and a 64-bit text hash that tells rows of one id, or without one, apart.

    Among n different texts of one id two are mixed up with probability n^2 / 2^65: 3 in 10,000 at 100 million."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))


def removal_spans(docs: DataFrame) -> DataFrame:
    """(doc, th, off, len): byte spans to remove; they may overlap."""
    texts = identified(docs)
    rows = texts.where(F.octet_length("text") >= LENGTH).mapInArrow(_anchors, ANCHORS)
    settled = materialize(rows.repartition("m").sortWithinPartitions("m", "seg", "doc").mapInArrow(_settle, SPANS))
    asked = settled.where("m is not null").groupBy("doc", "th").agg(F.collect_list(F.struct("m", "off", "len")).alias("wanted"))
    # rows that repeat a document repeat its segments, which changes nothing
    slices = texts.join(asked, ["doc", "th"]).mapInArrow(_slices, "m long, doc long, th long, off int, raw binary")
    found = slices.repartition("m").sortWithinPartitions("m").mapInArrow(_shards, SPANS)
    return settled.where("m is null").unionByName(found).select("doc", "th", "off", "len")


def _apply(finish, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, spans in zip(*(batch.column(c) for c in ("doc", "text", "spans")), strict=True):
                raw = text.as_buffer().to_pybytes()
                if spans.is_valid:
                    inner = spans.values
                    a = inner.field("off").to_numpy().astype(np.int64)
                    s, e = merged(a, a + inner.field("len").to_numpy())
                else:
                    s = e = np.zeros(0, np.int64)
                doc = doc.as_py()
                rows.append(finish(None if doc == NULL_ID else doc, raw, s, e))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, finish.types, strict=True)], names=names)

    return run


def kept(raw: bytes, s: np.ndarray, e: np.ndarray) -> bytes:
    at, out = 0, []
    for a, b in zip(s.tolist(), e.tolist(), strict=True):
        out.append(raw[at:a])
        at = b
    out.append(raw[at:])
    return b"".join(out)


def _with_spans(docs: DataFrame) -> DataFrame:
    spans = removal_spans(docs).groupBy("doc", "th").agg(F.collect_list(F.struct("off", "len")).alias("spans"))
    return identified(docs).join(spans, ["doc", "th"], "left")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""

    def finish(doc, raw, s, e):
        return doc, len(raw), int((e - s).sum()), len(s), hashlib.sha256(kept(raw, s, e)).hexdigest()

    finish.types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return _with_spans(docs).mapInArrow(_apply(finish, names), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, raw (the bytes that stay, which need not be valid UTF-8) and spans removed, of every row."""

    def finish(doc, raw, s, e):
        return doc, kept(raw, s, e), [{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist(), strict=True)]

    finish.types = (pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    return _with_spans(docs).mapInArrow(_apply(finish, ["doc_id", "raw", "spans"]), "doc_id long, raw binary, spans array<struct<start: long, end: long>>")
