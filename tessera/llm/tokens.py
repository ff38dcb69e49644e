"""Byte-level BPE: overlapping chunk encoding, raw-byte decoding, and exact length histograms.

Encoding. A text of at most ``CHUNK`` characters is one chunk: it is pre-tokenised and encoded where it is
read. A longer text is cut into overlapping chunks that are spread over the cluster and pre-tokenised in
parallel. Where two neighbours resynchronise (the first position in their overlap at which both
have a pre-token boundary that the chunk's end can't have changed) they are stitched: from there on both
give the same pre-tokens, since the pattern looks only ahead. The stitched pieces are then encoded.
Where an overlap has no common boundary (a run of one character class longer than the overlap) the
stitcher matches on from the last sure boundary until it meets one of the next chunks'.

Decoding concatenates the raw bytes of the ids.

Defined cases: a null text is an empty one; an empty text has no ids; repeated rows give repeated results;
a null doc_id is kept as it is; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize, pieces

#: Characters in a chunk, and how many of them a chunk shares with the next.
CHUNK, OVERLAP = 16384, 512
#: Boundaries nearer to a chunk's end than this may depend on what follows (the longest contraction has 3).
MARGIN = 8
#: Bytes of text that go through the encoder at once.
PIECE_LIMIT = 1 << 16


class ByteBPE:
    """A byte-level BPE given by a rank file (base64 token and rank a line) and a pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.tokens: dict[int, bytes] = {rank: token for token, rank in ranks.items()}
        self.encoding = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def boundaries(self, text: str, start: int = 0) -> np.ndarray:
        """End positions of the pre-tokens of ``text`` from ``start`` on."""
        return np.fromiter((m.end() for m in self.pattern.finditer(text, start)), dtype=np.int64)

    def encode_span(self, text: str) -> np.ndarray:
        """Ids of a text that starts and ends at pre-token boundaries."""
        if len(text) > PIECE_LIMIT:  # one huge pre-token, or several: never hand the pattern engine a huge run
            return np.concatenate([self._piece(m.group()) for m in self.pattern.finditer(text)] or [np.empty(0, "<u4")])
        return np.array(self.encoding.encode_ordinary(text), dtype="<u4")

    def _piece(self, piece: str) -> np.ndarray:
        return np.array(self.encoding._core_bpe.encode_single_piece(piece.encode("utf-8")), dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> ByteBPE:
    """One encoder a worker process and vocabulary; only the path travels with the tasks."""
    return ByteBPE(path, pattern)


def chunked(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, str]]:
    """(first character, text) of the overlapping chunks of ``text``; at least one."""
    step = chunk - overlap
    start = 0
    while True:
        yield start, text[start : start + chunk]
        if start + chunk >= len(text):
            return
        start += step


def sure(ends: np.ndarray, text: str, last: bool) -> np.ndarray:
    """The boundaries (0 included) of a chunk that stand whatever follows it."""
    bounds = np.concatenate([np.zeros(1, np.int64), ends])
    if last:
        return bounds
    # the last match may go on; a boundary close to the end may fall inside a contraction
    limit = min(len(text) - MARGIN, int(bounds[-2]) if len(bounds) > 1 else 0)
    return bounds[bounds <= limit]


def stitch(bpe: ByteBPE, chunks: Iterable[tuple[int, str, np.ndarray]]) -> Iterator[str]:
    """Stretches of text, in order, that start and end at true pre-token boundaries.

    ``chunks``: (first character, text, sure boundaries within the text) in order. ``text``
    from ``at`` (a true boundary) on is held until a boundary is common with the next chunk."""
    held, base, known = "", 0, np.zeros(1, np.int64)  # text held, its first character, true boundaries in it
    first = True
    for start, text, marks in chunks:
        if first:
            held, base, known, first = text, start, marks, False
            continue
        common = np.intersect1d(known + base, marks + start, assume_unique=True)
        if len(common):
            cut = int(common[0])
            if cut > base:
                yield held[: cut - base]
            held, base = text[cut - start :], cut
            known = marks[marks >= cut - start] - (cut - start)
            continue
        # no common boundary: join the texts and match on from the last true boundary held
        at = int(known[-1])
        if at:
            yield held[:at]
        held = held[at:] + text[base + len(held) - start :]
        base += at
        sync = set((marks + start).tolist())
        ends, found = [0], None
        for m in bpe.pattern.finditer(held):
            if m.end() > len(held) - MARGIN or m.end() == len(held):
                break
            ends.append(m.end())
            if m.end() + base in sync:
                found = m.end()
                break
        if found is None:
            # what the last match touched is unsure
            known = np.array(ends[:-1] or [0], np.int64)
        else:
            rest = marks + start - base
            known = np.concatenate([np.array(ends[:-1], np.int64), rest[rest >= found]])
    if not first and held:
        yield held


def chunk_bounds(bpe: ByteBPE, text: str, last: bool) -> np.ndarray:
    return sure(bpe.boundaries(text), text, last)


def encode_text(bpe: ByteBPE, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """Ids of a whole text, by the chunks' way, in one process."""
    parts = list(chunked(text, chunk, overlap))
    if len(parts) == 1:
        return bpe.encode_span(text)
    bounded = ((s, t, chunk_bounds(bpe, t, i == len(parts) - 1)) for i, (s, t) in enumerate(parts))
    return np.concatenate([bpe.encode_span(x) for x in stitch(bpe, bounded)])


CHUNK_SCHEMA = "doc_id long, text_hash long, n_chunks int, chunk int, start long, text string"
BOUND_SCHEMA = CHUNK_SCHEMA + ", marks binary"
IDS_SCHEMA = "doc_id long, ids binary"


def _encoded(docs: DataFrame, path: str, pattern: str, chunk: int, overlap: int, finish, schema: str) -> DataFrame:
    """``finish(doc_ids, [ids, ...], bpe)`` turned into rows of ``schema``, for every row of ``docs``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in pieces(batches):
            yield finish(batch.column("doc_id"), [bpe.encode_span(t) for t in batch.column("text").to_pylist()], bpe)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, text_hash in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "text_hash")), strict=True):
                parts = list(chunked(text, chunk, overlap))
                for i in range(0, len(parts), 256):
                    some = parts[i : i + 256]
                    n = len(some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc_id] * n, pa.int64()), pa.array([text_hash] * n, pa.int64()), pa.array([len(parts)] * n, pa.int32()), pa.array(range(i, i + n), pa.int32()), pa.array([s for s, _ in some], pa.int64()), pa.array([t for _, t in some], pa.string())],
                        names=["doc_id", "text_hash", "n_chunks", "chunk", "start", "text"])

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in pieces(batches):
            rows = zip(batch.column("text").to_pylist(), batch.column("chunk").to_pylist(), batch.column("n_chunks").to_pylist(), strict=True)
            marks = [chunk_bounds(bpe, t, c == n - 1).astype("<i4").tobytes() for t, c, n in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.binary())], names=[*batch.schema.names, "marks"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)

        def rows():
            for batch in pieces(batches):
                yield from zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "chunk", "start", "text", "marks")), strict=True)

        def close(doc_id, parts, copies):
            spans = stitch(bpe, ((s, t, np.frombuffer(m, "<i4").astype(np.int64)) for s, t, m in parts))
            ids = np.concatenate([bpe.encode_span(x) for x in spans])
            return finish(pa.array([doc_id] * copies, pa.int64()), [ids] * copies, bpe)

        key, parts, copies, seen = None, [], 0, -1
        for doc_id, text_hash, chunk_no, start, text, marks in rows():
            if (doc_id, text_hash) != key:
                if key is not None:
                    yield close(key[0], parts, copies)
                key, parts, copies, seen = (doc_id, text_hash), [], 0, -1
            copies += chunk_no == 0  # repeated rows bring each chunk as often
            if chunk_no != seen:
                parts.append((start, text, marks))
                seen = chunk_no
        if key is not None:
            yield close(key[0], parts, copies)

    is_short = F.length("text") <= chunk
    whole = texts.where(is_short).mapInArrow(short, schema)
    chunks = texts.where(~is_short).withColumn("text_hash", F.xxhash64("text")).mapInArrow(cut, CHUNK_SCHEMA)
    bounds = chunks.repartition("doc_id", "text_hash", "chunk").mapInArrow(bound, BOUND_SCHEMA)
    stitched = bounds.repartition("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash", "chunk").mapInArrow(join, schema)
    return whole.unionByName(stitched)


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids): the ids of each text as little-endian unsigned 32-bit integers."""

    def finish(doc_ids, ids, bpe):
        return pa.RecordBatch.from_arrays([doc_ids, pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "ids"])

    return _encoded(docs, path, pattern, chunk, overlap, finish, IDS_SCHEMA)


def decode(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes): the raw bytes of encoded texts."""

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            out = [bpe.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return ids.select("doc_id", "ids").mapInArrow(back, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: each text encoded, and its ids decoded, in one pass; with
    ``with_ids`` also ids, as little-endian unsigned 32-bit integers."""

    def finish(doc_ids, ids, bpe):
        raw = [x.tobytes() for x in ids]
        columns = {
            "doc_id": doc_ids, "n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string())}
        if with_ids:
            columns["ids"] = pa.array(raw, pa.binary())
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return _encoded(docs, path, pattern, chunk, overlap, finish, schema)


def lengths(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_tokens)."""

    def finish(doc_ids, ids, bpe):
        return pa.RecordBatch.from_arrays([doc_ids, pa.array([len(x) for x in ids], pa.int64())], names=["doc_id", "n_tokens"])

    return _encoded(docs, path, pattern, chunk, overlap, finish, "doc_id long, n_tokens long")


#: Lengths whose suffix sums are taken together: one window partition holds at most so many rows.
BAND = 4096


def length_histogram(lengths_: DataFrame) -> DataFrame:
    """The exact histogram of ``n_tokens`` with its suffix sums, a row for each length that occurs.

    n_tokens, n_docs (of that length), docs_at_least and tokens_at_least (documents of that length or more, and
    their tokens), docs_below, tokens_below, and truncated_tokens (all documents' tokens, each cut at n_tokens).
    Suffix sums go band by band: within a band of ``BAND`` lengths by a window, over the bands by another
    (one row a band), so no window partition grows with the number of documents."""
    counts = materialize(lengths_.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")))  # read twice, encoded once
    counts = counts.withColumn("band", F.floor(F.col("n_tokens") / BAND)).withColumn("tokens", F.col("n_docs") * F.col("n_tokens"))
    bands = counts.groupBy("band").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = W.partitionBy(F.lit(1)).orderBy(F.col("band").desc()).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(1))
    bands = bands.select("band", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_above"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_above"), F.sum("d").over(everything).alias("d_all"), F.sum("t").over(everything).alias("t_all"))
    within = W.partitionBy("band").orderBy(F.col("n_tokens").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = counts.withColumn("d_here", F.sum("n_docs").over(within)).withColumn("t_here", F.sum("tokens").over(within)).join(bands, "band")
    docs_at_least, tokens_at_least = F.col("d_here") + F.col("d_above"), F.col("t_here") + F.col("t_above")
    return out.select(
        "n_tokens", "n_docs", docs_at_least.alias("docs_at_least"), tokens_at_least.alias("tokens_at_least"), (F.col("d_all") - docs_at_least).alias("docs_below"), (F.col("t_all") - tokens_at_least).alias("tokens_below"),
        (F.col("t_all") - tokens_at_least + docs_at_least * F.col("n_tokens")).alias("truncated_tokens"),
    )


def answers(histogram: DataFrame, limits: list[int], quantiles: list[float]) -> DataFrame:
    """(what, at, value): for each context limit the documents above it, the tokens that cutting at it keeps;
    for each quantile the smallest length that so many documents don't exceed; and the total.

    Everything comes from the histogram, never from the documents again."""
    h = histogram.select("n_tokens", "n_docs", "docs_below", "tokens_below", "docs_at_least", "tokens_at_least")
    parts = [F.struct(F.lit("total_tokens").alias("what"), F.lit(0.0).alias("at"), F.coalesce(F.max(F.col("tokens_below") + F.col("tokens_at_least")), F.lit(0)).alias("value"))]
    for limit in limits:
        above = F.col("n_tokens") > limit
        parts.append(F.struct(F.lit("docs_above").alias("what"), F.lit(float(limit)).alias("at"), F.coalesce(F.sum(F.when(above, F.col("n_docs"))), F.lit(0)).alias("value")))
        parts.append(F.struct(F.lit("tokens_kept").alias("what"), F.lit(float(limit)).alias("at"), F.coalesce(F.sum(F.col("n_docs") * F.least("n_tokens", F.lit(limit))), F.lit(0)).alias("value")))
    for q in quantiles:
        reached = F.col("docs_below") + F.col("n_docs") >= F.lit(q) * (F.col("docs_below") + F.col("docs_at_least"))
        parts.append(F.struct(F.lit("quantile").alias("what"), F.lit(q).alias("at"), F.min(F.when(reached, F.col("n_tokens"))).alias("value")))
    return h.agg(F.array(*parts).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
