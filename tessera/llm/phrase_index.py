"""Benchmark decontamination with a distributed positional inverted index of the training documents.

1. ``build``: every task packs its documents into segments of about ``SEGMENT`` words and writes one row for each: the segment's terms,
   how often each occurs, and the ascending positions of each, as differences. An index shard never depends on a term's share
   of the corpus, so frequent terms and copied documents need no split of their own, and nothing is shuffled.
2. ``pieces``: the benchmark's items, cut so that a piece holds ``PIECE`` windows at most; they are dealt to blocks of about
   ``BLOCK_WORDS`` words. A block is a bounded query set that is broadcast and asked of every segment.
3. ``frequencies``: the corpus frequency of a block's terms, summed over the segments' term columns.
4. ``matches``: a window starts from its rarest term's positions and meets the other terms' positions, less their offsets, from rare to
   frequent, until none is left. Exact phrases need equal offset-adjusted positions; proximity allows ``slack`` words in between.
5. ``spans`` and ``digest`` merge a document's hit words over its items.

A window is ``WINDOW`` consecutive words of an item; an item of fewer words, but not none, is one window. Documents
of a segment stand ``GAP`` positions apart, so no match crosses them.

Defined cases: a null text has no words; a null item_id is written as the empty string, and items that share an item_id are one
item; documents without words stay, without hits; repeated rows and ids get a result each; an empty benchmark or table gives no hits
or no rows; further columns are ignored. A document longer than a segment is a segment of its own in one task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

WINDOW, SEGMENT, PIECE, BLOCK_WORDS, GAP = 10, 1 << 20, 4096, 1 << 18, 64
#: Lower-cases A-Z; bytes of other characters below 128 than letters and digits become spaces.
_TABLE = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())
INDEX = "segment long, doc_ids array<long>, n_words array<int>, terms binary, counts binary, steps binary"
PIECES = "item string, first long, words binary, n long"
MATCHES = "segment long, ordinal int, doc_id long, item string, kind string, n_windows long, spans array<struct<start: int, end: int>>"


def split(text: pa.Scalar) -> list[bytes]:
    """The words of a text."""
    return text.as_buffer().to_pybytes().translate(_TABLE).split() if text.is_valid else []


def _pack(segment: int, doc_ids: list, sizes: list[int], ids: list[np.ndarray], terms: list[bytes]) -> pa.RecordBatch:
    n = np.array(sizes, np.int64)
    first = np.cumsum(n + GAP) - n - GAP
    key = np.concatenate(ids).astype(np.uint64) << np.uint64(32)
    key |= (np.arange(len(key)) + np.repeat(first - (np.cumsum(n) - n), n)).astype(np.uint64)
    key.sort()
    counts = np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=len(terms))
    steps = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    steps[1:] -= steps[:-1].copy()
    begins = np.cumsum(counts) - counts
    steps[begins] = (key[begins] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    columns = [pa.array([segment], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32()))]
    blobs = [b" ".join(terms), counts.astype("<u4").tobytes(), _planes(steps.astype("<u4"))]
    return pa.RecordBatch.from_arrays(columns + [pa.array([b], pa.binary()) for b in blobs], names=["segment", "doc_ids", "n_words", "terms", "counts", "steps"])


def _planes(numbers: np.ndarray) -> bytes:
    """All lowest bytes, then all second ones and so on: small numbers leave long runs of zeros to the file's compression."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = count(TaskContext.get().partitionId() << 32)
    doc_ids, sizes, ids, size, known = [], [], [], 0, defaultdict(count().__next__)
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            words = split(text)
            doc_ids.append(doc_id)
            sizes.append(len(words))
            ids.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
            size += len(words) + GAP
            if size >= SEGMENT:
                yield _pack(next(number), doc_ids, sizes, ids, list(known))
                doc_ids, sizes, ids, size, known = [], [], [], 0, defaultdict(count().__next__)
    if doc_ids:
        yield _pack(next(number), doc_ids, sizes, ids, list(known))


def build(docs: DataFrame) -> DataFrame:
    """The index of ``docs`` (doc_id, text), as a written table: one row a segment."""
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_segments, INDEX))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for item, text in zip(batch.column("item").to_pylist(), batch.column("text"), strict=True):
            words = split(text)
            for a in range(0, max(len(words) - WINDOW + 1, min(len(words), 1)), PIECE):
                part = words[a : a + PIECE + WINDOW - 1]
                for column, value in zip(out, (item, a, b" ".join(part), len(part)), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["item", "first", "words", "n"])


def pieces(items: DataFrame) -> DataFrame:
    """Items as (item, first, words, n) of at most PIECE windows: ``first`` is the first word's number in the item."""
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return materialize(named.mapInArrow(_pieces, PIECES).distinct())


def _terms(row: pa.Scalar) -> list[bytes]:
    raw = row.as_buffer().to_pybytes()
    return raw.split(b" ") if raw else []


def frequencies(index: DataFrame, vocabulary: dict[bytes, int]) -> np.ndarray:
    """How often each term of a block's vocabulary occurs in the corpus; one number a term comes to the driver."""
    shared = index.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column("terms"), batch.column("counts"), strict=True):
                asked = [(q, k) for k, t in enumerate(_terms(terms)) if (q := shared.value.get(t)) is not None]
                if asked:
                    q, k = np.array(asked).T
                    total[q] += np.frombuffer(counts.as_buffer(), "<u4")[k]
        q = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(total[q])], names=["term", "n"])

    total = np.zeros(len(vocabulary), np.int64)
    summed = index.select("terms", "counts").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    for q, n in summed.collect():
        total[q] = n
    shared.unpersist()
    return total


class Plan:
    """A block's windows: their terms from rare to frequent with offsets, ordered by the rarest term."""

    def __init__(self, rows: list, index: DataFrame):
        known: defaultdict[bytes, int] = defaultdict(count().__next__)
        texts, owners, firsts, items = [], [], [], {}
        for item, first, words, _ in rows:
            ids = [known[w] for w in bytes(words).split(b" ")]
            owner = items.setdefault(item, len(items))
            for a in range(max(1, len(ids) - WINDOW + 1)):
                texts.append(ids[a : a + WINDOW])
                owners.append(owner)
                firsts.append(first + a)
        self.vocabulary, self.items = dict(known), list(items)
        n = frequencies(index, self.vocabulary)
        length = np.array([len(t) for t in texts])
        term = np.full((len(texts), WINDOW), -1, np.int32)
        for k, t in enumerate(texts):
            term[k, : len(t)] = t
        rarity = np.where(term < 0, np.iinfo(np.int64).max, n[term])
        offset = np.argsort(rarity, axis=1, kind="stable").astype(np.int32)
        term = np.take_along_axis(term, offset, axis=1)
        alive = np.flatnonzero(n[term[:, 0]] > 0)  # a window with a term that no document holds can't match
        order = alive[np.argsort(term[alive, 0], kind="stable")]
        self.term, self.offset, self.length = term[order], offset[order], length[order]
        self.owner, self.first = np.array(owners)[order], np.array(firsts)[order]
        starts = np.searchsorted(self.term[:, 0], np.arange(len(n) + 1))
        self.windows_of = {int(q): (int(starts[q]), int(starts[q + 1])) for q in np.unique(self.term[:, 0])}


def _within(lists, at: np.ndarray, slack: int) -> np.ndarray:
    """Which of ``at`` have a position of the ascending ``lists`` within ``slack`` of them."""
    k = np.searchsorted(lists, at - slack)
    return (k < len(lists)) & (lists[np.minimum(k, len(lists) - 1)] <= at + slack)


def _found(plan: Plan, postings: dict[int, np.ndarray], slack: int) -> Iterator[tuple[int, np.ndarray]]:
    """(window, positions at which it starts) for every window that occurs."""
    for q in postings.keys() & plan.windows_of.keys():
        for w in range(*plan.windows_of[q]):
            at = postings[q] - plan.offset[w, 0]
            for k in range(1, plan.length[w]):
                other = postings.get(int(plan.term[w, k]))
                at = at[_within(other, at + plan.offset[w, k], slack)] if other is not None else at[:0]
                if not len(at):
                    break
            if len(at):
                yield w, at


def merged(spans: np.ndarray) -> np.ndarray:
    """Rows (start, end) without overlaps, in order."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    upto = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > upto[:-1])
    return np.stack([spans[new, 0], upto[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]], axis=1)


def _search(plan, slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Plan = plan.value
        for batch in batches:
            for row in range(len(batch)):
                segment, doc_ids, n_words, terms, counts, steps = (batch.column(c)[row] for c in ("segment", "doc_ids", "n_words", "terms", "counts", "steps"))
                asked = [(q, k) for k, t in enumerate(_terms(terms)) if (q := p.vocabulary.get(t)) is not None]
                if not asked:
                    continue
                n, step = np.frombuffer(counts.as_buffer(), "<u4").astype(np.int64), _from_planes(steps.as_buffer().to_pybytes())
                end = np.cumsum(n)
                postings = {q: np.cumsum(step[end[k] - n[k] : end[k]], dtype=np.int64) for q, k in asked}
                size = n_words.values.to_numpy().astype(np.int64)
                begin = np.cumsum(size + GAP) - size - GAP
                phrase = {w: at for w, at in _found(p, postings, 0)}
                near = {}
                for w, at in _found(p, postings, slack) if slack else ():
                    at = np.setdiff1d(at, phrase.get(w, at[:0]))
                    if len(at):
                        near[w] = at
                yield from _rows(p, segment.as_py(), doc_ids.values, begin, size, {"phrase": phrase, "proximity": near})

    return run


def _rows(p: Plan, segment: int, doc_ids: pa.Array, begin: np.ndarray, size: np.ndarray, found: dict[str, dict[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """One row for each document, item and kind: how many different windows match, and the words they cover."""
    out: list[tuple] = []
    for kind, windows in found.items():
        if not windows:
            continue
        w = np.repeat(list(windows), [len(at) for at in windows.values()])
        at = np.concatenate(list(windows.values()))
        anchor = at + p.offset[w, 0]  # the rarest word stands in the document; the rest of a near match may reach beyond it
        doc = np.searchsorted(begin, anchor, side="right") - 1
        a = np.clip(at - begin[doc], 0, size[doc])
        e = np.clip(at + p.length[w] - begin[doc], 0, size[doc])
        item = p.owner[w]
        order = np.lexsort((item, doc))
        cuts = np.flatnonzero(np.append(True, (np.diff(doc[order]) != 0) | (np.diff(item[order]) != 0)))
        for some in np.split(order, cuts[1:]):
            spans = merged(np.stack([a[some], e[some]], axis=1)).tolist()
            d = int(doc[some[0]])
            out.append((segment, d, doc_ids[d].as_py(), p.items[item[some[0]]], kind, len(np.unique(p.first[w[some]])), [{"start": x, "end": y} for x, y in spans]))
    if out:
        types = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        names = ["segment", "ordinal", "doc_id", "item", "kind", "n_windows", "spans"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def matches(index: DataFrame, items: DataFrame, slack: int = 0) -> DataFrame:
    """A row for each document and item that match: segment, ordinal (the document's place in the segment), doc_id, item, kind,
    n_windows (different windows of the item) and spans (words of the document, from 0, that they cover).

    kind is ``phrase`` for windows that occur word by word. With ``slack`` it is ``proximity`` for the places at which each of a window's
    words stands at most ``slack`` words from where the window's rarest word puts it. An item that is cut or dealt to several
    blocks may have several rows."""
    if slack + WINDOW >= GAP:
        raise ValueError(f"slack must stay below {GAP - WINDOW}")
    spark = index.sparkSession
    asked = pieces(items)
    n = asked.agg(F.sum("n")).first()[0] or 0
    blocks = -(-n // BLOCK_WORDS)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item", "first", "words"), F.lit(max(1, blocks))))
    found = spark.createDataFrame([], MATCHES)
    for block in range(blocks):
        rows = asked.where(F.col("block") == block).drop("block").collect()
        if rows:
            plan = spark.sparkContext.broadcast(Plan(rows, index))
            found = found.unionByName(materialize(index.mapInArrow(_search(plan, slack), MATCHES)))
            plan.unpersist()
    return found


def documents(index: DataFrame) -> DataFrame:
    """(segment, ordinal, doc_id, n_words) of every document of the index."""
    rows = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("ordinal", "d"))
    return rows.select("segment", "ordinal", F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").cast("long").alias("n_words"))


def _merged_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for s in batch.column("s"):
            both = np.stack([s.values.field(c).to_numpy() for c in ("start", "end")], axis=1)
            out.append([{"start": x, "end": y} for x, y in merged(both).tolist()])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column("segment"), batch.column("ordinal"), pa.array(out, kind), batch.column("items")], names=["segment", "ordinal", "spans", "items"])


def spans(index: DataFrame, found: DataFrame) -> DataFrame:
    """Every document with n_words, its hit words as disjoint spans, and its items."""
    per = found.groupBy("segment", "ordinal").agg(F.flatten(F.collect_list("spans")).alias("s"), F.array_sort(F.collect_set("item")).alias("items"))
    kind = "array<struct<start: int, end: int>>"
    per = per.select("segment", "ordinal", "s", "items").mapInArrow(_merged_spans, f"segment long, ordinal int, spans {kind}, items array<string>")
    rows = documents(index).join(per, ["segment", "ordinal"], "left")
    return rows.select("doc_id", "n_words", F.coalesce("spans", F.array().cast(kind)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of ``docs``."""
    index = build(docs)
    rows = spans(index, matches(index, items))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )
