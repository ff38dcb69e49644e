"""Near-duplicate documents: SimHash fingerprints, MinHash bands for what these can't reach, exact Jaccard similarity of both's pairs.

Words are those of the lower-cased text (ASCII); the shingles of ``width`` words form a document's set (a shorter
text is one shingle, a text without words has the set of nothing but 0). Documents of equal words are one class. Classes link if the
Jaccard similarity of their sets is ``least`` or more; of each connected group the smallest doc_id stays.

Pairs are proposed first by op3's operator (``simhash``: fingerprints of ``PRINT_WIDTH``-word shingles, components of those within ``RADIUS`` bits): pairs
within a component are verified until their links connect it. A similarity of 0.8 differs in more bits than any pivot table
discards at, so MinHash bands over the sets propose the rest. Sixteen bands of
four MinHashes miss a pair of similarity 0.8 in 2 of 10,000 cases, if hashes are random, and closer pairs more rarely still.

Defined cases: rows with a null doc_id stay only where their group has no other id; rows that repeat the kept id stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, pieces
from .minhash import ANY, CODES, N, candidates, code_columns, codes, links, minima
from .simhash import _NORMAL, fingerprints, near_components, xxh64_slices

BANDS = [tuple(range(i, i + 4)) for i in range(0, N, 4)]
#: Codes of 64 that candidates may differ in, by two bits each; at 0.8 about 10 do.
LOOSE = 24
#: Words of a shingle of the fingerprints, and bits in which linked ones differ, as in op3.
PRINT_WIDTH, RADIUS = 3, 2


def words_of(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8").translate(_NORMAL).split())


def shingles(words: bytes, width: int) -> np.ndarray:
    """The sorted different 64-bit hashes of ``width`` consecutive words."""
    if not words:
        return np.zeros(1, np.uint64)
    space = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
    h = xxh64_slices(words, np.append(0, space + 1), np.append(space, len(words)))
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(h))):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(32)))


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def _coded(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            h1, h2, least = [], [], []
            texts = batch.column("text").to_pylist()
            prints = fingerprints(texts, PRINT_WIDTH).view(np.int64)
            for text in texts:
                words = words_of(text)
                h1.append(xxhash.xxh3_64_intdigest(words))
                h2.append(xxhash.xxh64_intdigest(words, 1))
                least.append(minima((shingles(words, width) >> np.uint64(32)).astype(np.uint32), np.zeros(1, np.int64))[0])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(prints, pa.int64()), *(pa.array(np.array(h, np.uint64).view(np.int64)) for h in (h1, h2)), *code_columns(codes(np.stack(least)))], names=["doc_id", "th", "fp", "h1", "h2", *CODES])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            words = [words_of(t) for t in batch.column("text").to_pylist()]
            h1 = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64).view(np.int64)
            h2 = np.array([xxhash.xxh64_intdigest(w, 1) for w in words], np.uint64).view(np.int64)
            sets = [shingles(w, width).tobytes() for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sets, pa.binary())], names=["h1", "h2", "set"])

    return run


def _read(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def print_groups(classes: DataFrame) -> DataFrame:
    """(group, band, n, id): the classes (id, fp) of each component of fingerprints, in the layout of ``candidates``."""
    labels = near_components(classes.select("fp"), RADIUS)
    rooted = classes.select("id", "fp").join(labels, "fp", "left").select("id", F.coalesce("root", "fp").alias("root"))
    several = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rooted.join(several, "root").select(F.xxhash64(F.lit("fingerprint"), "root").alias("group"), F.lit(ANY).alias("band"), "n", "id")


def deduplicated(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one with the smallest doc_id."""
    # rows without an id are told apart by their text
    th = F.when(docs["doc_id"].cast("long").isNull(), F.xxhash64(F.coalesce(docs["text"], F.lit("")))).otherwise(F.lit(0).cast("long"))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"), th.alias("th"))
    kind = ", ".join(f"{c} long" for c in CODES)
    rows = materialize(texts.mapInArrow(_coded(width), f"doc_id long, th long, fp long, h1 long, h2 long, {kind}"))
    # numbered once and written, so that a class keeps its number
    classes = rows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "th")).alias("place"), F.min("doc_id").alias("first"), F.min("fp").alias("fp"), *(F.min(c).alias(c) for c in CODES))
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()))
    grouped = materialize(print_groups(classes).unionByName(candidates(classes, BANDS, LOOSE)))
    wanted = materialize(classes.join(grouped.select("id").distinct(), "id", "left_semi"))
    # one text of each class; rows of one doc_id and th may still differ, so that the hashes decide
    places = wanted.select(F.col("place.doc_id").alias("__id"), F.col("place.th").alias("__th")).distinct()
    some = texts.join(places, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left_semi").select("text")
    sets = some.mapInArrow(_sets(width), "h1 long, h2 long, set binary").join(wanted.select("h1", "h2", "id", *CODES), ["h1", "h2"]).dropDuplicates(["id"])
    edges = links(grouped, sets, "set", BANDS, LOOSE, _read, lambda a, b: alike(a, b, least))
    labels = connected_components(edges).select(F.col("node").alias("id"), F.col("component").alias("root"))
    rooted = materialize(classes.select("id", "h1", "h2", "first").join(labels, "id", "left").withColumn("root", F.coalesce("root", "id")))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("__low"))
    low = rooted.join(lowest, "root").select("h1", "h2", "__low")
    kept = rows.select("doc_id", "th", "h1", "h2").join(low, ["h1", "h2"]).where(F.col("doc_id").eqNullSafe(F.col("__low"))).select(F.col("doc_id").alias("__kept"), F.col("th").alias("__th")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["__kept"]) & (th == kept["__th"]), "left_semi")
