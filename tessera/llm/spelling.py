"""Spelling variants: words one edit apart, found with a rare-first prefix filter on positional bigrams.

1. ``dictionary``: runs of letters of whole texts, with the planted deletions of the query's contract, counted into words.
2. ``bigram_ranks``: bigrams ordered from rare to frequent over the dictionary. The alphabet has 90 letters, so there are at most
   8,100 of them, whatever the corpus: that bounds what the driver collects and broadcasts.
3. ``_keys``: of every word only its ``PREFIX`` rarest bigrams propose partners. One edit destroys at most two bigrams of a word, and
   what survives keeps its order, so two words within one edit share one of their three rarest, at positions at most one apart. The
   join key holds what follows from that: a shared bigram with the edit right of it stands at the same place from the left, and all left
   of it is equal; with the edit left of it the same holds from the right. The other side is equal in its nearer or in its farther
   half, which the key holds too, with the length of the shorter word. So a key's words differ in a stretch of a few letters.
4. ``near_pairs``: an equi-join on the key, verified by edit distance inside the join; only verified pairs leave it.
5. ``forms``, ``roots``: each word's far more frequent near word, and the end of that chain. Counts grow at least tenfold along a chain,
   so pointer doubling ends after log2(log10(largest count)) joins.

Defined cases: a null text has no words; a null doc_id is written as the empty string; repeated rows count again; ties go to the
smallest word in code-point order; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import nsmallest

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

LEAST_LENGTH, LEAST_COUNT, FACTOR, PREFIX, ERASED = 7, 2, 10, 3, 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "A-Za-zÀ-ÿ"


def _word(doc_id: Column, run: Column) -> Column:
    """The run in lower case (A-Z only), without one letter where the checksum of document and run says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % ERASED == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def dictionary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of at least so many letters that occur so often. Shorter runs can't become long enough."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("run"))
    runs = runs.withColumn("run", F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", UPPER, LOWER)))
    words = runs.select(_word(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def bigram_ranks(words: DataFrame) -> dict[str, int]:
    """The place of every bigram in the order of frequency, rarest first; ties in code-point order."""
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))
    counted = words.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["gram"]: k for k, r in enumerate(sorted(counted, key=lambda r: (r["n"], r["gram"])))}


def keys(word: str, rank: dict[str, int]) -> dict[str, bool]:
    """Join keys of a word, and whether it is the longer word of the pairs that a key is for.

    ``m`` is the length of the shorter word, ``cut`` halves the side on which the edit lies."""
    out, size = {}, len(word)
    for _, i in nsmallest(PREFIX, ((rank[word[i : i + 2]], i) for i in range(size - 1))):
        for m in (size, size - 1):
            if m >= i + 2:
                cut = (i + 2 + m) // 2
                out[f"{m} {i} {word[:cut]}"] = out[f"{m} {i} {word[: i + 2]} {word[size - m + cut :]}"] = m < size
            if m >= size - i:
                cut = (m - size + i + 1) // 2
                out[f"{m} {i - size} {word[:cut]} {word[i:]}"] = out[f"{m} {i - size} {word[size - m + cut :]}"] = m < size
    return out


def _keys(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        for batch in batches:
            key, place, longer = [], [], []
            for k, word in enumerate(batch.column("word").to_pylist()):
                found = keys(word, rank)
                key += [xxhash.xxh64_intdigest(x) for x in found]
                longer += found.values()
                place += [k] * len(found)
            at = pa.array(place, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.uint64()).view(pa.int64()), batch.column("word").take(at), batch.column("n").take(at), pa.array(longer, pa.bool_())], names=["key", "word", "n", "longer"])

    return run


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b), each pair of near words once: they differ by one inserted, deleted or replaced code point."""
    shared = words.sparkSession.sparkContext.broadcast(bigram_ranks(words))
    keyed = materialize(words.select("word", "n").mapInArrow(_keys(shared), "key long, word string, n long, longer boolean"))
    a = keyed.where(~F.col("longer")).select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = keyed.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"), "longer")
    near = (F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    return a.join(b, (a["key"] == b["key"]) & near).select("a", "n_a", "b", "n_b").distinct()


def forms(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, n, n_near, form, form_n): a word's form is its near word of largest n, if that is ``factor`` times its own."""
    pairs = materialize(near_pairs(words))
    both = pairs.select(F.col("a").alias("word"), "n_a", F.col("b").alias("other"), "n_b").unionByName(pairs.select(F.col("b").alias("word"), F.col("n_b").alias("n_a"), F.col("a").alias("other"), F.col("n_a").alias("n_b")))
    best = F.min(F.when(F.col("n_b") >= factor * F.col("n_a"), F.struct((-F.col("n_b")).alias("n"), "other")))
    per = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    rows = words.join(per, "word", "left")
    return rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.other").alias("form"), (-F.col("best.n")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form."""
    links = materialize(formed.where("form is not null").select("word", F.col("form").alias("root")))
    steps = len(str(formed.agg(F.max("n")).first()[0] or 0))  # a chain has fewer links than the largest count has digits
    for _ in range(max(0, steps - 1).bit_length()):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = materialize(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return links


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the dictionary."""
    words = materialize(dictionary(docs))
    formed = materialize(forms(words))
    rows = formed.join(roots(formed), "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
