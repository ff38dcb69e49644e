"""Interaction audit of document filters: what each filter removes in every order, and its Shapley share.

1. ``flags``: one narrow row a document with a flag for every failed filter. Texts stay in the scan's tasks; of a text only its
   SHA-256 travels, to learn which doc_id had it first.
2. ``profiles``: documents counted by part and flags. That is the partial aggregation: 32 rows a part at most, whatever a part's share.
3. ``survivors``: SQL ``CUBE`` over the five flags and the part. The grouping-set row in which the selected flags are all false counts
   the documents that pass this subset of filters.
4. ``audit``: each step of each order joins the subset before it with the subset after it.

Defined cases: a null text is an empty one; a null part is the empty string; of rows that share text and smallest doc_id none is
a copy; a null doc_id is larger than all others; labels that repeat a doc_id count once, with the larger value; null labels and
documents without labels are neither good nor toxic; an empty table has no parts and so gives no rows; further columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import NULL_ID, materialize

FILTERS = "ABCDE"
COUNTS = ("n", "good", "toxic")
#: All filters as a subset: bit k is the k-th letter.
ALL = (1 << len(FILTERS)) - 1
SPACE = r"[\x20\x09-\x0D]+"


def text_flags(text: Column) -> dict[str, Column]:
    """The filters that look at one text, by letter; true is failure."""
    words = F.array_remove(F.split(text, SPACE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": n < 100, "B": 100 * distinct.cast("long") < 80 * n.cast("long"), "C": 100 * capitals.cast("long") > 10 * F.length(text).cast("long"), "D": text.rlike(r"[#$%&*|]")}


def flags(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, A to E and the counts n, good and toxic: rows that agree in text and labels are counted together."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), *(f.alias(k) for k, f in text_flags(text).items()),
    )
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc")).agg(*(F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))))
    rows = rows.join(marks, "doc", "left").fillna(0, ["good", "toxic"])
    of_text, of_doc = ["digest", "A", "B", "C", "D"], ["part", "good", "toxic"]
    # copies are counted before they meet: of each text there is one row for each part and label, with its smallest doc_id
    rows = rows.groupBy(*of_text, *of_doc, "doc").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.groupBy(*of_text, *of_doc).agg(F.sum("n").alias("n"), F.min(F.struct("doc", "n")).alias("least"))
    first = F.col("least.doc") == F.min("least.doc").over(W.partitionBy("digest"))
    rows = rows.withColumn("firsts", F.when(first, F.col("least.n")).otherwise(0))
    split = F.explode(F.array(F.struct(F.lit(False).alias("E"), F.col("firsts").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("firsts")).alias("n"))))
    rows = rows.select("part", "A", "B", "C", "D", split.alias("s"), "good", "toxic").where("s.n > 0")
    n = F.col("s.n")
    return rows.select("part", "A", "B", "C", "D", F.col("s.E").alias("E"), n.alias("n"), (n * F.col("good")).alias("good"), (n * F.col("toxic")).alias("toxic"))


def profiles(flagged: DataFrame) -> DataFrame:
    """The counts by part and combination of flags."""
    return flagged.groupBy("part", *FILTERS).agg(*(F.sum(c).alias(c) for c in COUNTS))


def survivors(counted: DataFrame) -> DataFrame:
    """(part, subset, n, good, toxic): documents that pass the filters of a subset, for all 32 subsets of every part."""
    cubed = counted.cube("part", *FILTERS).agg(F.grouping("part").alias("whole"), *(F.grouping(f).alias(f"any_{f}") for f in FILTERS), *(F.sum(c).alias(c) for c in COUNTS))
    passed = F.lit(True)
    for f in FILTERS:
        passed = passed & ((F.col(f"any_{f}") == 1) | ~F.col(f))
    subset = sum((F.when(F.col(f"any_{f}") == 0, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(FILTERS)), F.lit(0))
    found = cubed.where((F.col("whole") == 0) & passed).select("part", subset.alias("subset"), *COUNTS)
    every = counted.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(ALL))).alias("subset"))
    return every.join(found, ["part", "subset"], "left").fillna(0, list(COUNTS))


def orders() -> list[tuple[str, int, int, int, int]]:
    """(filter_order, step, filter's bit, subset before, subset after) of every step of every order: a fixed list."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            bit = 1 << FILTERS.index(f)
            out.append(("".join(order), step, bit, before, before | bit))
            before |= bit
    return out


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    spark = docs.sparkSession
    passed = materialize(survivors(materialize(profiles(flags(docs, labels, part)))))
    steps = spark.createDataFrame(orders(), "filter_order string, step int, bit int, before int, after int")
    before = passed.select("part", F.col("subset").alias("before"), *(F.col(c).alias(f"{c}_before") for c in COUNTS))
    after = passed.select("part", F.col("subset").alias("after"), *(F.col(c).alias(f"{c}_after") for c in COUNTS))
    rows = before.join(F.broadcast(steps), "before").join(after, ["part", "after"])
    # what fails a filter at all, and what fails no other filter
    alone = passed.where(" or ".join(f"subset = {1 << k}" for k in range(len(FILTERS)))).select("part", F.col("subset").alias("bit"), F.col("n").alias("n_alone"))
    others = passed.where(" or ".join(f"subset = {ALL - (1 << k)}" for k in range(len(FILTERS)))).select("part", (ALL - F.col("subset")).alias("bit"), F.col("n").alias("n_others"))
    ends = passed.groupBy("part").agg(F.max(F.when(F.col("subset") == 0, F.col("n"))).alias("n_all"), F.max(F.when(F.col("subset") == ALL, F.col("n"))).alias("n_none"))
    facts = alone.join(others, ["part", "bit"]).join(ends, "part").select("part", "bit", (F.col("n_all") - F.col("n_alone")).alias("fails"), (F.col("n_others") - F.col("n_none")).alias("unique_fails"))
    removed = F.col("n_before") - F.col("n_after")
    # every order has one step of each filter, so this sums over all orders
    shares = rows.groupBy("part", "bit").agg(F.sum(removed).cast("long").alias("shapley"))
    rows = rows.join(facts, ["part", "bit"]).join(shares, ["part", "bit"])
    return rows.select(
        "part", "filter_order", "step", F.substring("filter_order", F.col("step"), F.lit(1)).alias("filter"), F.col("n_after").cast("long").alias("kept"), removed.cast("long").alias("removed"),
        (F.col("fails") - removed).cast("long").alias("redundant"), F.col("unique_fails").cast("long").alias("unique_fails"), (F.col("good_before") - F.col("good_after")).cast("long").alias("good_lost"),
        (F.col("toxic_before") - F.col("toxic_after")).cast("long").alias("toxic_lost"), "shapley",
    )

