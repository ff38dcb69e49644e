"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every step is a DataFrame or SQL expression. The unit of the draw is a *block*: each source's
documents are dealt to at most ``FANOUT`` blocks by a seeded hash, so a hot source never meets in one task.

1. ``source_targets``: weights 1, 2, 3, ... by source order share 100 % of all words; a target stops
   at ``max_repeats`` times its source and the excess is reshared (water filling in closed form).
2. ``block_quotas``: each source's permuted blocks, pass after pass, up to its target. The block in which
   the target ends is cut at a sub-block, and that at a document; what is then still missing is filled by
   the one document, of those that the last pass leaves out, whose size comes nearest to it.
3. ``splitting_tree``: the exact block quotas are split among 2**depth output shards. Each node draws
   its left child's counts from the multivariate hypergeometric law (inverse CDF of a seeded hash,
   source after source, and group after group where there are many); the right child gets the rest.
4. ``mix``: a shard takes the next so many blocks in the source's permuted order (disjoint ranges) and
   orders its documents by a seeded hash.

Defined cases: null text has no words; a null source is a source of its own and the last one; documents
without words are dealt like others and take nothing; repeated rows are dealt alike; an empty table
gives an empty mix; columns other than doc_id, text and source pass through ``mix`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize

#: The most blocks of a source, and the most sub-blocks of a block.
FANOUT, SUBS = 65536, 1024
#: Documents that a block holds on average, until FANOUT binds.
BLOCK_DOCS = 64
#: Items of a splitting-tree node, on average at most.
WIDE = 256
#: Words in an output shard, on average.
SHARD_WORDS = 1 << 24
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def _sum_before(column: str, order) -> Column:
    return F.coalesce(F.sum(column).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))


def source_targets(sizes: DataFrame, max_repeats: float, weights: int = 3) -> DataFrame:
    """(skey, n_docs, source_size, target), one row a source, from (skey, source, size).

    With the sources sorted by cap / weight, the level after saturating those before a source is (total
    less their caps) / (the weights from it on). The water level is the first that its own source's ratio
    isn't below. The single-partition windows run over one row a source."""
    per = sizes.groupBy("skey").agg(F.max("source").alias("source"), F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    everything = W.partitionBy(F.lit(1))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", ((F.row_number().over(by_name) - 1) % weights + 1).cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    per = per.withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = everything.orderBy("ratio", "skey")
    total, all_weights = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    per = per.withColumn("level", (total - _sum_before("cap", by_ratio)) / (all_weights - _sum_before("weight", by_ratio)))
    per = per.withColumn("order", F.row_number().over(by_ratio))
    first = F.min_by(F.col("level"), F.when(F.col("level") <= F.col("ratio"), F.col("order"))).over(everything)
    target = F.least("cap", F.coalesce(first, F.lit(float("inf"))) * F.col("weight"))
    return per.withColumn("target", target).select("skey", "n_docs", "source_size", "target")


def _cumulated(rows: DataFrame, keys: list[str], unit: str, seed: int) -> DataFrame:
    """Units of each key in seeded order: rank, order hash, ``done`` (wholly within ``rest``), ``left``
    (what of ``rest`` is left before the unit) and ``cut`` (``rest`` ends within it)."""
    rows = rows.withColumn("order", F.xxhash64(F.lit(seed), *keys, unit))
    order = W.partitionBy(*keys).orderBy("order", unit)
    before = F.coalesce(F.sum("words").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("rank", F.row_number().over(order) - 1).withColumn("left", F.col("rest") - before)
    return rows.withColumn("done", F.col("left") >= F.col("words")).withColumn("cut", ~F.col("done") & (F.col("left") > 0))


def block_quotas(placed: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(blocks, edges) of ``placed`` (skey, block, sub, h, doc_id, size, source_size, target, n_blocks).

    blocks: skey, block, n_blocks, whole (complete passes), rank, done, cut. edges: skey, block, and up to which
    sub-block (sub_order) and document (last: struct of h and doc_id) the cut block is taken, and the words
    still missing then."""
    per = placed.groupBy("skey", "block").agg(F.sum("size").alias("words"), *(F.max(c).alias(c) for c in ("source_size", "target", "n_blocks")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    per = per.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    blocks = materialize(_cumulated(per, ["skey"], "block", seed))
    inner = placed.select("skey", "block", "sub", "h", "doc_id", "size").join(blocks.where("cut").select("skey", "block", F.col("left").alias("rest")), ["skey", "block"])
    inner = materialize(inner)
    subs = _cumulated(inner.groupBy("skey", "block", "sub").agg(F.sum("size").alias("words"), F.max("rest").alias("rest")), ["skey", "block"], "sub", seed)
    cut = subs.where("cut").select("skey", "block", "sub", F.col("left").alias("rest"), F.col("order").alias("sub_order"))
    order = W.partitionBy("skey", "block", "sub").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    docs = inner.drop("rest").join(cut, ["skey", "block", "sub"]).withColumn("upto", F.sum("size").over(order))
    within = F.col("upto") <= F.col("rest")
    edges = docs.groupBy("skey", "block").agg(
        F.max("sub_order").alias("sub_order"), F.max(F.when(within, F.struct("h", "doc_id"))).alias("last"),
        (F.max("rest") - F.coalesce(F.max(F.when(within, F.col("upto"))), F.lit(0))).alias("missing"))
    return blocks, edges


def _hypergeometric(n: Column, good: Column, pool: Column, u: Column) -> Column:
    """How many of ``n`` draws without replacement from ``pool`` items are among its ``good`` ones: the
    inverse CDF at ``u`` in [0, 1), as doubles. Probabilities are relative to that of the lowest count and
    follow from each other's ratio; beyond 12 standard deviations they are left out (below 1e-30)."""
    mean = n * good / pool
    sd = F.sqrt(F.greatest(mean * (1 - good / pool) * (pool - n) / F.greatest(pool - 1, F.lit(1.0)), F.lit(0.0)))
    lo = F.greatest(F.lit(0.0), n + good - pool, F.floor(mean - 12 * sd).cast("double"))
    hi = F.least(n, good, F.ceil(mean + 12 * sd).cast("double"))
    ks = F.transform(F.sequence(lo.cast("long"), hi.cast("long")), lambda k: k.cast("double"))

    def after(s: Column, k: Column) -> Column:
        """p(k) from p(k - 1), or 1 at the lowest count."""
        return F.when(k == lo, F.lit(1.0)).otherwise(s["p"] * (good - k + 1) * (n - k + 1) / (k * (pool - good - n + k)))

    state = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("c"))
    total = F.aggregate(ks, state, lambda s, k: F.struct(after(s, k).alias("p"), (s["c"] + after(s, k)).alias("c")), lambda s: s["c"])
    start = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("c"), lo.alias("k"), total.alias("t"))
    return F.aggregate(
        ks, start,
        lambda s, k: F.struct(after(s, k).alias("p"), (s["c"] + after(s, k)).alias("c"), F.when(s["c"] <= u * s["t"], k).otherwise(s["k"]).alias("k"), s["t"].alias("t")),
        lambda s: s["k"],
    )


def _drawn(items: DataFrame, need: DataFrame, keys: list[str], item: str, salt: int) -> DataFrame:
    """(keys, item, n, got): how many of a node's ``need`` draws fall on each of its items, from the multivariate hypergeometric law.

    A node is one row with the array of its items, ``WIDE`` on average at most; item after item takes its share of what is left."""
    node = items.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(item, F.col("n").cast("double").alias("n")))).alias("counts")).join(need, keys)
    pool = F.aggregate("counts", F.lit(0.0), lambda s, x: s + x["n"])
    start = F.struct(F.col("need").cast("double").alias("need"), pool.alias("pool"), F.array().cast("array<double>").alias("got"))

    def draw(s: Column, x: Column) -> Column:
        u = F.pmod(F.xxhash64(F.lit(salt), F.col("shard"), x[item]), F.lit(1 << 40)) / F.lit(float(1 << 40))
        got = F.when((x["n"] <= 0) | (s["need"] <= 0), F.lit(0.0)).otherwise(_hypergeometric(s["need"], x["n"], s["pool"], u))
        return F.struct((s["need"] - got).alias("need"), (s["pool"] - x["n"]).alias("pool"), F.concat(s["got"], F.array(got)).alias("got"))

    drawn = F.arrays_zip("counts", F.aggregate("counts", start, draw, lambda s: s["got"]).alias("got"))
    rows = node.select(*keys, F.explode(drawn).alias("d"))
    return rows.select(*keys, F.col(f"d.counts.{item}").alias(item), F.col("d.counts.n").cast("long").alias("n"), F.col("d.got").cast("long").alias("got"))


def splitting_tree(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """(skey, shard, first, n): which ``n`` of each source's draws, from number ``first`` on, go to a shard.

    ``quotas`` has (skey, quota). Every level of the tree halves all shards at once. Many sources are dealt by hash to groups, and these to
    groups of groups, until ``WIDE`` are left: a shard's half is first drawn among the outermost groups, then within each of them. That is the
    same law, since a group's sources share its draws hypergeometrically, and no row ever holds all sources."""
    n_sources = quotas.count()
    levels = 0
    while WIDE ** (levels + 1) < n_sources:
        levels += 1
    paths = [f"g{k}" for k in range(1, levels + 1)]
    group = F.pmod(F.xxhash64(F.lit(seed), "skey"), F.lit(WIDE**levels))
    # g1 are the outermost groups; each later number holds those before it
    current = quotas.select(F.lit(0).cast("long").alias("shard"), "skey", F.col("quota").alias("n"), *(F.floor(group / F.lit(WIDE ** (levels - k))).cast("long").alias(g) for k, g in enumerate(paths, 1)))
    for level in range(depth):
        salt = seed + 1000 * (level + 1)
        need = current.groupBy("shard").agg(F.floor(F.sum("n") / 2).alias("need"))
        for k in range(levels):
            sums = current.groupBy("shard", *paths[: k + 1]).agg(F.sum("n").alias("n"))
            got = _drawn(sums, need, ["shard", *paths[:k]], paths[k], salt)
            need = got.select("shard", *paths[: k + 1], F.col("got").alias("need"))
            need = materialize(need) if k else need
        got = _drawn(current, need, ["shard", *paths], "skey", salt)
        sides = F.array(F.struct((F.col("shard") * 2).alias("shard"), F.col("got").alias("n")), F.struct((F.col("shard") * 2 + 1).alias("shard"), (F.col("n") - F.col("got")).alias("n")))
        current = materialize(got.select("skey", *paths, F.explode(sides).alias("c")).select("c.shard", "skey", "c.n", *paths))
    before = W.partitionBy("skey").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return current.select("shard", "skey", "n").withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).where("n > 0")


def mix_plan(docs: DataFrame, max_repeats: float = 3.0, seed: int = 42, shard_words: int = SHARD_WORDS) -> DataFrame:
    """A row for each row of ``docs``: doc_id, h, size, source_size, target and ``deals``, an array of (epoch, shard),
    one for each time that the mix takes the document."""
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))
    sizes = materialize(sizes.withColumn("skey", _key(F.col("source"))))
    targets = materialize(source_targets(sizes.select("skey", "source", "size"), max_repeats))
    n_blocks = F.greatest(F.lit(1), F.least(F.lit(FANOUT), F.ceil(F.col("n_docs") / BLOCK_DOCS))).cast("int")
    placed = sizes.join(targets, "skey").withColumn("n_blocks", n_blocks)
    placed = placed.withColumn("block", F.pmod("h", "n_blocks").cast("int")).withColumn("sub", F.pmod(F.shiftright("h", 24), F.lit(SUBS)).cast("int"))
    placed = materialize(placed.select("doc_id", "h", "skey", "size", "source_size", "target", "n_blocks", "block", "sub"))
    blocks, edges = block_quotas(placed, seed)
    passes = F.when(F.col("done") | F.col("cut"), F.col("whole")).otherwise(F.col("whole") - 1)
    drawn = blocks.where(passes >= 0).select("skey", "block", "cut", "whole", "n_blocks", "rank", F.explode(F.sequence(F.lit(0), passes)).alias("epoch"))
    # numbered without gaps: repeated rows can leave blocks empty
    drawn = drawn.withColumn("draw", (F.row_number().over(W.partitionBy("skey").orderBy("epoch", "rank")) - 1).cast("long"))
    quotas = drawn.groupBy("skey").agg(F.count(F.lit(1)).alias("quota"))
    words = targets.agg(F.sum("target")).first()[0] or 0
    depth = max(1, int(max(1, words / shard_words) - 1).bit_length())
    dealt = splitting_tree(quotas, depth, seed).select("skey", "shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("draw"))
    deals = drawn.join(dealt, ["skey", "draw"]).groupBy("skey", "block").agg(
        F.sort_array(F.collect_list(F.struct("epoch", "shard", (F.col("cut") & (F.col("epoch") == F.col("whole"))).alias("partial"), (F.col("epoch") == F.col("whole")).alias("last")))).alias("deals"))
    edges = materialize(edges)
    rows = placed.join(deals, ["skey", "block"], "left").join(edges.withColumnRenamed("block", "cut_block"), "skey", "left")
    sub_order = F.xxhash64(F.lit(seed), "skey", "block", "sub")
    in_cut = (sub_order < F.col("sub_order")) | ((sub_order == F.col("sub_order")) & F.coalesce(F.struct("h", "doc_id") <= F.col("last"), F.lit(False)))
    # without an edge row all of the cut block is within the quota
    dealt_all = F.when(F.col("block") == F.col("cut_block"), in_cut).otherwise(True)
    none = F.array().cast("array<struct<epoch:int,shard:bigint,partial:boolean,last:boolean>>")
    rows = rows.withColumn("deals", F.filter(F.coalesce("deals", none), lambda x: dealt_all | ~x["partial"]))
    rows = materialize(rows.select("doc_id", "h", "skey", "size", "source_size", "target", "deals", "missing"))
    # the filler takes the place of what the cut block lacks, in the shard that the block went to
    off = F.abs(F.col("size") - F.col("missing"))
    spare = (off < F.col("missing")) & ~F.exists("deals", lambda x: x["last"])
    filler = rows.where(spare).groupBy("skey").agg(F.min(F.struct(off.alias("off"), "h", "doc_id")).alias("f"))
    place = drawn.where(F.col("cut") & (F.col("epoch") == F.col("whole"))).join(dealt, ["skey", "draw"]).select("skey", F.struct(F.col("epoch"), F.col("shard")).alias("place"))
    rows = rows.join(filler.join(place, "skey"), "skey", "left")
    deals_of = F.transform("deals", lambda x: F.struct(x["epoch"].alias("epoch"), x["shard"].alias("shard")))
    fills = F.coalesce((F.col("h") == F.col("f.h")) & F.col("doc_id").eqNullSafe(F.col("f.doc_id")), F.lit(False))
    taken = F.when(fills, F.concat(deals_of, F.array("place"))).otherwise(deals_of)
    return rows.select("doc_id", "h", "size", "source_size", "target", taken.alias("deals"))


def mix(docs: DataFrame, max_repeats: float = 3.0, seed: int = 42, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The mix: the columns of ``docs``, once for each time that a document is taken, and a last column ``mix`` (with
    underscores added while ``docs`` has such a column): a struct of epoch, shard and order. To write it, repartition by
    shard and sort within partitions by order."""
    plan = mix_plan(docs, max_repeats, seed, shard_words).dropDuplicates(["doc_id", "h"]).select(F.col("doc_id").alias("id"), "h", F.explode("deals").alias("deal"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("key"))
    joined = keyed.join(plan, (F.col("key") == F.col("h")) & F.col("row.doc_id").eqNullSafe(F.col("id")))
    name = "mix"
    while name in docs.columns:
        name += "_"
    order = F.xxhash64(F.lit(seed), "key", "deal.epoch")
    place = F.struct(F.col("deal.epoch").alias("epoch"), F.col("deal.shard").alias("shard"), order.alias("order"))
    return joined.select(*(F.col("row").getField(c).alias(c) for c in docs.columns), place.alias(name))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken and the shards dealt to: one row for each document."""
    rows = mix_plan(docs, **options)
    return rows.select(
        "doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("size") * F.size("deals")).alias("taken"),
        F.transform("deals", lambda x: x["shard"]).alias("shards"),
    )
