import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing


def water(sizes, repeats=3.0):
    """Targets by resharing step by step; sizes by source in order."""
    weights = {s: i % 3 + 1.0 for i, s in enumerate(sizes)}
    total, target, open_ = float(sum(sizes.values())), {}, set(sizes)
    while open_:
        level = (total - sum(target.values())) / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > repeats * sizes[s]}
        if not over:
            return target | {s: level * weights[s] for s in open_}
        target |= {s: repeats * sizes[s] for s in over}
        open_ -= over
    return target


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    names = ["b", "a", "é", "hot", "", "tiny", None, "Z"]
    out = [(i, "w " * int(rng.integers(0, 40)), "hot" if i % 3 == 0 else names[int(rng.integers(len(names)))], 5) for i in range(900)]
    return [*out, (900, None, "a", 5), (901, "x", "tiny", 5), (None, "y y", "a", 5), (901, "x", "tiny", 5)]


def test_report(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(3)
    got = mixing.mix_report(docs, shard_words=800).collect()
    assert len(got) == len(rows)
    sizes: dict = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    ordered = {s: sizes[s] for s in sorted(sizes, key=lambda s: (s is None, s or ""))}
    target = water(ordered)
    source = {d: s for d, _, s, _ in rows}
    taken: dict = defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], target[s], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * len(r["shards"])
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 3 for s in sizes)
    again = mixing.mix_report(docs.repartition(7), shard_words=800).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))


def test_mix_rows(spark, rows):
    docs = spark.createDataFrame(rows[:-1], "doc_id long, text string, source string, mix int")
    report = {(r["doc_id"]): r for r in mixing.mix_report(docs, shard_words=800).collect()}
    mixed = mixing.mix(docs, shard_words=800)
    assert mixed.columns == [*docs.columns, "mix_"]
    counts = Counter(r["doc_id"] for r in mixed.collect())
    assert counts == Counter({d: len(r["shards"]) for d, r in report.items() if r["shards"]})


def test_tree_deals_every_draw_once(spark):
    quotas = spark.createDataFrame([("sa", 37), ("sb", 500), ("sc", 1), ("sd", 0)], "skey string, quota long")
    dealt = mixing.splitting_tree(quotas, 3, 42).collect()
    per: dict = defaultdict(list)
    shards: Counter = Counter()
    for r in dealt:
        per[r["skey"]] += range(r["first"], r["first"] + r["n"])
        shards[r["shard"]] += r["n"]
    assert {k: sorted(v) for k, v in per.items()} == {"sa": list(range(37)), "sb": list(range(500)), "sc": [0]}
    assert max(shards.values()) - min(shards.values()) <= 1 and len(shards) == 8


def test_many_sources_are_split_in_groups(spark, monkeypatch):
    """Groups of groups: every draw goes somewhere once, halves differ by one at most, and a source's share follows the law's mean."""
    monkeypatch.setattr(mixing, "WIDE", 4)
    sizes = {f"s{i:03d}": (i * 7) % 40 for i in range(60)}
    quotas = spark.createDataFrame(list(sizes.items()), "skey string, quota long")
    left: Counter = Counter()
    for seed in range(5):
        dealt = mixing.splitting_tree(quotas, 2 if seed else 1, 100 + seed).collect()
        per, shards = defaultdict(list), Counter()
        for r in dealt:
            per[r["skey"]] += range(r["first"], r["first"] + r["n"])
            shards[r["shard"]] += r["n"]
            left[r["skey"]] += r["n"] if r["shard"] < (2 if seed else 1) else 0
        assert {k: sorted(v) for k, v in per.items()} == {k: list(range(n)) for k, n in sizes.items() if n}
        assert max(shards.values()) - min(shards.values()) <= 1 and len(shards) == (4 if seed else 2)
    # five draws of the left half: standard deviation of the sum is sqrt(5 n / 4) at most
    assert all(abs(left[k] - 2.5 * n) <= 5 * (1.25 * n) ** 0.5 for k, n in sizes.items())


def test_hypergeometric_law(spark):
    n, good, pool = 12, 9, 30
    u = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)
    draws = spark.range(40000).select(mixing._hypergeometric(F.lit(float(n)), F.lit(float(good)), F.lit(float(pool)), u).alias("k")).groupBy("k").count().collect()
    for r in draws:
        k = int(r["k"])
        p = math.comb(good, k) * math.comb(pool - good, n - k) / math.comb(pool, n)
        assert abs(r["count"] / 40000 - p) < 0.012


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_report(docs).count() == 0 and mixing.mix(docs).count() == 0


def test_heavily_repeated_rows_get_all_their_passes(spark):
    rows = [(i, "w " * 10, "a") for i in range(2200)] + [(5000 + i, "w w w w", "b") for i in range(10) for _ in range(200)]
    got = mixing.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string"), shard_words=4000)
    row = got.where("doc_id >= 5000").agg(F.sum("taken"), F.max("target")).first()
    # the target is 2.5 times the source; a document's 200 equal rows go together
    assert math.isclose(row[1], 20000) and abs(row[0] - 20000) <= 800
