import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import near_docs, simhash


def test_near_copies_of_jaccard_0_8_go(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows, sets, near = [], {}, set()
    for i in range(150):
        words = [word() for _ in range(300)]
        copy = list(words)
        for k in rng.sample(range(300), rng.randint(1, 9)):
            copy[k] = word()
        for d, w in ((2 * i, words), (2 * i + 1, copy)):
            rows.append((d, " ".join(w), "x"))
            sets[d] = {tuple(w[j : j + 5]) for j in range(296)}
        a, b = sets[2 * i], sets[2 * i + 1]
        if len(a & b) / len(a | b) >= 0.8:
            near.add(2 * i + 1)
    rows += [(1000, None, "x"), (1001, "", "x"), (None, rows[0][1], "x"), (None, "alone here", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __row string")
    got = near_docs.deduplicated(docs)
    assert got.columns == docs.columns
    kept = sorted(str(r["doc_id"]) for r in got.collect())
    assert 40 < len(near) < 145
    assert kept == sorted(str(d) for d in [*sets, 1000, None] if d not in near)


def test_fingerprints_propose_pairs_of_their_own(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    texts = {}
    for i in range(60):
        words = [word() for _ in range(400)]
        copy = list(words)
        for k in rng.sample(range(400), rng.randint(1, 3)):
            copy[k] = word()
        texts |= {2 * i: " ".join(words), 2 * i + 1: " ".join(copy)}
    prints = simhash.fingerprints([texts[d] for d in range(120)], 3)
    near = {2 * i + 1 for i in range(60) if np.bitwise_count(prints[2 * i] ^ prints[2 * i + 1]) <= 2}
    assert 10 < len(near) < 60
    # no band proposes anything
    none = lambda sets, bands, loose: sets.select(F.lit(0).cast("long").alias("group"), F.lit(0).alias("band"), F.lit(2).cast("long").alias("n"), "id").limit(0)
    monkeypatch.setattr(near_docs, "candidates", none)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in near_docs.deduplicated(docs).collect()} == set(texts) - near
    # of texts with one fingerprint the alike ones go, and they alone
    monkeypatch.setattr(near_docs, "fingerprints", lambda texts, width: np.zeros(len(texts), np.uint64))
    alike = {2 * i + 1 for i in range(60)}
    assert {r["doc_id"] for r in near_docs.deduplicated(docs).collect()} == set(texts) - alike
