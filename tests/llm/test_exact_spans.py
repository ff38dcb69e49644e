import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_spans, suffix


def brute(rows):
    """(n_bytes, n_removed, n_spans, sha) a row; rows are (doc_id or None, text)."""
    key = lambda d: float("inf") if d is None else d
    least = {}
    raws = [(key(d), (t or "").encode()) for d, t in rows]
    for d, raw in raws:
        for i in range(len(raw) - 49):
            w = raw[i : i + 50]
            least[w] = min(least.get(w, d), d)
    out = []
    for d, raw in raws:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 49):
            if least[raw[i : i + 50]] < d:
                gone[i : i + 50] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()) if len(raw) else 0
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_suffix_array(seed):
    rng = np.random.default_rng(seed)
    for trial in range(120):
        n, k = int(rng.integers(1, 150)), int(rng.integers(1, 5))
        t = rng.integers(1, 1 + k, n)
        if trial % 3 == 0:
            t = np.resize(t[: max(1, n // 7)], n)
        t = np.append(t, 0).astype(np.uint16)
        assert suffix.suffix_array(t, 258).tolist() == sorted(range(len(t)), key=lambda i: tuple(t[i:]))


def test_repeats_groups_equal_windows():
    rng = random.Random(2)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randint(3, 40))).encode() for _ in range(40)]
    data = np.frombuffer(b"".join(p + b"\0" for p in parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    starts = np.cumsum(sizes + 1) - sizes - 1
    at, group = suffix.repeats(data, starts, sizes, 9)
    windows = {}
    for i, g in zip(at.tolist(), group.tolist(), strict=True):
        windows.setdefault(data[i : i + 9].tobytes(), set()).add(g)
    assert all(len(g) == 1 for g in windows.values()) and len(windows) == len(set(group.tolist()))
    assert len(at) == sum(max(0, len(p) - 8) for p in parts)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(9, 40))) for _ in range(12)]
    texts = []
    for _ in range(60):
        texts.append(" ".join(rng.choice(passages) if rng.random() < 0.3 else word() for _ in range(rng.randint(1, 25))))
    texts += [texts[3], texts[3] + "!", "x" + texts[5], "ab" * 400, "ab" * 300, "q" * 49, "q" * 50, "q" * 51, "", None]
    return texts


@pytest.mark.parametrize("seed", range(2))
def test_table(spark, monkeypatch, seed):
    if seed:  # small slabs, runs, batches and shards: all their edges
        for name, value in (("SLAB", 200), ("BATCH", 500), ("SHARD", 300), ("HELD", 3)):
            monkeypatch.setattr(exact_spans, name, value)
    texts = corpus(seed)
    rows = list(enumerate(texts)) + [(None, texts[0]), (None, "z" * 70), (None, "z" * 80), (7, texts[9]), (7, texts[9]), (8, texts[7])]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, seg string").repartition(5)
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in exact_spans.digest(docs).collect())
    assert got == sorted((str(d), *b) for (d, _), b in zip(rows, brute(rows), strict=True))


def test_oversized_anchor_groups(monkeypatch):
    monkeypatch.setattr(exact_spans, "SHARD", 40)
    rng = random.Random(5)
    raw = [("".join(rng.choice("ab") for _ in range(30)) + "shared text of one anchor " * 4 + "".join(rng.choice("ab") for _ in range(30))).encode() for _ in range(30)]
    doc, zero = np.arange(30, dtype=np.int64), np.zeros(30, np.int64)
    gone = [np.zeros(len(r), bool) for r in raw]
    for d, _, off, n in exact_spans._covered(doc, zero, zero, raw):
        for k, a, size in zip(d.tolist(), off.tolist(), n.tolist(), strict=True):
            gone[k][a : a + size] = True
    want = brute([(i, r.decode()) for i, r in enumerate(raw)])
    assert [int(g.sum()) for g in gone] == [w[1] for w in want]


def test_rows_without_an_id_whose_texts_share_a_32_bit_hash(spark):
    """Each row loses its own bytes: the second null-id text holds nothing of the passage."""
    passage, other = "the passage that the first document holds too, of more than fifty bytes ", "something else altogether, long enough to have windows of its own here "
    numbers = spark.range(150000).select(F.col("id").cast("string").alias("i"))
    a = numbers.select(F.concat(F.lit(passage), "i").alias("a")).withColumn("h", F.hash("a"))
    b = numbers.select(F.concat(F.lit(other), "i").alias("b")).withColumn("h", F.hash("b"))
    pair = a.join(b, "h").first()
    rows = [(1, passage), (None, pair["a"]), (None, pair["b"])]
    got = {r["kept_sha256"]: r["n_removed"] for r in exact_spans.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {sha: removed for _, removed, _, sha in brute(rows)} and got[hashlib.sha256(pair["b"].encode()).hexdigest()] == 0


def test_empty(spark):
    assert exact_spans.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_outputs_spans_and_bytes(spark):
    docs = spark.createDataFrame([(1, "m" * 20 + "0123456789" * 6), (2, "n" * 10 + "0123456789" * 6)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in exact_spans.deduplicated(docs).collect()}
    assert bytes(got[1]["raw"]) == b"m" * 20 + b"0123456789" * 6 and got[1]["spans"] == []
    assert bytes(got[2]["raw"]) == b"n" * 10 and [tuple(s) for s in got[2]["spans"]] == [(10, 70)]
