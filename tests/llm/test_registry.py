"""The registered queries over whole tables of the smallest size, against brute force."""

import hashlib
import os

import numpy as np
import pytest
import tiktoken
from test_simhash import components, naive

import public_tokenizers
from tessera.llm import langid, registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()
    return {r["vec_id"]: np.array(r["embedding"], float) for r in rows if r["embedding"] is not None}


def test_op1(spark, vectors):
    got: dict = {}
    for r in registry.op1_nearest_neighbours(spark, DATA).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {v for v in vectors if v % 100 == 0}
    hits = total = 0
    for q, found in got.items():
        best = sorted((float(np.sqrt(((x - vectors[q]) ** 2).sum())), v) for v, x in vectors.items() if v != q)[:10]
        hits += len({v for _, v, _ in found} & {v for _, v in best})
        total += len(best)
        assert all(abs(s - np.sqrt(((vectors[v] - vectors[q]) ** 2).sum())) < 1e-12 for _, v, s in found)
    assert hits >= 0.9 * total


def test_op3(spark, docs):
    fps = [naive(t) for _, t in docs]
    root = components(fps, 2)
    low: dict = {}
    for (d, _), r in zip(docs, root, strict=True):
        low[r] = min(low.get(r, d), d)
    want = sorted((d, f"{f:016x}", low[r]) for (d, _), f, r in zip(docs, fps, root, strict=True))
    assert sorted(tuple(r)[:3] for r in registry.op3_simhash_dedup(spark, DATA).collect()) == want


def test_op4(spark, vectors):
    ids = sorted(vectors)
    x = np.stack([vectors[i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = x @ x.T >= 0.9
    np.fill_diagonal(links, False)
    got = {r["vec_id"]: r for r in registry.op4_embedding_dedup(spark, DATA).collect()}
    assert set(ids) <= set(got) and all(got[i]["n_links"] <= n for i, n in zip(ids, links.sum(axis=1).tolist(), strict=True))
    assert sum(got[i]["n_links"] for i in ids) >= 0.9 * links.sum()


def test_op2_and_op7(spark, docs):
    ranks = {}
    with open(public_tokenizers.path(registry.VOCABULARY), "rb") as lines:
        import base64

        for line in lines:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    encoding = tiktoken.Encoding("here", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for d, t in docs:
        ids = np.array(encoding.encode_ordinary(t or ""), "<u4")
        want[d] = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in registry.op7_byte_bpe(spark, DATA).collect()} == want
    histogram = registry.op2_token_counts(spark, DATA)
    assert histogram.count() >= len({n for n, _, _ in want.values()})


def test_op8(spark, docs):
    seen: dict = {}
    for d, t in sorted(docs):
        raw = (t or "").encode()
        for i in range(len(raw) - 49):
            seen.setdefault(raw[i : i + 50], d)
    want = {}
    for d, t in docs:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, int)
        for i in range(len(raw) - 49):
            if seen[raw[i : i + 50]] < d:
                gone[i : i + 50] = 1
        kept = np.frombuffer(raw, np.uint8)[gone[:-1] == 0].tobytes()
        want[d] = (len(raw), int(gone.sum()), int((np.diff(np.append(0, gone)) == 1).sum()), hashlib.sha256(kept).hexdigest())
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in registry.op8_repeated_spans(spark, DATA).collect()} == want


def test_language_of_a_text_by_hand(spark):
    """Windows, filters, pooling, logits and the mean over windows, one byte at a time."""
    rng = np.random.default_rng(0)
    net = langid.ByteCNN(["a", "b", "c"], [rng.normal(0, 0.3, (w, 256, langid.FILTERS)).astype(np.float32) for w in langid.WIDTHS], rng.normal(size=48).astype(np.float32), rng.normal(size=(48, 3)).astype(np.float32), rng.normal(size=3).astype(np.float32))
    texts = ["short", "é" * 300, "word " * 130]
    for text, (lang, score) in zip(texts, net.predict(texts), strict=True):
        raw = text.encode()
        cut = [raw[i : i + langid.WINDOW].ljust(langid.WINDOW, b"\0") for i in range(0, len(raw), langid.WINDOW)]
        logits = []
        for window in cut:
            pooled = [max(sum(c[j][window[p + j], f] for j in range(w)) for p in range(langid.WINDOW - w + 1)) for w, c in zip(langid.WIDTHS, net.conv, strict=True) for f in range(langid.FILTERS)]
            logits.append(np.maximum(np.array(pooled) + net.bias, 0) @ net.dense + net.out)
        e = np.exp(np.mean(logits, axis=0) - np.max(np.mean(logits, axis=0)))
        p = e / e.sum()
        assert net.langs[int(p.argmax())] == lang and abs(p.max() - score) < 1e-3


def test_every_query_answers_for_every_document(spark, docs):
    n = len(docs)
    for name in ("op5_fuzzy_lines", "op6_language_id", "op9_mix_sources", "op10_toxicity"):
        got = registry.queries()[name](spark, DATA)
        assert sorted(r[0] for r in got.select("doc_id").collect()) == sorted(d for d, _ in docs) and got.count() == n
    mixed = registry.op9_mix_sources(spark, DATA).collect()
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in mixed)
