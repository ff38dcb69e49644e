import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from tessera.llm import tokens

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("reference", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


PARTS = ["a", "bc", " ", "  ", "\n", "'s", "'re", "'", "r", "1", "23", "é", "Ж", "!", "?!", "\t", "　", "don't", "🙂", "<|endoftext|>"]


@pytest.mark.parametrize("seed", range(6))
def test_chunks_stitch_to_the_whole_text(reference, seed):
    rng, bpe = random.Random(seed), tokens.load(PATH, PATTERN)
    for k in range(150):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 250)))
        if k % 4 == 0:
            text = text.replace("a", " " * rng.randint(1, 70))
        if k % 5 == 0:
            text = text.replace("bc", "x" * rng.randint(1, 120))
        chunk, overlap = rng.choice([(40, 10), (60, 20), (100, 30), (64, 12)])
        ids = tokens.encode_text(bpe, text, chunk, overlap)
        assert ids.tolist() == reference.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_digests_of_a_table(spark, reference):
    long_text = "Wörter und  Zahlen 123 'tis\n" * 3000 + " " * 5000 + "y" * 5000
    rows = [(1, "hello world", 0), (2, "", 0), (3, None, 0), (4, long_text, 0), (4, long_text, 0), (None, "x", 0), (5, "hello world", 0), (6, "é" * 40000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = tokens.digests(docs, PATH, PATTERN, chunk=2000, overlap=100).collect()
    want = []
    for doc_id, text, _ in rows:
        ids = np.array(reference.encode_ordinary(text or ""), "<u4")
        want.append((doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert Counter(map(tuple, got)) == Counter(want)
    back = tokens.decode(tokens.encode(docs, PATH, PATTERN, chunk=2000, overlap=100), PATH, PATTERN)
    assert Counter((r["doc_id"], bytes(r["bytes"])) for r in back.collect()) == Counter((d, (t or "").encode()) for d, t, _ in rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.digests(docs, PATH, PATTERN).count() == 0
    assert tokens.length_histogram(tokens.lengths(docs, PATH, PATTERN)).count() == 0


def test_histogram_answers(spark, reference):
    rng = random.Random(1)
    texts = ["w " * rng.randint(0, 60) for _ in range(200)] + [None, "", "z " * 9000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes = sorted(len(reference.encode_ordinary(t or "")) for t in texts)
    histogram = tokens.length_histogram(tokens.lengths(docs, PATH, PATTERN)).cache()
    rows = {r["n_tokens"]: r for r in histogram.collect()}
    assert sorted(rows) == sorted(set(sizes))
    for n, r in rows.items():
        assert r["n_docs"] == sizes.count(n)
        assert r["docs_at_least"] == sum(s >= n for s in sizes) and r["tokens_at_least"] == sum(s for s in sizes if s >= n)
        assert r["docs_below"] == sum(s < n for s in sizes) and r["tokens_below"] == sum(s for s in sizes if s < n)
        assert r["truncated_tokens"] == sum(min(s, n) for s in sizes)
    got = {(r["what"], r["at"]): r["value"] for r in tokens.answers(histogram, [16, 64], [0.5, 1.0]).collect()}
    assert got[("total_tokens", 0.0)] == sum(sizes)
    assert got[("docs_above", 16.0)] == sum(s > 16 for s in sizes) and got[("tokens_kept", 64.0)] == sum(min(s, 64) for s in sizes)
    assert got[("quantile", 0.5)] == sizes[-(-len(sizes) // 2) - 1] and got[("quantile", 1.0)] == sizes[-1]


def test_texts_go_through_the_encoder_a_few_at_a_time(spark, monkeypatch):
    # what is made of 10,000 texts and sent back in one batch is several times their size
    taken = []

    class Counting(tokens.ByteBPE):
        def __init__(self):
            pass

        def encode_span(self, text):
            taken[-1] += 1
            return np.zeros(1, "<u4")

        def decode(self, ids):
            return b""

    functions = {}
    real = type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda df, f, schema: functions.setdefault(f.__name__, f) and real(df, f, schema))
    monkeypatch.setattr(tokens, "load", lambda path, pattern: Counting())
    tokens.digests(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), "", "", with_ids=True)
    taken.append(0)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(10_000)), "text": ["a b"] * 10_000})
    sizes = []
    for out in functions["short"](iter([batch])):
        sizes.append(out.num_rows)
        taken.append(0)
    assert sum(sizes) == 10_000 and max(sizes) <= 512 and max(taken) <= 512
