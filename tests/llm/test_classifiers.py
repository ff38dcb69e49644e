import zlib

import numpy as np
import pytest

from tessera.llm import langid, toxicity

WORDS = {"en": "the of and with for that is on this by".split(), "de": "der die und mit für daß ist auf über".split(), "fr": "le la et avec où été dans ça très".split()}


def corpus(n=400, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        lang = ("en", "de", "fr")[i % 3]
        rows.append((i, " ".join(rng.choice(WORDS[lang], int(rng.integers(5, 200)))), lang, "s"))
    return rows


@pytest.fixture(scope="module")
def languages(spark):
    extra = [(1000, None, "en", "s"), (1001, "", "en", "s"), (1002, "123 !?", "en", "s"), (1003, "der und " * 40000, None, "s"), (None, "the of and", "en", "s")]
    docs = spark.createDataFrame(corpus() + extra, "doc_id long, text string, lang string, score string")
    return docs, langid.identify(docs).collect()


def test_languages(languages):
    docs, got = languages
    assert len(got) == docs.count()
    truth = {i: lang for i, _, lang, _ in corpus()}
    held = [r for r in got if r["doc_id"] in truth and r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) >= 0.97
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert by[1003]["lang_pred"] == "de" and all(0 <= r["score"] <= 1 for r in got)


def test_pair_tables_give_the_convolution():
    rng = np.random.default_rng(2)
    net = langid.ByteCNN(["a", "b"], [rng.normal(size=(w, 256, langid.FILTERS)).astype(np.float32) for w in langid.WIDTHS], rng.normal(size=48).astype(np.float32), rng.normal(size=(48, 2)), np.zeros(2))
    x = rng.integers(0, 256, (3, langid.WINDOW)).astype(np.uint8)
    want = []
    for w, c in zip(langid.WIDTHS, net.conv, strict=True):
        want.append(np.max([sum(c[j][x[:, p + j]] for j in range(w)) for p in range(langid.WINDOW - w + 1)], axis=0))
    assert np.allclose(net.pooled(x), np.maximum(np.concatenate(want, axis=1) + net.bias, 0), atol=1e-4)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in langid.identify(docs).collect()] == [("und", 0.0)]
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [tuple(r)[2:] for r in toxicity.classify(docs, labels).collect()] == [(0.0, 0)]
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.identify(none).count() == 0 and toxicity.classify(none, labels).count() == 0


def test_isotonic():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 12, 200).astype(float)
    y = (rng.random(200) < x / 12).astype(float)
    px, pv = toxicity.isotonic(x, y)
    assert (np.diff(px) >= 0).all() and (np.diff(pv) >= -1e-12).all()
    assert abs(np.interp(x, px, pv).sum() - y.sum()) < 1e-6


def test_toxicity(spark):
    rng = np.random.default_rng(1)
    clean = [f"word{i}" for i in range(80)]
    bad = ["idiotic", "scummy", "worthlessly", "moronish"]
    rows, labels = [], []
    for i in range(600):
        words = list(rng.choice(clean, int(rng.integers(20, 120))))
        toxic = int(i % 5 == 0)
        for _ in range(4 * toxic):
            words.insert(int(rng.integers(len(words))), str(rng.choice(bad)))
        rows.append((i, " ".join(words), "en", 3))
        labels.append((i, 1, toxic))
    rows += [(9000, None, "en", 3), (9001, "", "en", 3), (9002, "clean words " * 50000, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    known = spark.createDataFrame(labels + [(3, 1, None), (None, 0, 1), (0, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(docs, known).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i in range(600) if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == int(i % 5 == 0) for i in held]) >= 0.97
    assert got[9002]["predicted"] == 0
