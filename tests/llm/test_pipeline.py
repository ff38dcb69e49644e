import hashlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from tessera.llm import near_docs


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(0)
    words = {"en": "the of and with for that is on this by house river".split(), "de": "der die und mit für daß ist auf über haus fluss dorf".split()}
    rows = []
    for i in range(90):
        lang = ("en", "de")[i % 2]
        rows.append((i, "\n".join(" ".join(rng.choice(words[lang], 12)) for _ in range(4)), lang, f"s{i % 4}", 0, "x"))
    rows += [(200 + i, rows[i][1], rows[i][2], "s0", 0, "y") for i in range(20)]
    rows += [(300, "12345 !!", "en", "s0", 0, "z"), (301, None, "en", "s0", 0, "z"), (302, "", None, None, 0, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __row string")


def test_stages(spark, docs, tmp_path):
    path = str(tmp_path / "documents.parquet")
    docs.write.parquet(path)
    current = spark.read.parquet(path)
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        before = current
        current = stage(spark, before, str(tmp_path)).cache()
        counts[name] = current.count()
        if name != "byte_bpe":
            assert current.columns == before.columns and [f.dataType for f in current.schema] == [f.dataType for f in before.schema]
        if name == "language_id":
            assert {r[0] for r in before.select("doc_id").collect()} - {r[0] for r in current.select("doc_id").collect()} == {300, 301, 302}
        if name == "line_dedup":
            assert all(r["text"] == "" and r["n_chars"] == 0 for r in current.where("doc_id between 200 and 219").collect())
        if name == "near_dedup":
            kept = {r[0] for r in current.select("doc_id").collect()}
            sets = {r["doc_id"]: near_docs.shingles(near_docs.words_of(r["text"]), 5) for r in before.select("doc_id", "text").collect()}
            for d, x in sets.items():
                assert (d in kept) == (not any(e < d and len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)) for e, y in sets.items()))
        if name == "mix":
            assert max(Counter(r[0] for r in current.select("doc_id").collect()).values()) <= 3
            mixed = current
    final = current.collect()
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in final) == Counter((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in mixed.collect())
    assert all(len(bytes(r["ids"])) == 4 * r["n_tokens"] and hashlib.sha256(bytes(r["ids"])).hexdigest() == r["ids_sha256"] for r in final)
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(map(str, again)) == Counter(map(str, final))


def test_empty(spark, docs):
    current = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        current = stage(spark, current, "")
    assert current.count() == 0
