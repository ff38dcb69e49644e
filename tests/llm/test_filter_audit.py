import random
import re
from collections import Counter
from itertools import permutations

import pytest

from tessera.llm import filter_audit


def failures(docs):
    """The failed filters of each (doc_id, text, lang)."""
    order = lambda d: float("inf") if d is None else d
    first: dict = {}
    for d, text, _ in docs:
        first[text or ""] = min(first.get(text or "", float("inf")), order(d))
    out = []
    for d, text, _ in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        checks = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), order(d) > first[t])
        out.append({f for f, failed in zip("ABCDE", checks, strict=True) if failed})
    return out


def brute(docs, labels):
    quality, toxic = ({d for d, *marks in labels if marks[k] == 1 and d is not None} for k in (0, 1))
    fails = failures(docs)
    parts = {lang or "" for _, _, lang in docs}
    rows, shapley = [], Counter()
    for part in parts:
        mine = [(d, f) for (d, _, lang), f in zip(docs, fails, strict=True) if (lang or "") == part]
        for order in permutations("ABCDE"):
            for step, name in enumerate(order, 1):
                earlier = set(order[: step - 1])
                gone = [d for d, f in mine if name in f and not f & earlier]
                shapley[part, name] += len(gone)
                kept = sum(not f & set(order[:step]) for _, f in mine)
                again = sum(name in f and bool(f & earlier) for _, f in mine)
                alone = sum(f == {name} for _, f in mine)
                rows.append([part, "".join(order), step, name, kept, len(gone), again, alone, sum(d in quality for d in gone), sum(d in toxic for d in gone)])
    return sorted((*r, shapley[r[0], r[3]]) for r in rows)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 5)))
    texts = [None, "", " \t\n ", "é", "A" * 30, "#", "word\x0bword\x0c", "x " * 150, " ".join("ab" for _ in range(120))]
    for _ in range(60):
        t = " ".join(word() for _ in range(rng.choice((5, 99, 100, 130))))
        texts.append(rng.choice((t, t.upper(), t + " $", t)))
    texts += rng.choices(texts, k=40)
    docs = [(i, t, rng.choice((None, "", "en", "de"))) for i, t in enumerate(texts)]
    docs += [(None, texts[20], "en"), (None, texts[20], "en"), (5, texts[5], "en"), (30, texts[31], "de"), (200, "long " * 50000, "fr")]
    labels = [(d, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for d in range(90)] + [(7, 1, 1), (7, 0, 0), (None, 1, 1), (10**6, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    docs, labels = corpus(seed)
    table = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, lang string, part string, n long").repartition(3)
    got = filter_audit.audit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    columns = ("part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == brute(docs, labels)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    one = filter_audit.audit(spark.createDataFrame([(1, None, None)], docs.schema), labels).collect()
    assert len(one) == 600 and {(r["part"], r["removed"]) for r in one if r["filter"] == "A"} == {("", 1)} and all(r["kept"] == 0 for r in one if r["step"] == 5)


def test_flags_and_survivors_are_reusable(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, "a b", "en"), (3, "a #", "de")], "doc_id long, text string, lang string")
    counted = filter_audit.profiles(filter_audit.flags(docs, spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")))
    passed = {(r["part"], r["subset"]): (r["n"], r["good"], r["toxic"]) for r in filter_audit.survivors(counted).collect()}
    assert len(passed) == 64 and passed["en", 0] == (2, 0, 0) and passed["en", 16] == (1, 0, 0) and passed["de", 8] == (0, 0, 0) and passed["de", 0] == (1, 1, 0)
