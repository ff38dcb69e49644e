import random
import re
import zlib
from collections import Counter

import pytest

from tessera.llm import spelling


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def near(a, b):
    """One inserted, deleted or replaced code point."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return any(a[k + i :] == b[k + j :] for i, j in ((1, 1), (1, 0), (0, 1)))


def words_of(docs):
    n = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def brute(docs):
    n = words_of(docs)
    form, close = {}, {w: [v for v in n if near(w, v)] for w in n}
    for w in n:
        best = min(close[w], key=lambda v: (-n[v], v.encode()), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(close[w]), n.get(form[w])))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    syllables = ["ab", "be", "ça", "do", "é", "fu", "gh", "ÀÉ", "ll", "a", "ÿo"]
    base = ["".join(rng.choice(syllables) for _ in range(rng.randint(3, 9))) for _ in range(80)] + ["aaaaaaaa", "abababab", "bababababa", "z" * 300]

    def varied(w):
        k, c = rng.randrange(len(w)), rng.choice("abéz")
        return rng.choice((w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], w.upper() if w.isascii() else w, w))

    docs = [(i, " ".join(varied(rng.choice(base)) for _ in range(40)) + rng.choice((".", "1x", "-"))) for i in range(120)]
    hub = "commonword"
    docs.append((500, " ".join([hub] * 1200 + [x for c in "abcde" for x in [hub + c] * 20 + [hub + c + c] * 2])))
    return docs + [(None, docs[3][1]), (None, docs[3][1]), (4, docs[4][1]), (900, None), (901, ""), (902, "short words only 12345"), (903, "Tail" * 20000)]


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    docs = corpus(seed)
    table = spark.createDataFrame([(*d, "w", 1) for d in docs], "doc_id long, text string, word string, n int").repartition(4)
    got = sorted((tuple(r) for r in spelling.variants(table).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)
    want = brute(docs)
    assert got == want and any(root != w and root != form for w, form, root, *_ in want)


def test_keys_meet_for_every_edit():
    """Two words within one edit share a key, whatever the bigrams' order."""
    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(7, 12)))
        k, c, kind = rng.randrange(len(a)), rng.choice("abcd"), rng.randrange(3)
        b = (a[:k] + c + a[k + 1 :], a[:k] + c + a[k:], a[:k] + a[k + 1 :])[kind]
        if a == b or min(len(a), len(b)) < 7:
            continue
        grams = sorted({w[i : i + 2] for w in (a, b) for i in range(len(w) - 1)})
        rng.shuffle(grams)
        rank = {g: i for i, g in enumerate(grams)}
        x, y = spelling.keys(a, rank), spelling.keys(b, rank)
        assert any(not (x[key] and y[key]) for key in x.keys() & y.keys()), (a, b)


def test_long_chains_and_empty_table(spark):
    formed = spark.createDataFrame([(f"w{i}", f"w{i + 1}" if i < 9 else None, 2 * 10**i) for i in range(10)], "word string, form string, n long")
    assert {r["root"] for r in spelling.roots(formed).collect()} == {"w9"}
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
