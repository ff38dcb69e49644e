import hashlib
import random
import re

import pytest

from tessera.llm import phrase_index


def split(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def windows(items):
    out = set()
    for i, text in items:
        words = split(text)
        out |= {("" if i is None else str(i), tuple(words[a : a + 10])) for a in range(max(1, len(words) - 9)) if words}
    return out


def brute(docs, items):
    asked: dict = {}
    for i, w in windows(items):
        asked.setdefault(w, set()).add(i)
    out = []
    for d, text in docs:
        words, hit, found = split(text), set(), set()
        for n in {len(w) for w in asked}:
            for a in range(len(words) - n + 1):
                if ids := asked.get(tuple(words[a : a + n])):
                    hit |= set(range(a, a + n))
                    found |= ids
        out.append((d, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé9") for _ in range(rng.randint(1, 2)))
    items = [(i, " ".join(word() for _ in range(rng.choice((0, 1, 3, 9, 10, 11, 25))))) for i in range(30)]
    items += [(None, None), (3, "one more text of the third item with enough words in it"), (40, items[5][1]), (41, "a a a a a a a a a a a a"), (42, "."), (2, items[2][1]), (10, "x")]
    docs = []
    for d in range(120):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30)))]
        for _ in range(rng.randint(0, 3)):
            words = split(rng.choice(items)[1]) or ["none"]
            a = rng.randrange(len(words))
            parts.append(rng.choice((", ", "-", "\x00 ")).join(words[a:]).upper() if rng.random() < 0.5 else " ".join(words))
        rng.shuffle(parts)
        docs.append((d, " ".join(parts)))
    return docs + [(None, items[6][1]), (5, docs[5][1]), (5, docs[5][1]), (200, None), (201, ""), (202, "a " * 5000), (203, "É é x ﬁ")], items


@pytest.mark.parametrize("seed, changed", [(0, {}), (1, {"SEGMENT": 300, "BLOCK_WORDS": 60, "PIECE": 4})])
def test_against_brute_force(spark, monkeypatch, seed, changed):
    docs, items = corpus(seed)
    for name, value in changed.items():  # small segments, pieces and blocks: all their edges
        monkeypatch.setattr(phrase_index, name, value)
    table = spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, segment string").repartition(3)
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, first int").repartition(2)
    got = phrase_index.digest(table, asked)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == brute(docs, items)


def test_matches_and_proximity(spark):
    phrase = [f"w{i}" for i in range(10)]
    swapped = [*phrase[:4], phrase[5], phrase[4], *phrase[6:]]
    docs = [(1, "x y " + " ".join(phrase) + " z"), (2, "x " + " ".join(swapped)), (3, " ".join(phrase[:5]) + " gap " + " ".join(phrase[5:])), (4, " ".join(phrase[:9])), (5, " ".join(phrase[5:] + phrase[:5]))]
    index = phrase_index.build(spark.createDataFrame(docs, "doc_id long, text string"))
    items = spark.createDataFrame([(7, " ".join(phrase))], "item_id long, text string")
    found = lambda slack: sorted((r["doc_id"], r["item"], r["kind"], r["n_windows"], [tuple(s) for s in r["spans"]]) for r in phrase_index.matches(index, items, slack).collect())
    assert found(0) == [(1, "7", "phrase", 1, [(2, 12)])]
    near = found(1)
    assert near[0] == (1, "7", "phrase", 1, [(2, 12)]) and {r[0] for r in near} == {1, 2, 3} and {r[2] for r in near[1:]} == {"proximity"}
    with pytest.raises(ValueError, match="slack"):
        phrase_index.matches(index, items, 60)


def test_empty_tables(spark):
    none, docs = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = phrase_index.digest(docs, none).first()
    assert (row["n_words"], row["n_hit"], row["n_items"], row["contaminated"], row["items_sha256"]) == (2, 0, 0, False, hashlib.sha256(b"").hexdigest())
    assert phrase_index.digest(docs.limit(0), none).count() == 0 and phrase_index.digest(docs.limit(0), spark.createDataFrame([(1, "a")], none.schema)).count() == 0
