import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash


def naive(text, width=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


TEXTS = ["", None, " \t\x0b", "a", "A b", "É É\t\n x\x0by", "x" * 100, "word " * 600, "one two three four", "ONE two three four"] + [" ".join(f"w{(i * k) % 37}é" * (1 + k % 9) for k in range(60)) for i in range(30)]


def test_fingerprints(monkeypatch):
    want = [naive(t) for t in TEXTS]
    assert simhash.fingerprints(TEXTS).tolist() == want
    monkeypatch.setattr(simhash, "SLAB", 50)  # long texts in many parts
    assert simhash.fingerprints(TEXTS).tolist() == want
    assert simhash.fingerprints(TEXTS, 5).tolist() == [naive(t, 5) for t in TEXTS]


def test_forest_joins_what_links_join():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flip = lambda x, n: x ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, n, replace=False).astype(np.uint64))
    hub = [flip(base[0], 2) for _ in range(700)]
    fps = np.unique(np.array([*base, *hub, *(flip(x, 1) for x in base[:50]), *(flip(x, 2) for x in base[50:90]), *(flip(x, 3) for x in base[90:150])], np.uint64))
    node, root = simhash.link_forest(fps, 2)
    assert simhash.reduce_links(root, node, len(fps)).tolist() == components([int(x) for x in fps], 2)


def test_masks_meet_all_links_with_bounded_copies():
    rng = np.random.default_rng(1)
    for radius in (1, 2, 3):
        for n in (10, 10**9, 10**14):
            masks = simhash.cell_masks(n, radius)
            assert len(masks) <= 20
            for _ in range(200):
                diff = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
                assert any(diff & m == 0 for m in masks)


def test_hot_cells_in_blocks(spark):
    rng = np.random.default_rng(5)
    base = int(rng.integers(1, 1 << 62))
    near = {base}
    for _ in range(300):
        near.add(base ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 4)), replace=False)))
    fps = sorted(near | {int(x) for x in rng.integers(0, 1 << 62, 100)})
    docs = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    got = {r["fp"] % (1 << 64): r["root"] % (1 << 64) for r in simhash.near_components(docs, 2, hot=20, block=16).collect()}
    want = components(fps, 2)
    for i in range(len(fps)):
        for j in range(i):
            assert (got.get(fps[i], i) == got.get(fps[j], j)) == (want[i] == want[j])


@pytest.mark.parametrize("cell_rows", [64, 0])
def test_table(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(simhash, "CELL_ROWS", cell_rows)  # 0: the most blocks
    rng = np.random.default_rng(3)
    words = [f"t{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, 80)) for _ in range(60)]
    texts += [t + " tail" for t in texts[:20]] + texts[:10] + [None, "", "a b c"]
    rows = [(int(i), t, 0) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)] + [(None, texts[0], 0), (None, "only here without an id", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = simhash.near_duplicates(docs).collect()
    fps = [naive(t) for _, t, _ in rows]
    groups = defaultdict(list)
    for r, (doc_id, _, _) in zip(components(fps, 2), rows, strict=True):
        groups[r].append(doc_id)
    lowest = {r: min((d for d in ids if d is not None), default=None) for r, ids in groups.items()}
    want = sorted((str(d), f"{f:016x}", str(lowest[r])) for (d, _, _), f, r in zip(rows, fps, components(fps, 2), strict=True))
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == want
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d in lowest.values()}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
