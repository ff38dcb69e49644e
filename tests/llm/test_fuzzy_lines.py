import hashlib
import random

import pyarrow as pa
import pytest

from tessera.llm import fuzzy_lines as fl
from tessera.llm import minhash
from tessera.llm.common import connected_components


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_edit_distance():
    rng = random.Random(0)
    for _ in range(400):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 20)))
        b = "".join(rng.choice("abé") for _ in range(rng.randint(0, 20)))
        if rng.random() < 0.5:
            b = a[: len(a) // 2] + b[:3] + a[len(a) // 2 :]
        d = distance(a, b)
        for most in (0, 2, 5, 40):
            assert fl.edit_distance(a, b, most) == min(d, most + 1)


def similar(a, b):
    answer = fl.quickly(a, b)
    assert answer is None or answer == fl.exactly(a, b)
    return fl.exactly(a, b) if answer is None else answer


def test_codes_of_parts_are_those_of_the_whole(monkeypatch):
    lines = [b"abcdefgh " * 40, b"abc", b"x", b"some other line"]
    whole = fl.line_codes(lines)
    monkeypatch.setattr(fl, "SLAB", 50)
    assert fl.line_codes(lines).tolist() == whole.tolist()


def test_normalised():
    text = "  Größe\t12  \u00a0 m\n\nA  B9\r\n\u0660 x"
    assert [x.decode() for x in fl.normalised_lines(text)] == [fl.normalised(x) for x in text.split("\n")] == ["größe 00 m", "", "a b0", "\u0660 x"]


def similar_pairs(names):
    """Pairs of an edit similarity of 0.8 or more, by comparing all."""
    for i, a in enumerate(names):
        for b in names[:i]:
            most = int(max(len(a), len(b)) * 0.2 + 1e-9)
            if abs(len(a) - len(b)) <= most and distance(a, b) <= most:
                yield a, b


def test_similar():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(30)]
    for _ in range(500):
        x = [rng.choice(words) for _ in range(rng.randint(1, 12))]
        y = list(x)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(y) + 1)
            y[k : k + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 1)
        a, b = " ".join(x), " ".join(y)
        d = distance(a, b)
        assert similar(a, b) == (d <= int(max(len(a), len(b)) * 0.2 + 1e-9))
        assert fl.rewriting_cost(x, y, 10**9) >= d >= max(len(a), len(b)) - fl.common_subsequence(a, b)


def test_pairs_side_by_side(monkeypatch):
    """Many pairs at once get the answers of a plain edit distance, about the limit too, whatever their lengths and characters."""
    rng = random.Random(6)
    pairs = [("", "abc"), ("a" * 70, "a" * 64), ("x\U0010ffff\0", "\0\U0010ffffx")]
    for letters in ("ab", "abcdefghij klmn", "".join(map(chr, range(0x4E00, 0x4E00 + 400)))):
        for _ in range(150):
            a = [rng.choice(letters) for _ in range(rng.randint(1, 200))]
            b = list(a)
            for _ in range(round(len(a) * rng.uniform(0.1, 0.4))):
                k = rng.randrange(len(b) + 1)
                b[k : k + rng.randint(0, 1)] = [rng.choice(letters)] * rng.randint(0, 2)
            pairs.append(("".join(a), "".join(b)))
    want = [distance(a, b) <= fl.edits_allowed(a, b) for a, b in pairs]
    assert 150 < sum(want) < 350
    for few, mask_bytes in ((1, 16 << 20), (12, 16 << 20), (1, 1 << 18)):
        monkeypatch.setattr(fl, "FEW", few)
        monkeypatch.setattr(fl, "MASK_BYTES", mask_bytes)
        assert fl.exactly_all(pairs) == want
    for size in (63, 64, 65, 128, 129, 400):  # at the limit and one beyond it, at the ends of words
        a = "".join(rng.choice("abcdefgh") for _ in range(size))
        most = fl.edits_allowed(a, a)
        longer = [a] * 3
        assert fl.within(longer, [a[: size - most], "#" * most + a[most:], "#" * (most + 1) + a[most + 1 :]], [most] * 3).tolist() == [True, True, False]


def test_words_of_their_own_leave_a_pair_open_at_once(monkeypatch):
    """No way of rewriting is sought where words that the other line doesn't have cost too much already; answers stay those of a plain distance."""
    sought = []
    monkeypatch.setattr(fl, "rewriting_cost", lambda x, y, most, f=fl.rewriting_cost: sought.append((x, y)) or f(x, y, most))
    start, end = "the same words at the start of both", "and at their end"
    one, two = (" ".join(f"{x}{i}" for i in range(10)) for x in ("alpha", "beta"))
    assert fl.quickly(f"{start} {one} {end}", f"{start} {two} {end}") is None
    assert not sought
    assert fl.quickly(f"a {start} one b", f"b {start} one a") and len(sought) == 1


def test_one_line_of_many_is_fetched():
    text = "Ä 1\n\n  b\t 23 \u00a0c\nlast"
    wanted = pa.array([[{"id": 7, "line": 2}, {"id": 8, "line": 0}], [{"id": 9, "line": 3}]], pa.list_(pa.struct([("id", pa.int64()), ("line", pa.int32())])))
    batch = pa.RecordBatch.from_arrays([pa.array([text, text]), wanted], names=["text", "wanted"])
    for some in (batch, pa.RecordBatch.from_arrays([pa.array(["", text, text]), pa.concat_arrays([wanted.slice(0, 0), pa.array([None], wanted.type), wanted])], names=["text", "wanted"]).slice(1)):
        assert [(r["id"], r["text"]) for b in fl._fetch(iter([some])) for r in b.to_pylist()] == [(7, "b 00 c"), (8, "ä 0"), (9, "last")]


def test_open_pairs_of_several_tables_are_answered_together(monkeypatch):
    """Groups come in several Arrow batches; what is left open is asked once, and links the rows of its own group."""
    rng = random.Random(9)
    texts, asked = [], []
    for _ in range(40):
        a = [rng.choice("abcdefgh") for _ in range(60)]
        b = [c if i % 6 else "#" for i, c in enumerate(a)]
        texts += ["".join(a), "".join(b) if rng.random() < 0.5 else "".join(reversed(a))]
    code = fl.line_codes([x.encode() for x in texts]).view("<i8")
    n = len(texts)
    columns = {"g": [i // 2 for i in range(n)], "band": [minhash.ANY] * n, "bi": [0] * n, "bj": [0] * n, "own": [0] * n, "id": [100 + i for i in range(n)], **{c: code[:, k] for k, c in enumerate(minhash.CODES)}, "text": texts}
    table = pa.table({k: pa.array(v) for k, v in columns.items()})

    def together(pairs):
        asked.append(len(pairs))
        return fl.exactly_all(pairs)

    run = minhash._forests("text", fl.BANDS, fl.LOOSE, str, lambda a, b: None, fl.exactly, together)
    want = {(100 + i, 101 + i) for i in range(0, n, 2) if distance(texts[i], texts[i + 1]) <= 12}
    for most in (minhash.TOGETHER, 7):
        monkeypatch.setattr(minhash, "TOGETHER", most)
        got = [(r["a"], r["b"]) for b in run(iter(table.to_batches(10))) for r in b.to_pylist()]
        assert len(got) == len(want) and set(got) == want and 5 < len(want) < 35
    assert asked == [40, *[7] * 5, 5]


def brute(rows):
    """Kept texts of (doc_id, text) rows by comparing all pairs of classes."""
    first, classes = {}, {}
    key = lambda d: (d is None, d)
    for d, text in sorted(rows, key=lambda r: key(r[0])):
        for i, line in enumerate((text or "").split("\n")):
            n = fl.normalised(line)
            if n:
                classes.setdefault(n, []).append((d, i))
                first.setdefault(n, (d, i))
    names = list(classes)
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in similar_pairs(names):
        root[find(a)] = find(b)
    kept = {}
    for n in names:
        r = find(n)
        kept[r] = min(kept.get(r, first[n]), first[n], key=lambda p: (key(p[0]), p[1]))
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        rest = [x for i, x in enumerate(lines) if not fl.normalised(x) or kept[find(fl.normalised(x))] == (d, i)]
        out.append((d, len(lines), "\n".join(rest)))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(200)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(14, 60))) for _ in range(60)]
    near = []
    for line in base[:40]:
        parts = line.split()
        parts[rng.randrange(len(parts))] = rng.choice(words)
        near.append(" ".join(parts))
    pool = [*base, *near, "Page 1 of 9", "page 2 of 9", "  PAGE   3 of 7", "}", "", "   "]
    out = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 8)))) for i in range(50)]
    return [*out, (50, None), (51, ""), (None, base[0] + "\n" + base[41]), (None, "no id\n\nno id")]


def test_table(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, line string, gone int").repartition(4)
    want = brute(rows)
    got = fl.report(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_lines"], r["kept_sha256"]) for r in got) == sorted((str(d), n, hashlib.sha256(t.encode()).hexdigest()) for d, n, t in want)
    assert sum(r["n_removed"] for r in got) > 40 and all(len(r["repeats"]) == r["n_removed"] for r in got)
    cut = fl.deduplicated(docs)
    assert cut.schema == docs.schema
    texts = {d: t for (d, t), _ in zip(rows, want, strict=True)}
    assert sorted(map(str, ((r["doc_id"], r["text"], r["line"], r["gone"]) for r in cut.collect()))) == sorted(str((d, None if texts[d] is None and d is not None else t, "x", 1)) for d, _, t in want)


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a line that repeats\nb"), (1, "a line that repeats\nb"), (2, "a line that repeats")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in fl.deduplicated(docs).collect()) == [(1, "a line that repeats\nb"), (1, "a line that repeats\nb"), (2, "")]
    assert fl.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("others", [0, 20000])
def test_lines_of_edit_similarity_0_8_meet(spark, others):
    """The same share of the similar pairs is found in a small table and among many other lines."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(3, 8)))
    rows, similar = [], 0
    for i in range(600):
        words = [word() for _ in range((8, 15, 40)[i % 3])]
        near = list(words)
        for k in rng.sample(range(len(words)), (1, 2, 5)[i % 3]):
            near[k] = word()
        a, b = " ".join(words), " ".join(near)
        similar += distance(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9)
        rows += [(2 * i, a), (2 * i + 1, b)]
    rows += [(10000 + i, " ".join(word() for _ in range(rng.randint(6, 30)))) for i in range(others)]
    gone = {r["doc_id"]: r["repeats"][0]["group_doc"] for r in fl.report(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0").collect()}
    assert similar > 500 and all(d == g + 1 and d % 2 for d, g in gone.items())
    assert 0.97 * similar <= len(gone) <= similar


def test_large_buckets_and_groups_in_blocks(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    start = " ".join(word() for _ in range(30))
    lines = [f"{start} {word()} {word()}" for _ in range(60)] + [" ".join(word() for _ in range(20)) for _ in range(40)]
    code = fl.line_codes([x.encode() for x in lines]).view("<i8")
    sets = spark.createDataFrame([(i, x, *map(int, c)) for i, (x, c) in enumerate(zip(lines, code, strict=True))], "id long, text string, " + ", ".join(f"{c} long" for c in minhash.CODES))

    def labels(**sizes):
        grouped = minhash.candidates(sets, fl.BANDS, fl.LOOSE, **sizes)
        block = {k: v for k, v in sizes.items() if k == "block"}
        edges = minhash.links(grouped, sets, "text", fl.BANDS, fl.LOOSE, str, fl.quickly, fl.exactly, **block)
        return sorted(map(tuple, connected_components(edges).collect()))

    assert labels() == labels(hot=10, block=7) == [(i, 0) for i in range(60)]
