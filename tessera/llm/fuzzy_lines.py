"""Fuzzy line dedup: MinHash of normalised lines, edit similarity, components.

A line is what ``\\n`` separates. It is normalised (lower case, digits 0-9 to 0, white space runs to one space, trimmed);
equal normalised lines are one class; blank lines are none. Two classes link if their edit similarity
(1 - Levenshtein / longer length, in characters) is 0.8 or more. Of each connected group the first
occurrence (smallest doc_id, then line) stays.

Pairs to verify come from 64 MinHashes over all 6-byte grams of the normalised line: those that agree on one of
``BANDS`` and differ in no more than ``LOOSE`` of 64 codes. Bands don't depend on the number of lines, so which pairs meet
is the same in every table. A similar pair that shares few grams can be missed (README has the recall).

Only codes travel with the keys. The texts of the few lines with a candidate are fetched for the verification,
which skips pairs already connected; a bucket gives a spanning forest, never its pairs. A class is known by two hashes of
64 bits each.

Defined cases: a null or empty text has no lines and stays as it is; a null doc_id counts as larger than all others;
repeated rows are treated alike; further columns pass through ``deduplicated``. A pair of very long lines costs the product of
their lengths / 60 where neither their lengths nor their words decide it.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, connected_components, drop, free, materialize, pieces
from .minhash import CODES, N, NONE, candidates, code_columns, codes, links, minima

GRAM, SIMILARITY = 6, 0.8
#: Codes of 64 that a candidate's may differ in, by two bits each: unlike lines differ in 48 by chance.
LOOSE = 35
#: Each band takes four of the codes.
BANDS = [tuple(b) for b in np.array([np.random.default_rng(i).permutation(N).reshape(-1, 4) for i in (1, 2)]).reshape(-1, 4).tolist()]
#: Bytes of normalised lines hashed at once.
SLAB = 1 << 16
#: Pairs whose distances are computed side by side, bytes of their masks; fewer pairs go one by one.
SIDE_BY_SIDE, MASK_BYTES, FEW = 512, 16 << 20, 12
_DIGIT_BYTES = bytes.maketrans(b"123456789", b"000000000")


def normalised(line: str) -> str:
    # bytes are translated faster than characters
    return " ".join(line.lower().split()).encode("utf-8", "surrogatepass").translate(_DIGIT_BYTES).decode("utf-8", "surrogatepass")


def normalised_lines(text: str) -> list[bytes]:
    """Every line of ``text``, normalised, in UTF-8."""
    return "\n".join([" ".join(line.split()) for line in text.lower().split("\n")]).encode("utf-8").translate(_DIGIT_BYTES).split(b"\n")


def _gram_hashes(data: bytes) -> np.ndarray:
    """A hash of the GRAM bytes from each offset on (short by GRAM - 1 at the end)."""
    n = len(data) - GRAM + 1
    words = np.ndarray((n,), "<u8", buffer=data + bytes(8 - GRAM), strides=(1,)) & np.uint64((1 << 8 * GRAM) - 1)
    words += np.uint64(1)
    words *= np.uint64(0x9E3779B97F4A7C15)
    words ^= words >> np.uint64(32)
    words *= np.uint64(0xD6E8FEB86659FD93)
    words ^= words >> np.uint64(32)
    return words


def line_codes(lines: list[bytes]) -> np.ndarray:
    """MinHash codes of non-empty byte strings over their GRAM-byte grams (a shorter one is a gram itself)."""
    least = np.full((len(lines), N), NONE, np.uint32)
    some: list[int] = []
    held = 0

    def flush() -> None:
        if not some:
            return
        # every line is followed by as many zeros as keep its grams apart from the next line's
        data = b"".join(lines[i] + b"\0" * max(GRAM - 1, GRAM - len(lines[i])) for i in some)
        size = np.array([len(lines[i]) for i in some])
        width, grams = np.maximum(size + GRAM - 1, GRAM), np.maximum(size - GRAM + 1, 1)
        start = np.cumsum(width) - width
        h = (_gram_hashes(data + b"\0" * GRAM)[: len(data)] >> np.uint64(32)).astype(np.uint32)
        # grams that reach beyond a line are replaced by its last one, which changes no minimum
        beyond = width - grams
        within_run = np.arange(beyond.sum()) - np.repeat(np.cumsum(beyond) - beyond, beyond)
        h[np.repeat(start + grams, beyond) + within_run] = np.repeat(h[start + grams - 1], beyond)
        least[some] = minima(h, start)

    for i, line in enumerate(lines):
        if len(line) > SLAB:  # a very long line goes alone, in parts that overlap by a gram's rest
            for a in range(0, len(line) - GRAM + 1, SLAB):
                h = (_gram_hashes(line[a : a + SLAB + GRAM - 1]) >> np.uint64(32)).astype(np.uint32)
                least[i] = np.minimum(least[i], minima(h, np.zeros(1, np.int64))[0])
            continue
        some.append(i)
        held += len(line)
        if held >= SLAB:
            flush()
            some, held = [], 0
    flush()
    return codes(least)


def common_start(a: str, b: str) -> int:
    """Length of the longest common prefix, by bisection."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or most + 1 if it is larger (bit-parallel, one big integer a column)."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    p = common_start(a, b)
    a, b = a[p:], b[p:]
    p = common_start(a[::-1], b[::-1])
    if p:
        a, b = a[:-p], b[:-p]
    if not a or not b:
        return max(len(a), len(b))
    spare = Counter(a)
    spare.subtract(b)
    if max(sum(v for v in spare.values() if v > 0), -sum(v for v in spare.values() if v < 0)) > most:
        return most + 1
    m = len(a)
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    for j, c in enumerate(b):
        eq = masks.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right = down | (full & ~(diagonal | up))
        left = up & diagonal
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        if score - (len(b) - 1 - j) > most:
            return most + 1
        right = (right << 1) | 1
        left <<= 1
        up = (left | ~(diagonal | right)) & full
        down = right & diagonal
    return score


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence (bit-parallel, one big integer a column)."""
    masks: dict[str, int] = {}
    bit = 1
    for c in a:
        masks[c] = masks.get(c, 0) | bit
        bit <<= 1
    full = bit - 1
    state, get = full, masks.get
    for c in b:
        same = state & get(c, 0)
        state = ((state + same) | (state - same)) & full
    return len(a) - state.bit_count()


def rewriting_cost(x: list[str], y: list[str], most: int) -> int:
    """What one way of rewriting words x as y costs: it keeps equal words and, where they differ, goes on at the nearest equal
    ones. An upper bound of the edit distance of the joined words, or more than ``most``."""
    i = j = cost = 0
    n, m = len(x), len(y)
    while i < n and j < m and cost <= most:
        if x[i] == y[j]:
            i += 1
            j += 1
            continue
        di, dj = _next_equal(x, y, i, j)
        cost += max(sum(map(len, x[i : i + di])) + di, sum(map(len, y[j : j + dj])) + dj) - (1 if di and dj else 0)
        i += di
        j += dj
    rest = max(sum(map(len, x[i:])) + n - i, sum(map(len, y[j:])) + m - j)
    return cost + rest


def _next_equal(x: list[str], y: list[str], i: int, j: int) -> tuple[int, int]:
    if set(x[i : i + 9]).isdisjoint(y[j : j + 9]):
        return 1, 1
    for skip in range(1, 9):
        for k in range(max(0, skip - len(y) + j + 1), min(skip, len(x) - i - 1) + 1):
            if x[i + k] == y[j + skip - k]:
                return k, skip - k
    return 1, 1


def edits_allowed(a: str, b: str) -> int:
    return math.floor(max(len(a), len(b)) * (1 - SIMILARITY) + 1e-9)


def between_ends(a: str, b: str) -> tuple[str, str]:
    """Both without their common start and end, which changes no distance."""
    p = common_start(a, b)
    a, b = a[p:], b[p:]
    q = common_start(a[::-1], b[::-1])
    return a[: len(a) - q], b[: len(b) - q]


def quickly(a: str, b: str) -> bool | None:
    """Whether the edit similarity is at least ``SIMILARITY``, where bounds decide it."""
    most = edits_allowed(a, b)
    if abs(len(a) - len(b)) > most:
        return False
    # rewriting all between the common ends, or the words that differ, are ways from a to b: their cost bounds the distance from above
    a, b = between_ends(a, b)
    if max(len(a), len(b)) <= most:
        return True
    x, y = a.split(" "), b.split(" ")
    # words that the other doesn't have are rewritten whole, whatever the way
    own, other = set(x), set(y)
    if sum(map(len, own - other)) > most or sum(map(len, other - own)) > most:
        return None
    return True if rewriting_cost(x, y, most) <= most else None


def exactly(a: str, b: str) -> bool:
    most = edits_allowed(a, b)
    a, b = between_ends(a, b)
    # what a and b have in common bounds the distance from both sides
    common = common_subsequence(a, b)
    if max(len(a), len(b)) - common > most:
        return False
    return len(a) + len(b) - 2 * common <= most or edit_distance(a, b, most) <= most


def _batches(sizes: list[tuple[int, int]], alphabet: int) -> Iterator[list[int]]:
    """Numbers of pairs (longer, shorter length) whose shorter lengths are alike, and whose masks fit ``MASK_BYTES``."""
    batch: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: sizes[i][1], reverse=True):
        if batch:
            most = sizes[batch[0]][1]
            words = max(sizes[batch[0]][0], sizes[i][0]) // 64 + 2
            if len(batch) == SIDE_BY_SIDE or 2 * sizes[i][1] < most or (len(batch) + 1) * words * alphabet * 8 > MASK_BYTES:
                yield batch
                batch = []
        batch.append(i)
    if batch:
        yield batch


def _points(texts: list[str]) -> np.ndarray:
    """The code points of all texts, one after another."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")


def _characters(*texts: list[str]) -> list[str]:
    """The different characters of all texts."""
    there = np.zeros(0x110000, bool)
    for some in texts:
        there[_points(some)] = True
    return list(map(chr, np.flatnonzero(there).tolist()))


def within(longer: list[str], shorter: list[str], most: list[int]) -> np.ndarray:
    """Whether the distance of each pair is at most ``most``, which is no less than the difference of their lengths: bit-parallel, a column of all pairs at once.

    Both strings of a pair go on with equal characters until all shorter ones have the same length. Of a column only the words
    within the band are kept in which a way of at most ``most`` edits stays; beyond it distances are taken as the largest possible."""
    pairs = len(longer)
    m, n, k = (np.array(x) for x in ([len(x) for x in longer], [len(x) for x in shorter], most))
    columns = int(n.max())
    rows = m + columns - n
    low, high = int(((k - (m - n)) // 2).max()), int(((k + (m - n)) // 2).max())
    words = -(-int(rows.max()) // 64)
    alphabet = _characters(longer, shorter)
    same, none = [c for c in map(chr, range(len(alphabet) + 2)) if c not in alphabet][:2]
    symbols = {ord(c): i for i, c in enumerate((same, *alphabet))}  # ``none`` is after them
    number = np.full(max(*symbols, ord(none)) + 1, len(symbols), np.uint8 if len(symbols) < 256 else np.int32)
    number[list(symbols)] = list(symbols.values())

    def numbers(texts: list[str]) -> np.ndarray:
        return number[_points(texts)].reshape(pairs, -1)

    row = numbers([(x + same * (columns - len(y))).ljust(words * 64, none) for x, y in zip(longer, shorter, strict=True)])
    # of each word, symbol and pair the rows that have the symbol: every bit is added once
    across = len(symbols) * pairs
    flat = np.zeros(words * across, np.uint64)
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for w in range(words):
        part = row[:, 64 * w : 64 * w + 64]
        at = part.astype(np.intp)
        at *= pairs
        at += np.arange(w * across, w * across + pairs)[:, None]
        has = part < len(symbols)
        np.add.at(flat, at[has], np.broadcast_to(bits, part.shape)[has])
    # last column first: in a step word w is at column step - w, so that every word has what the one above sent on in the step before
    column = numbers([x.ljust(columns, same) for x in shorter]).T[::-1].astype(np.intp, order="C") * pairs + np.arange(pairs)
    place = (np.arange(words) * across)[:, None]

    one, last_bit, ones = np.uint64(1), np.uint64(63), ~np.uint64(0)
    up, down = np.full((words, pairs), ones), np.zeros((words, pairs), np.uint64)
    # what comes into a word from above: one more, one less; above the band one more at each column
    more, less = np.ones((words + 1, pairs), np.uint64), np.zeros((words + 1, pairs), np.uint64)
    held = [np.empty((words, pairs), np.uint64) for _ in range(7)]
    index = np.empty((words, pairs), np.intp)
    bottom = min(words - 1, (columns + high - 1) // 64)
    score = np.full(pairs, 64 * (bottom + 1), np.uint64)
    seen = None
    for step in range(1, columns + bottom + 1):
        # word w is kept at columns from 64 w - high + 1 to 64 w + 64 + low
        first = max(0, step - columns, -((low + 64 - step) // 65))
        last = min(bottom, step - 1, (step + high - 1) // 65)
        if first > last:
            continue
        if (first, last) != seen:
            seen, size = (first, last), last - first + 1
            pv, mv, from_above, less_above, to_below, less_below = up[first : last + 1], down[first : last + 1], more[first : last + 1], less[first : last + 1], more[first + 1 : last + 2], less[first + 1 : last + 2]
            eq, xv, xh, plus, minus, right, left = (x[:size] for x in held)
            at, offset = index[:size], place[first : last + 1]
        if first and step == 65 * first + low + 1:  # the word above has left the band
            more[first], less[first] = 1, 0
        np.add(column[columns - step + first : columns - step + last + 1], offset, out=at)
        flat.take(at, out=eq, mode="clip")
        np.bitwise_or(eq, mv, out=xv)
        np.bitwise_or(eq, less_above, out=eq)
        np.bitwise_and(eq, pv, out=xh)
        np.add(xh, pv, out=xh)
        np.bitwise_xor(xh, pv, out=xh)
        np.bitwise_or(xh, eq, out=xh)
        np.bitwise_or(xh, pv, out=plus)
        np.invert(plus, out=plus)
        np.bitwise_or(plus, mv, out=plus)
        np.bitwise_and(pv, xh, out=minus)
        np.right_shift(plus, last_bit, out=right)
        np.right_shift(minus, last_bit, out=left)
        np.left_shift(plus, one, out=plus)
        np.bitwise_or(plus, from_above, out=plus)
        np.left_shift(minus, one, out=minus)
        np.bitwise_or(minus, less_above, out=minus)
        np.bitwise_or(xv, plus, out=xh)
        np.invert(xh, out=xh)
        np.bitwise_or(xh, minus, out=pv)
        np.bitwise_and(plus, xv, out=mv)
        to_below[:] = right
        less_below[:] = left
        # the lowest word of its column
        if last == bottom or last == (step + high - 1) // 65 and (step + high - 1) % 65 < 64:
            if last < words - 1 and step - last > 64 * (last + 1) - high:
                continue
            score += right[-1]
            score -= left[-1]
    score = score.astype(np.int64)
    # from the lowest row kept up to each pair's own last
    for w in range(max(0, (columns - low - 1) // 64), bottom + 1):
        kept = np.clip(rows - 64 * w, 0, 64)
        below = np.where(kept == 64, np.uint64(0), ones << np.minimum(kept, 63).astype(np.uint64))
        score -= np.bitwise_count(up[w] & below).astype(np.int64) - np.bitwise_count(down[w] & below).astype(np.int64)
    return score <= k


def exactly_all(pairs: list[tuple[str, str]]) -> list[bool]:
    """``exactly`` of each pair, for pairs of like lengths at once."""
    out = [False] * len(pairs)
    at, longer, shorter, most = [], [], [], []
    for i, (a, b) in enumerate(pairs):
        k = edits_allowed(a, b)
        x, y = between_ends(a, b)
        if len(x) < len(y):
            x, y = y, x
        if len(x) <= k:
            out[i] = True
        elif len(x) - len(y) <= k:
            at.append(i)
            longer.append(x)
            shorter.append(y)
            most.append(k)
    alphabet = len(_characters(longer, shorter)) + 1
    for batch in _batches([(len(x), len(y)) for x, y in zip(longer, shorter, strict=True)], alphabet):
        if len(batch) < FEW:
            answers = [exactly(*pairs[at[i]]) for i in batch]
        else:
            answers = within([longer[i] for i in batch], [shorter[i] for i in batch], [most[i] for i in batch]).tolist()
        for i, answer in zip(batch, answers, strict=True):
            out[at[i]] = answer
    return out


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, th, line, h1, h2, codes) of every line that isn't blank."""
    for batch in pieces(batches):
        row, line, raw = [], [], []
        for r, x in enumerate(batch.column("text").to_pylist()):
            for i, part in enumerate(normalised_lines(x)):
                if part:
                    row.append(r)
                    line.append(i)
                    raw.append(part)
        h1 = np.array([xxhash.xxh3_64_intdigest(x) for x in raw], np.uint64).view(np.int64)
        h2 = np.array([xxhash.xxh64_intdigest(x, 1) for x in raw], np.uint64).view(np.int64)
        of = pa.array(row, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc").take(of), batch.column("th").take(of), pa.array(line, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), *code_columns(line_codes(raw))],
            names=["doc", "th", "line", "h1", "h2", *CODES])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        texts, wanted = [], batch.column("wanted")
        asked = wanted.flatten()
        number = iter(asked.field("line").to_pylist())
        # only the lines asked for are decoded
        for text, n in zip(batch.column("text").cast(pa.binary()).to_pylist(), wanted.value_lengths().to_pylist(), strict=True):
            lines = text.split(b"\n")
            texts += [normalised(lines[i].decode("utf-8")) for i in islice(number, n)]
        yield pa.RecordBatch.from_arrays([asked.field("id"), pa.array(texts, pa.string())], names=["id", "text"])


def _identified(docs: DataFrame, *more: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"), *more)


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc, th, line, first): lines of groups with several occurrences, but the group's first occurrence
    (``first``: struct of doc, th and line)."""
    texts = _identified(docs)
    kind = ", ".join(f"{c} long" for c in CODES)
    lines = materialize(texts.where("text <> ''").mapInArrow(_lines, f"doc long, th long, line int, h1 long, h2 long, {kind}"))
    place = F.min(F.struct("doc", "th", "line")).alias("first")
    # numbered once and written, so that a class keeps its number
    classes = lines.groupBy("h1", "h2").agg(place, F.count(F.lit(1)).alias("n"), *(F.min(c).alias(c) for c in CODES))
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()))
    coded, lines = lines, materialize(lines.select("doc", "th", "line", "h1", "h2"))
    drop(coded)
    grouped = materialize(candidates(classes, BANDS, LOOSE))
    wanted = classes.join(grouped.select("id").distinct(), "id", "left_semi")
    asked = wanted.select("id", "first.*").groupBy("doc", "th").agg(F.collect_list(F.struct("id", "line")).alias("wanted"))
    # repeated rows answer alike
    fetched = materialize(texts.join(asked, ["doc", "th"]).mapInArrow(_fetch, "id long, text string").dropDuplicates(["id"]))
    free(docs.sparkSession)
    edges = materialize(links(grouped, fetched.join(wanted.select("id", *CODES), "id"), "text", BANDS, LOOSE, str, quickly, exactly, together=exactly_all))
    drop(fetched)
    drop(grouped)
    labels = connected_components(edges).select(F.col("node").alias("id"), F.col("component").alias("root"))
    rooted = classes.select("id", "h1", "h2", "first", "n").join(labels, "id", "left").withColumn("root", F.coalesce("root", "id"))
    groups = rooted.groupBy("root").agg(F.min("first").alias("group_first"), F.sum("n").alias("total")).where("total > 1")
    of_class = rooted.join(groups, "root").select("h1", "h2", "group_first")
    rows = lines.join(of_class, ["h1", "h2"])
    return rows.where(F.struct("doc", "th", "line") != F.col("group_first")).select("doc", "th", "line", F.col("group_first").alias("first"))


def _with_repeats(docs: DataFrame, *more: str) -> DataFrame:
    gone = repeated_lines(docs).groupBy("doc", "th").agg(F.sort_array(F.collect_list(F.struct("line", F.col("first.doc").alias("group_doc"), F.col("first.line").alias("group_line")))).alias("gone"))
    return _identified(docs, *more).join(gone, ["doc", "th"], "left")


def _without(text: bytes, gone: list[int] | None) -> bytes:
    """The text without the lines listed; one that loses all its lines is empty."""
    if not gone:
        return text
    lines, drop = text.split(b"\n"), set(gone)
    return b"\n".join([x for i, x in enumerate(lines) if i not in drop])


def _cut(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes]]:
    """Each text of a batch, and what is left of it."""
    gone = batch.column("gone")
    number = iter(gone.flatten().field("line").to_pylist())
    for text, n in zip(batch.column("text").cast(pa.binary()).to_pylist(), gone.value_lengths().to_pylist(), strict=True):
        yield text, _without(text, list(islice(number, n or 0)))


def report(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_lines, n_removed, kept_sha256, and ``repeats``: each removed line with
    the document and line that its group keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            counts, digests = [], []
            for text, rest in _cut(batch):
                counts.append(text.count(b"\n") + 1)
                digests.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), batch.column("gone")], names=["doc", "n_lines", "kept_sha256", "gone"])

    kind = "array<struct<line: int, group_doc: long, group_line: int>>"
    rows = _with_repeats(docs).select("doc", "text", "gone").mapInArrow(run, f"doc long, n_lines long, kept_sha256 string, gone {kind}")
    doc_id = F.when(F.col("doc") != NULL_ID, F.col("doc"))
    gone = F.coalesce("gone", F.array().cast(kind))
    return rows.select(doc_id.alias("doc_id"), "n_lines", F.size(gone).cast("long").alias("n_removed"), "kept_sha256", gone.alias("repeats"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated lines cut from text; all columns keep name, order and type."""
    row = F.struct(*docs.columns).alias("__row")
    wide = docs.select(row, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = pa.array([rest for _, rest in _cut(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("__row"), texts.cast(pa.string())], names=["__row", "text"])

    kind = wide.schema["__row"].dataType.simpleString()
    rows = _with_repeats(wide, "__row").select("__row", "text", "gone")
    both = rows.mapInArrow(run, f"__row {kind}, text string")
    text = F.when(F.col("__row.text").isNotNull(), F.col("text"))
    return both.select(*(text.alias("text") if c == "text" else F.col("__row").getField(c).alias(c) for c in docs.columns))
