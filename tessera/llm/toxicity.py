"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration, all in numpy.

Features of a whole text: densities of a lexicon (words and word beginnings that labelled toxic texts use far
more often), its hits after undoing look-alike characters, closeness of hits to second-person words, capitals,
punctuation and obfuscation rates. The lexicon, the trees and the calibration are learned from three
disjoint parts of a documented, bounded sample (``SAMPLE_DOCS``) of labelled rows. The lexicon holds the ``MAX_ENTRIES`` terms with
the largest odds; words of more than ``LONGEST`` letters enter it by their beginnings only. With k toxic rows in its part, the
calibration weighs k / (k + ``TRUST``) and the trees' own probability the rest.

Defined cases: a null or empty text has all features zero and is scored like any other; where there is nothing to
learn from (no labelled rows of both kinds) every score is 0; a document with several labels is toxic if
one says so; null labels and null ids are not learned from; repeated rows get repeated results; of several texts with one id
the smallest is learned from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SAMPLE_DOCS = 20000
MAX_ENTRIES, MIN_DOCS, MIN_ODDS, LONGEST, TRUST = 4000, 3, 1.5, 40, 20
PREFIXES = (4, 5, 6)
NEAR = 6
WORDS = re.compile(r"\w+")
#: Second-person words of four languages.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer tu toi te ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
#: Characters that stand for letters.
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "€": "e", "|": "l", "+": "t"})
#: A word with a stand-in character inside or in front; possessive, so that plain words fail at once.
MIXED = re.compile(r"\b[^\W\d_]++[\d@$!*€|+]++\w[\w@$!*€|+]*|(?<![\w@$*€|+])[\d@$*€|+]++[^\W\d_][\w@$!*€|+]*")
SHOUT = re.compile(r"\b[A-Z]{3,}\b")
PUNCTUATION, STAND_INS = list(b"!?.,;:-\"'()*"), list(b"@$!*|+\xe2")
#: What a second-person word weighs: no lexicon weight reaches it.
YOU = 1e6
FEATURES = (
    "log_words", "hits", "hit_density", "distinct_hits", "weight_sum", "weight_max", "prefix_hits", "prefix_density", "hidden_hits", "near_second_person",
    "second_person_density", "capital_rate", "shouted_words", "exclamation_rate", "punctuation_rate", "obfuscation_rate", "digit_rate", "strong_density",
)


def terms(text: str | None) -> set[str]:
    """What a text offers to the lexicon: its lower-cased words (``w:``) and their beginnings (``4:`` and so on)."""
    words = set(WORDS.findall((text or "").lower()))
    out = {"w:" + w for w in words if len(w) <= LONGEST}
    for n in PREFIXES:
        out |= {f"{n}:{w[:n]}" for w in words if len(w) >= n}
    return out


class _Weights(dict):
    """Word -> (weight of the word itself or 0, weight of its best beginning or 0); filled as words occur."""

    LIMIT = 1 << 19

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        if word in SECOND_PERSON:
            self[word] = YOU
            return YOU
        get = self.lexicon.get
        own = get("w:" + word, 0.0)
        best = max(get(f"{n}:{word[:n]}", 0.0) for n in PREFIXES) if len(word) >= PREFIXES[0] else 0.0
        value = own + 1000.0 if own else -best
        if len(self) > self.LIMIT:
            self.clear()
        self[word] = value
        return value


def featurize(texts: list[str | None], weights: _Weights) -> np.ndarray:
    """(len(texts), len(FEATURES)) features of whole texts."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        if not text:
            continue
        lower = text.lower()
        words = WORDS.findall(lower)
        n = max(len(words), 1)
        value = np.fromiter(map(weights.__getitem__, words), np.float64, len(words))
        you = np.flatnonzero(value == YOU)
        value[you] = 0
        hits = np.flatnonzero(value)
        own, start = hits[value[hits] > 0], hits[value[hits] < 0]
        weight = np.where(value[hits] > 0, value[hits] - 1000.0, -value[hits])
        # one count of all bytes serves every character rate
        count = np.bincount(np.frombuffer(text.encode("utf-8"), np.uint8), minlength=256)
        capitals, digits, marks, punctuation = int(count[65:91].sum()), int(count[48:58].sum()), int(count[33]), int(count[PUNCTUATION].sum())
        hidden = mixed = 0
        if digits or count[STAND_INS].any():
            for token in MIXED.findall(lower):
                mixed += 1
                plain = token.translate(LOOKALIKE).replace("*", "")
                hidden += plain != token and weights[plain] not in (0.0, YOU)
        near = 0
        if len(hits) and len(you):
            at = np.searchsorted(you, hits)
            gap = np.minimum(np.abs(hits - you[np.minimum(at, len(you) - 1)]), np.abs(hits - you[np.maximum(at - 1, 0)]))
            near = int((gap <= NEAR).sum())
        chars = len(text)
        shouted = len(SHOUT.findall(text)) if capitals >= 3 else 0
        out[i] = (
            np.log1p(len(words)), np.log1p(len(own)), len(own) / n, len({words[k] for k in hits.tolist()}), weight.sum(), weight.max(initial=0.0), np.log1p(len(start)), len(start) / n, hidden, near,
            len(you) / n, capitals / chars, shouted / n, marks / chars, punctuation / chars, mixed / n, digits / chars, float((weight >= 3).sum()) / n,
        )
    return out


@dataclass
class Boosted:
    """Trees as arrays: for each tree a list of (feature, threshold, left, right) with leaves as values."""

    base: float
    trees: list[list[tuple[int, float, int, int, float]]]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            at = np.zeros(len(x), np.int64)
            feature, threshold, left, right, value = (np.array(c) for c in zip(*tree, strict=True))
            for _ in range(len(tree)):
                inner = feature[at] >= 0
                if not inner.any():
                    break
                go_left = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(go_left, left[at], right[at]), at)
            out += value[at]
        return out


def boost(x: np.ndarray, y: np.ndarray, n_trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 2.0) -> Boosted:
    """Newton boosting of the logistic loss over histograms of each feature's quantile bins."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    margin = np.full(len(y), base)
    trees = []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        tree: list[list] = []
        todo = [(np.arange(len(y)), 0, None, 0)]
        while todo:
            rows, level, parent, side = todo.pop()
            me = len(tree)
            if parent is not None:
                tree[parent][side] = me
            sg, sh = g[rows].sum(), h[rows].sum()
            best = (1e-6, -1, 0)
            if level < depth and len(rows) >= 10:
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    cg = np.cumsum(np.bincount(code[rows, f], g[rows], len(e) + 1))[:-1]
                    ch = np.cumsum(np.bincount(code[rows, f], h[rows], len(e) + 1))[:-1]
                    gain = cg**2 / (ch + ridge) + (sg - cg) ** 2 / (sh - ch + ridge) - sg**2 / (sh + ridge)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, k)
            if best[1] < 0:
                value = float(-rate * sg / (sh + ridge))
                tree.append([-1, 0.0, 0, 0, value])
                margin[rows] += value
                continue
            _, f, k = best
            tree.append([f, float(edges[f][k]), 0, 0, 0.0])
            left = code[rows, f] <= k
            todo += [(rows[~left], level + 1, me, 3), (rows[left], level + 1, me, 2)]
        trees.append([tuple(t) for t in tree])
    return Boosted(base, trees)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, value) of the non-decreasing step function closest to y (pool adjacent violators); equal x pool first."""
    xs, inverse = np.unique(x, return_inverse=True)
    total, count = np.bincount(inverse, y), np.bincount(inverse)
    blocks: list[list[float]] = []
    for t, c, k in zip(total.tolist(), count.tolist(), range(len(xs)), strict=True):
        blocks.append([t, c, k, k])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t2, c2, _, last = blocks.pop()
            blocks[-1][0] += t2
            blocks[-1][1] += c2
            blocks[-1][3] = last
    px, pv = [], []
    for t, c, a, b in blocks:
        px += [xs[a], xs[b]]
        pv += [t / c, t / c]
    return np.array(px), np.array(pv)


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Boosted
    steps: tuple[np.ndarray, np.ndarray]
    trust: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities. A tiny share of the raw margin keeps the order within a step."""
        margin = self.trees.margin(x)
        raw = 1 / (1 + np.exp(-margin))
        own = self.trust * np.interp(margin, *self.steps) + (1 - self.trust) * raw if self.trust else raw
        return np.clip(0.98 * own + 0.02 * raw, 0.0, 1.0)


def held_out(doc_id) -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id is never held out (nor learned from)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _features(rows: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """(part, toxic, x) of sampled rows (part, toxic, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _Weights(lexicon)
        for batch in batches:
            x = featurize(batch.column("text").to_pylist(), weights)
            yield pa.RecordBatch.from_arrays([batch.column("pick"), batch.column("part"), batch.column("toxic"), pa.array(list(x), pa.list_(pa.float64()))], names=["pick", "part", "toxic", "x"])

    return rows.select("pick", "part", "toxic", "text").mapInArrow(run, "pick long, part int, toxic int, x array<double>")


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Smoothed log odds of the terms that toxic rows (toxic, text) have far more often than others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, toxic = [], []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                own = terms(text)
                found += own
                toxic += [label] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(toxic, pa.int32())], names=["term", "toxic"])

    n, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    counts = rows.select("text", "toxic").mapInArrow(run, "term string, toxic int").groupBy("term").agg(F.sum("toxic").alias("p"), F.count(F.lit(1)).alias("c"))
    odds = F.log((F.col("p") + 0.5) / (positive + 1.0)) - F.log((F.col("c") - F.col("p") + 0.5) / (n - positive + 1.0))
    top = counts.withColumn("odds", odds).where((F.col("p") >= MIN_DOCS) & (F.col("odds") >= MIN_ODDS)).orderBy(F.col("odds").desc(), F.col("p").desc(), "term").limit(MAX_ENTRIES)
    return {r["term"]: float(r["odds"]) for r in top.collect()}


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic) whose rows aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if not n:
        return None
    share = int(min(1.0, SAMPLE_DOCS / n) * (1 << 30))
    picked = known.withColumn("pick", F.xxhash64(F.lit(11), "doc_id")).where(F.pmod("pick", F.lit(1 << 30)) < share)
    # at most about SAMPLE_DOCS rows of three numbers are broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    part = F.pmod(F.shiftright("pick", 32), F.lit(10)).cast("int")
    rows = rows.groupBy("pick").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))
    rows = materialize(rows.select("pick", "toxic", "text", part.alias("part")))
    lexicon = learn_lexicon(rows.where("part < 4"))
    got = sorted(_features(rows.where("part >= 4"), lexicon).collect(), key=lambda r: (r["pick"], r["toxic"], r["x"]))
    x, y, own = np.array([r["x"] for r in got]).reshape(-1, len(FEATURES)), np.array([r["toxic"] for r in got], float), np.array([r["part"] for r in got])
    tree_rows, last_rows = own < 8, own >= 8
    if len(y) < 2 or y[tree_rows].min(initial=1) == y[tree_rows].max(initial=0):
        return None
    trees = boost(x[tree_rows], y[tree_rows])
    toxic = float(y[last_rows].sum())
    return Model(lexicon, trees, isotonic(trees.margin(x[last_rows]), y[last_rows]), toxic / (toxic + TRUST))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score and predicted for every row; only ``text`` enters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _Weights(model.lexicon if model else {})
        for batch in batches:
            texts = batch.column("text").to_pylist()
            s = model.scores(featurize(texts, weights)) if model else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    return score(docs, fit(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
