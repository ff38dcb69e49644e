"""Language identification by a byte convolutional network, trained here in numpy.

The network reads windows of ``WINDOW`` bytes: filters of several widths over one-hot bytes (a filter is a
table lookup a byte), max pooling over the window, then softmax. A text is cut into consecutive windows that
cover all of it; its language is that of the mean of its windows' logits. Training uses a documented,
bounded sample of labelled rows (``SAMPLE_DOCS`` documents, shared evenly among the languages, up to
``SAMPLE_WINDOWS`` windows each spread over the whole text); only text and label enter.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is every text where there
is nothing to learn from; repeated rows get repeated results and are learned from once; every language that occurs is a class;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
SAMPLE_DOCS, SAMPLE_WINDOWS = 6000, 6
UNKNOWN = "und"


@dataclass
class ByteCNN:
    langs: list[str]
    #: For each width w an array (w, 256, FILTERS): what byte b at offset j adds to a filter.
    conv: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    out: np.ndarray
    _pairs: list | None = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_pairs": None}

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """(windows, filters) from (windows, WINDOW) bytes. Two offsets at a time are looked up in tables of byte pairs."""
        if self._pairs is None:
            tables = []
            for w, c in zip(WIDTHS, self.conv, strict=True):
                parts = [(j, (c[j][:, None, :] + c[j + 1][None, :, :]).reshape(65536, -1).astype(np.float32)) for j in range(0, w - 1, 2)]
                tables.append((parts, c[w - 1].astype(np.float32) if w % 2 else None))
            self._pairs = tables
        code = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        pools = []
        for (parts, single), w in zip(self._pairs, WIDTHS, strict=True):
            n = WINDOW - w + 1
            total = None
            for j, table in parts:
                got = table.take(code[:, j : j + n], axis=0)
                total = got if total is None else np.add(total, got, out=total)
            if single is not None:
                total += single.take(x[:, w - 1 : w - 1 + n], axis=0)
            pools.append(total.max(axis=1))
        return np.maximum(np.concatenate(pools, axis=1) + self.bias, 0)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.pooled(x[i : i + 64]) @ self.dense + self.out for i in range(0, len(x), 64)] or [np.zeros((0, len(self.langs)))])

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, probability) of non-empty texts."""
        sums, counts = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        held, owners = [], []

        def flush() -> None:
            if held:
                got = self.logits(np.concatenate(held))
                np.add.at(sums, np.concatenate(owners), got)
                held.clear()
                owners.clear()

        pending = 0
        for i, text in enumerate(texts):
            raw = text.encode("utf-8")
            for start in range(0, len(raw), WINDOW << 12):  # a very long text goes a mebibyte at a time
                x = windows(raw[start : start + (WINDOW << 12)])
                held.append(x)
                owners.append(np.full(len(x), i))
                counts[i] += len(x)
                pending += len(x)
                if pending >= 4096:
                    flush()
                    pending = 0
        flush()
        p = _softmax(sums / np.maximum(counts, 1)[:, None])
        best = p.argmax(axis=1)
        return [(self.langs[b], float(p[i, b])) for i, b in enumerate(best)]


def windows(raw: bytes) -> np.ndarray:
    """(n, WINDOW) consecutive windows of all bytes; the last is filled up with zeros."""
    n = max(1, -(-len(raw) // WINDOW))
    x = np.zeros(n * WINDOW, np.uint8)
    x[: len(raw)] = np.frombuffer(raw, np.uint8)
    return x.reshape(n, WINDOW)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = 5, batch: int = 128, rate: float = 0.01, seed: int = 5) -> ByteCNN:
    """Fit by Adam. Pooling passes a gradient to one position a filter and window only, so a step costs little
    more than the forward pass. Classes weigh alike however many windows they have."""
    rng = np.random.default_rng(seed)
    net = ByteCNN(
        langs, [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32),
        rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))
    params = [*net.conv, net.bias, net.dense, net.out]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = len(y) / (len(langs) * np.maximum(np.bincount(y, minlength=len(langs)), 1))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            rows = order[i : i + batch]
            xb, yb = x[rows], y[rows]
            pools, at = [], []
            for w, c in zip(WIDTHS, net.conv, strict=True):
                n = WINDOW - w + 1
                total = c[0].take(xb[:, :n], axis=0)
                for j in range(1, w):
                    total += c[j].take(xb[:, j : j + n], axis=0)
                at.append(total.argmax(axis=1))
                pools.append(np.take_along_axis(total, at[-1][:, None, :], axis=1)[:, 0, :])
            pre = np.concatenate(pools, axis=1) + net.bias
            h = np.maximum(pre, 0)
            p = _softmax(h @ net.dense + net.out)
            g = p
            g[np.arange(len(yb)), yb] -= 1
            g *= weight[yb][:, None] / len(yb)
            g = g.astype(np.float32)
            gh = (g @ net.dense.T) * (pre > 0)
            grads = []
            for k, (w, a) in enumerate(zip(WIDTHS, at, strict=True)):
                gk = gh[:, k * FILTERS : (k + 1) * FILTERS]
                gc = np.zeros((w, 256, FILTERS), np.float32)
                filters = np.broadcast_to(np.arange(FILTERS), a.shape)
                for j in range(w):
                    np.add.at(gc[j], (np.take_along_axis(xb, a + j, axis=1), filters), gk)
                grads.append(gc)
            grads += [gh.sum(axis=0), h.T @ g, g.sum(axis=0)]
            step += 1
            for q, (param, grad) in enumerate(zip(params, grads, strict=True)):
                m[q] += 0.1 * (grad - m[q])
                v[q] += 0.001 * (grad * grad - v[q])
                param -= (rate * (m[q] / (1 - 0.9**step)) / (np.sqrt(v[q] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def training_windows(docs: DataFrame, seed: int = 5) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, class numbers and languages of a bounded sample of ``docs`` (doc_id, text, lang, all labelled)."""
    per = docs.groupBy("lang").count().collect()  # a row a language
    langs = sorted(r["lang"] for r in per)
    if not langs:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    share = SAMPLE_DOCS / len(langs)
    cuts = F.create_map(*[x for r in per for x in (F.lit(r["lang"]), F.lit(int(min(1.0, share / r["count"]) * (1 << 30))))])
    drawn = docs.withColumn("pick", F.xxhash64(F.lit(seed), "doc_id", "text")).where(F.pmod("pick", F.lit(1 << 30)) < cuts[F.col("lang")])
    drawn = drawn.dropDuplicates(["pick", "lang"])  # a row that is repeated many times is drawn once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picks, labels, out = [], [], []
            for text, lang, pick in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "pick")), strict=True):
                raw = text.encode("utf-8")
                n = max(1, -(-len(raw) // WINDOW))
                for i in sorted({int(k) for k in np.linspace(0, n - 1, SAMPLE_WINDOWS)}):
                    out.append(windows(raw[i * WINDOW : (i + 1) * WINDOW])[0].tobytes())
                    labels.append(lang)
                    picks.append(pick)
            yield pa.RecordBatch.from_arrays([pa.array(picks, pa.int64()), pa.array(labels, pa.string()), pa.array(out, pa.binary())], names=["pick", "lang", "x"])

    got = sorted(map(tuple, drawn.select("text", "lang", "pick").mapInArrow(run, "pick long, lang string, x binary").collect()))
    number = {lang: i for i, lang in enumerate(langs)}
    x = np.frombuffer(b"".join(bytes(r[2]) for r in got), np.uint8).reshape(-1, WINDOW)
    return x, np.array([number[r[1]] for r in got], np.int64), langs


def fit(docs: DataFrame) -> ByteCNN | None:
    """A network from the labelled rows of ``docs`` (doc_id, text, lang), or None where there are none."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    x, y, langs = training_windows(labelled)
    return train(x, y, langs) if len(x) else None


def held_out(doc_id) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, net: ByteCNN | None, keep: tuple[str, ...] = ("doc_id",), to: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns of ``docs`` with the prediction and its score in columns ``to``. The network reads ``text`` alone."""
    rows = docs.select(F.struct(*keep).alias("row"), F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column("text").to_pylist()
            on = [i for i, t in enumerate(texts) if t is not None and net is not None]
            out = [(UNKNOWN, 0.0)] * len(texts)
            for i, got in zip(on, net.predict([texts[i] for i in on]) if on else [], strict=True):
                out[i] = got
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], names=["row", "pred", "score"])

    judged = rows.mapInArrow(run, f"row {kind}, pred string, score double")
    return judged.select(*(F.col("row").getField(c).alias(c) for c in keep), F.col("pred").alias(to[0]), F.col("score").alias(to[1]))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; rows with held_out aren't learned from."""
    net = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
