"""Language identification: a byte convolutional network trained in numpy, applied to fixed-length windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.llm import common

# Labelled rows that the network is fitted on at most; the rows with the smallest hash of their id are taken.
TRAIN_ROWS = 2_000
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS, EMBEDDING = 12, 8
# Windows per sampled text, steps of training and their size.
TEXT_WINDOWS, EPOCHS, BATCH, RATE = 4, 6, 64, 0.01
UNKNOWN = "und"


@dataclass
class Network:
    """Byte embedding, filters by width (width, embedding, filter), and a softmax layer over the pooled filters."""

    classes: list[str]
    weights: dict[str, np.ndarray]
    _pairs: list = field(default_factory=list, repr=False)

    @classmethod
    def new(cls, classes: list[str]) -> Network:
        rng = np.random.default_rng(7)
        w = {"e": rng.normal(0, 0.5, (256, EMBEDDING))}
        for k in WIDTHS:
            w[f"f{k}"] = rng.normal(0, 1 / np.sqrt(k * EMBEDDING), (k, EMBEDDING, FILTERS))
            w[f"b{k}"] = np.zeros(FILTERS)
        w["d"] = rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(classes)))
        w["c"] = np.zeros(len(classes))
        return cls(classes, w)

    def tables(self, k: int) -> list[np.ndarray]:
        """What a byte adds to each filter of width ``k``, by its place in the filter."""
        return [(self.weights["e"] @ f).astype(np.float32) for f in self.weights[f"f{k}"]]

    def fold(self) -> None:
        """For prediction: tables over two neighbouring bytes, so that a filter takes half the look-ups."""
        self._pairs = []
        for k in WIDTHS:
            t = self.tables(k)
            folded = [(t[j][:, None] + t[j + 1][None]).reshape(1 << 16, FILTERS) for j in range(0, k - 1, 2)]
            self._pairs.append((k, folded, t[-1] if k % 2 else None, self.weights[f"b{k}"].astype(np.float32)))

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        """(windows, classes) for uint8 windows (n, WINDOW)."""
        if not self._pairs:
            self.fold()
        pairs = (windows[:, :-1].astype(np.int32) << 8) | windows[:, 1:]
        pooled = []
        for k, folded, last, bias in self._pairs:
            n = WINDOW - k + 1
            h = folded[0].take(pairs[:, :n], axis=0)
            for j, table in enumerate(folded[1:], 1):
                h += table.take(pairs[:, 2 * j : 2 * j + n], axis=0)
            if last is not None:
                h += last.take(windows[:, k - 1 : k - 1 + n], axis=0)
            pooled.append(np.maximum(h.max(axis=1) + bias, 0))
        return log_softmax(np.concatenate(pooled, axis=1) @ self.weights["d"] + self.weights["c"])

    def step(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross entropy; only the place that won the pooling passes a filter's gradient on."""
        w, rows = self.weights, np.arange(len(windows))[:, None]
        best, pooled = {}, []
        for k in WIDTHS:
            n = WINDOW - k + 1
            h = sum(t.take(windows[:, j : j + n], axis=0) for j, t in enumerate(self.tables(k)))
            best[k] = h.argmax(axis=1)
            pooled.append(np.take_along_axis(h, best[k][:, None], axis=1)[:, 0] + w[f"b{k}"])
        before = np.concatenate(pooled, axis=1)
        active = np.maximum(before, 0)
        p = np.exp(log_softmax(active @ w["d"] + w["c"]))
        p[np.arange(len(p)), labels] -= 1
        p /= len(p)
        g = {"d": active.T @ p, "c": p.sum(axis=0), "e": np.zeros_like(w["e"])}
        back = (p @ w["d"].T) * (before > 0)
        for i, k in enumerate(WIDTHS):
            own = back[:, i * FILTERS : (i + 1) * FILTERS]
            g[f"b{k}"] = own.sum(axis=0)
            g[f"f{k}"] = np.empty_like(w[f"f{k}"])
            for j in range(k):
                seen = windows[rows, best[k] + j]
                g[f"f{k}"][j] = np.einsum("bf,bfe->ef", own, w["e"][seen])
                np.add.at(g["e"], seen, own[..., None] * w[f"f{k}"][j].T[None])
        return g


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def fit(texts: list[bytes], labels: list[str]) -> Network:
    """Adam on windows spread evenly over each text."""
    classes = sorted(set(labels))
    net = Network.new(classes)
    if len(classes) < 2:
        return net
    x, y = [], []
    for text, label in zip(texts, labels, strict=True):
        last = max(0, len(text) - WINDOW)
        for at in sorted({last * k // max(1, TEXT_WINDOWS - 1) for k in range(TEXT_WINDOWS)}):
            x.append(np.frombuffer(text[at : at + WINDOW].ljust(WINDOW, b"\0"), np.uint8))
            y.append(classes.index(label))
    x, y = np.stack(x), np.array(y)
    mean = {k: np.zeros_like(v) for k, v in net.weights.items()}
    square = {k: np.zeros_like(v) for k, v in net.weights.items()}
    t = 0
    for epoch in range(EPOCHS):
        order = np.random.default_rng(epoch).permutation(len(x))
        for first in range(0, len(x), BATCH):
            own = order[first : first + BATCH]
            t += 1
            for k, g in net.step(x[own], y[own]).items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                rate = RATE * (1 - 0.9 * t * BATCH / (EPOCHS * len(x) + BATCH))
                net.weights[k] -= rate * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)
    return net


def is_held_out(id_: Column) -> Column:
    return F.crc32(id_.cast("string")) % 4 == 2


def train(docs: DataFrame, held_out: Column | None = None, rows: int = TRAIN_ROWS) -> Network:
    """Fit on at most ``rows`` documents with text and lang outside ``held_out`` (default: crc32(doc_id) mod 4 = 2).

    Of a sampled text TEXT_WINDOWS windows are seen. Without such rows the network knows no language.
    """
    id_ = F.col("doc_id").cast("long")
    held_out = is_held_out(id_) if held_out is None else held_out
    known = docs.filter("text is not null and lang is not null and doc_id is not null").filter(~held_out)
    order = F.xxhash64(id_)
    ids = known.select(order.alias("h"), id_.alias("_id")).orderBy("h", "_id").limit(rows).collect()
    if not ids:
        return Network.new([])
    chosen = docs.sparkSession.createDataFrame([(r["_id"],) for r in ids], "_id long").distinct()
    size = F.length("text")
    starts = [F.expr(f"greatest(length(text) - {WINDOW}, 0) * {k} div {TEXT_WINDOWS - 1}") for k in range(TEXT_WINDOWS)]
    parts = F.when(size <= TEXT_WINDOWS * WINDOW, F.col("text")).otherwise(
        F.concat(*[F.substring(F.col("text"), (s + 1).cast("int"), F.lit(WINDOW)) for s in starts])
    )
    sample = known.join(F.broadcast(chosen), id_ == F.col("_id"), "left_semi").select(id_.alias("_id"), parts.alias("t"), "lang")
    found = sorted((r["_id"], r["lang"], r["t"]) for r in sample.toLocalIterator())[: 2 * rows]
    return fit([t.encode() for _, _, t in found], [lang for _, lang, _ in found])


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text.

    A text is cut into windows of WINDOW bytes; the score is the geometric mean of the windows' probabilities, made to
    sum to one. ``und`` with score 0 for a null text, one without a letter, and where no language was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    letters = np.array([b < 128 and chr(b).isalpha() for b in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Network = shared.value
        for batch in batches:
            column = batch.column(1)
            lang, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            data, offsets = common.utf8(column)
            for first, last in common.slices(offsets, 250_000):
                part = offsets[first : last + 1]
                found = _documents(own, data, part) if own.classes else None
                plain = letters[data[part[0] : part[-1]]]
                ends = np.concatenate([[0], np.cumsum(plain)])[part - part[0]]
                for k in range(first, last):
                    some = ends[k - first + 1] > ends[k - first] or any(map(str.isalpha, column[k].as_py()))
                    if some and found is not None:
                        best = int(found[k - first].argmax())
                        lang[k], score[k] = own.classes[best], float(found[k - first][best])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score)], ["doc_id", "lang_pred", "score"])

    found = common.texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def _documents(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, classes) probabilities."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    total = np.zeros((len(sizes), len(net.classes)))
    if not bounds[-1]:
        return total
    windows = np.zeros((bounds[-1], WINDOW), np.uint8)
    flat = windows.reshape(-1)
    for k in np.flatnonzero(counts):
        flat[bounds[k] * WINDOW : bounds[k] * WINDOW + sizes[k]] = data[offsets[k] : offsets[k + 1]]
    for first in range(0, len(windows), 512):
        logs = net.log_probabilities(windows[first : first + 512])
        np.add.at(total, np.searchsorted(bounds, np.arange(first, first + len(logs)), "right") - 1, logs)
    return np.exp(log_softmax(total / np.maximum(counts, 1)[:, None]))


def keep_known(docs: DataFrame, net: Network, least: float = 0.3) -> DataFrame:
    """The rows whose language is known with a score of ``least``; columns as they were. Rows without an id go."""
    good = predict(docs, net).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    good = good.select(F.col("doc_id").alias("_good")).distinct()
    return docs.join(good, docs["doc_id"].cast("long") == good["_good"], "left_semi")
