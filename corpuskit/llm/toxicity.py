"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.llm import common

# Labelled rows that the model is fitted on at most; the rows with the smallest hash of their id are taken.
TRAIN_ROWS = 20_000
BITS = 22
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.5
# Of the documents of a fold, those that set the final scale.
CALIBRATION_SHARE = 4
# Words are runs of letters: every other ASCII byte separates them.
SEPARATES = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])


@dataclass
class Model:
    """Weights that are not zero, by feature: sorted features, their weights, intercept, and the scale of the score."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Sum of weights per document; ``features`` are distinct within each document."""
        total = np.full(len(bounds) - 1, self.bias)
        if not len(self.features) or not len(features):
            return total
        at = np.minimum(np.searchsorted(self.features, features), len(self.features) - 1)
        hit = np.flatnonzero(self.features[at] == features)
        doc = np.searchsorted(bounds, hit, "right") - 1
        return total + np.bincount(doc, self.weights[at[hit]], len(bounds) - 1)

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -35, 35)))


def features(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features per document: words, word pairs, and pairs with one word between (skip-grams)."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    kinds, owners = [words], [doc]
    for gap, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        if len(words) > gap:
            same = doc[gap:] == doc[:-gap]
            kinds.append(common.mix(words[:-gap] * np.uint64(salt) + words[gap:])[same])
            owners.append(doc[gap:][same])
    hashed = np.concatenate(kinds) >> np.uint64(64 - BITS)
    key = np.unique((np.concatenate(owners).astype(np.uint64) << np.uint64(BITS)) | hashed)
    owner = (key >> np.uint64(BITS)).astype(np.int64)
    return (key & np.uint64((1 << BITS) - 1)).astype(np.int64), np.searchsorted(owner, np.arange(len(bounds)))


def batch_features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, last, features, bounds) for runs of documents of bounded size."""
    data, offsets = common.utf8(column)
    for first, last in common.slices(offsets):
        words, bounds = common.word_hashes(data, offsets[first : last + 1], SEPARATES)
        yield first, last, *features(words, bounds)


class Ftrl:
    """Per-coordinate FTRL-proximal with logistic loss. Weights stay zero until |z| passes L1."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.bias_z = self.bias_n = 0.0

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        return np.where(
            np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        )

    @property
    def bias(self) -> float:
        return -self.bias_z / ((BETA + self.bias_n**0.5) / ALPHA + L2)

    def learn(self, at: np.ndarray, label: int) -> None:
        w, b = self.weights(at), self.bias
        g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - label
        n = self.n[at]
        grown = n + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(n)) / ALPHA * w
        self.n[at] = grown
        n = self.bias_n + g * g
        self.bias_z += g - (n**0.5 - self.bias_n**0.5) / ALPHA * b
        self.bias_n = n


def fit(rows: list[tuple[np.ndarray, int]]) -> Model:
    """Fit on (distinct features, label) pairs in the order given; every CALIBRATION_SHARE-th row sets the scale."""
    held = rows[::CALIBRATION_SHARE]
    used = [r for k, r in enumerate(rows) if k % CALIBRATION_SHARE] or rows
    if not rows:
        return Model(np.empty(0, np.int64), np.empty(0), 0.0)
    ftrl = Ftrl()
    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(used)):
            ftrl.learn(*used[k])
    seen = np.flatnonzero(ftrl.n)
    w = ftrl.weights(seen)
    model = Model(seen[w != 0], w[w != 0], ftrl.bias)
    margins = np.array([model.margin(f, np.array([0, len(f)]))[0] for f, _ in held])
    model.slope, model.shift = scale(margins, np.array([y for _, y in held], float))
    return model


def scale(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic scale of margins (Newton steps on slope and shift, with a weak pull to 1 and 0)."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - label) * margin).sum() + a - 1, (p - label).sum() + b * 0.1])
        h = np.array([[(w * margin**2).sum() + 1, (w * margin).sum()], [(w * margin).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return (a, b) if a > 0 else (1.0, 0.0)


def is_held_out(id_: Column) -> Column:
    return F.crc32(id_.cast("string")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents outside ``held_out`` (default: crc32(doc_id) mod 3 = 1).

    Features are made in the tasks; the driver gets the distinct features of the sample alone. Rows without an id,
    label or text count as no sample. A repeated id takes its largest label.
    """
    held_out = is_held_out(F.col("doc_id")) if held_out is None else held_out
    wanted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("_label"))
    wanted = wanted.filter("doc_id is not null and _label in (0, 1)").filter(~held_out).groupBy("doc_id").agg(F.max("_label").alias("_label"))
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").filter(~held_out).distinct()
    sample = wanted.join(known, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
    label = {r["doc_id"]: r["_label"] for r in sample}
    if not label:
        return fit([])
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(i,) for i in label], "doc_id long")
    picked = picked.join(F.broadcast(chosen), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, f, bounds in batch_features(batch.column(1)):
                packed = [f[bounds[k] : bounds[k + 1]].astype("<i4").tobytes() for k in range(last - first)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(packed, pa.binary())], ["doc_id", "features"])

    found: dict[int, bytes] = {}
    for r in picked.mapInArrow(run, "doc_id long, features binary").toLocalIterator():
        found[r["doc_id"]] = max(found.get(r["doc_id"], b""), bytes(r["features"]))
    return fit([(np.frombuffer(found[i], "<i4"), label[i]) for i in label if i in found])


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted of every whole text; null and empty texts get the intercept's score.

    The weights that L1 left are broadcast: at most one per feature seen in the bounded sample.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = shared.value
        for batch in batches:
            out = np.empty(batch.num_rows)
            for first, last, f, bounds in batch_features(batch.column(1)):
                out[first:last] = own.probability(own.margin(f, bounds))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "score"])

    scored = common.texts(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
