"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded from its own features (how its bytes
fall into classes, word lengths, repeated and distinct words) by a small layer; gated attention,
``softmax(u.(tanh(V h) * sigmoid(G h)))``, weights the passages, and the document's score is a logistic function of
the weighted passage representation. Only document labels are needed; the attention weights say which passages a
score comes from (:func:`score_texts` with ``attention=True``).

The model is fitted on at most ``SAMPLE`` labelled documents of each class, chosen by a hash of the id, and on every
passage of theirs: features take about half the size of the text they describe. Scoring reads every passage too.

Defined cases: null and empty texts are one empty passage; repeated rows each get their score; labels, languages,
sources and ids are no inputs; without labels of both classes all scores are 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import slices, utf8
from plumbline.llm.toxicity import sample_labels

PASSAGE = 64
SAMPLE = 2500
THRESHOLD = 0.3

#: every printable ASCII character that is no letter or digit has a class of its own; then digits, cases and the rest
_CLASS = np.array([
    0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b >= 128 else 4 if b in (32, 9) else 5 if b == 10
    else 6 if b < 32 or b == 127 else 7 + (b - 33 if b < 48 else b - 43 if b < 65 else b - 69 if b < 97 else b - 95)
    for b in range(256)
], np.int64)
_CLASSES = int(_CLASS.max()) + 1
N_FEATURES = _CLASSES + 6


def passages(text: bytes) -> list[list[bytes]]:
    found = text.split()
    return [found[i : i + PASSAGE] for i in range(0, len(found), PASSAGE)] or [[]]


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One row of features for each passage of all texts, and the number of passages of each text."""
    counts, joined, rest = [], [], []
    for text in texts:
        own = passages(text)
        counts.append(len(own))
        for part in own:
            n = len(part)
            joined.append(b" ".join(part))
            starts = sum(map(bytes.istitle, part))
            rest.append((n, len(set(part)), sum(map(eq, part, part[1:])), len(set(map(bytes.lower, part))), starts, max(map(len, part), default=0)))
    sizes = np.array([len(j) for j in joined])
    passage = np.repeat(np.arange(len(joined)), sizes)
    octets = np.frombuffer(b"".join(joined), np.uint8)
    histogram = np.bincount(passage * _CLASSES + _CLASS[octets], minlength=len(joined) * _CLASSES).reshape(len(joined), _CLASSES)
    n, distinct, repeated, folded, starts, longest = np.array(rest, np.float64).T
    words = np.maximum(n, 1)
    more = np.stack([np.log1p(n), distinct / words, repeated / words, folded / words, starts / words, np.log1p(longest)], axis=1)
    return np.hstack((np.sqrt(histogram / np.maximum(sizes, 1)[:, None]), more)).astype(np.float32), np.array(counts)


@dataclass
class Model:
    """Weights of the encoder (W, b), the gated attention (V, G, u) and the classifier (c, d); inputs are standardised."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        x = (x - self.mean) / self.scale
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        h = np.tanh(x @ w["W"] + w["b"])
        value, gate = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-h @ w["G"]))
        energy = (value * gate) @ w["u"]
        energy = np.exp(energy - np.repeat(np.maximum.reduceat(energy, starts), counts))
        a = energy / np.repeat(np.add.reduceat(energy, starts), counts)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -60, 60)))
        return {"x": x, "h": h, "value": value, "gate": gate, "a": a, "z": z, "p": p, "starts": starts}

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted mean log loss."""
        w, f = self.weights, self.forward(x, counts)
        slope = weight * (f["p"] - y) / weight.sum()
        dz = slope[:, None] * w["c"]
        dz_each = np.repeat(dz, counts, axis=0)
        da = (dz_each * f["h"]).sum(axis=1)
        mean = np.repeat(np.add.reduceat(f["a"] * da, f["starts"]), counts)
        de = f["a"] * (da - mean)
        dmix = de[:, None] * w["u"]
        dv = dmix * f["gate"] * (1 - f["value"] ** 2)
        dg = dmix * f["value"] * f["gate"] * (1 - f["gate"])
        dh = f["a"][:, None] * dz_each + dv @ w["V"].T + dg @ w["G"].T
        dx = dh * (1 - f["h"] ** 2)
        return {
            "c": f["z"].T @ slope, "d": slope.sum(), "u": (f["value"] * f["gate"]).T @ de, "V": f["h"].T @ dv, "G": f["h"].T @ dg,
            "W": f["x"].T @ dx, "b": dx.sum(axis=0),
        }


def fit(bags: list[np.ndarray], good: np.ndarray, hidden: int = 16, attention: int = 8, epochs: int = 40, rate: float = 0.01, decay: float = 1e-4) -> Model:
    """Adam on batches of 64 bags; both classes weigh the same up to the square root of their odds."""
    draw = np.random.default_rng(0)
    n = N_FEATURES
    shape = {"W": (n, hidden), "b": (hidden,), "V": (hidden, attention), "G": (hidden, attention), "u": (attention,), "c": (hidden,), "d": ()}
    weights = {k: draw.normal(0, 1 / np.sqrt(s[0]), s) if len(s) and k != "b" else np.zeros(s) for k, s in shape.items()}
    if not len(bags) or good.all() or not good.any():
        weights["c"] = np.zeros(hidden)
        return Model(np.zeros(n), np.ones(n), weights)
    every = np.concatenate(bags).astype(np.float64)
    model = Model(every.mean(axis=0), every.std(axis=0) + 0.05, weights)
    odds = np.sqrt(good.mean() / (1 - good.mean()))
    importance = np.where(good, 1.0, odds)
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = draw.permutation(len(bags))
        pace = rate * (1 - epoch / epochs) + 1e-4
        for at in range(0, len(order), 64):
            batch = order[at : at + 64]
            x = np.concatenate([bags[i] for i in batch]).astype(np.float64)
            counts = np.array([len(bags[i]) for i in batch])
            found = model.gradients(x, counts, good[batch].astype(np.float64), importance[batch])
            step += 1
            for k, g in found.items():
                g = g + decay * weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] = weights[k] - pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = SAMPLE) -> Model:
    """Fit on a bounded sample of ``labels``; its ids have a proven size and are broadcast."""
    sample = F.broadcast(sample_labels(labels, doc_id, label, per_class))
    texts = docs.select(F.col(doc_id).alias("doc_id"), utf8(text).alias("bytes")).join(sample, "doc_id").select("doc_id", "bytes", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes", 2 << 20):
            x, counts = features(batch.column("bytes").to_pylist())
            bags = []
            for end, n in zip(np.cumsum(counts).tolist(), counts.tolist()):
                bags.append(x[end - n : end].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(bags, pa.binary()), batch.column("label"), batch.column("doc_id").cast(pa.string())], names=["bag", "label", "doc_id"]
            )

    rows = texts.mapInArrow(run, "bag binary, label int, doc_id string").toPandas().sort_values(["doc_id", "label", "bag"])
    return fit([np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for b in rows["bag"]], rows["label"].to_numpy() == 1)


def score_texts(
    docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, attention: bool = False
) -> DataFrame:
    """(doc_id, score, predicted), and with ``attention`` the weight of each passage."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(doc_id).alias("doc_id"), utf8(text).alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes", 2 << 20):
            x, counts = features(batch.column("bytes").to_pylist())
            found = sent.value.forward(x, counts)
            columns = [batch.column("doc_id"), pa.array(found["p"]), pa.array((found["p"] >= threshold).astype(np.int32))]
            names = ["doc_id", "score", "predicted"]
            if attention:
                ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(found["a"])))
                names.append("attention")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, score double, predicted int" + ", attention array<double>" * attention)
