"""Toxicity as ordered severity: a cumulative-link regression on sparse text features.

Grades 0 to ``GRADES`` share one weight vector and differ only in ordered thresholds:
``P(grade > k) = sigmoid(w.x - t_k)``; the expected severity is the sum of these over all thresholds. Features are
the words of a text and their beginnings of four to six bytes, hashed into ``2**BITS`` places; each distinct word of a
text counts once. A text's score is thus a sum over its distinct words, which tasks keep per word.

The labels given here only say toxic or not, so :func:`graded` splits the toxic training texts at the thirds of how
many hostile words they hold (words that occur in three training texts or more, nine tenths of them toxic).

The model is fitted on at most ``SAMPLE`` labelled texts of each class, chosen by a hash of the id; only their hashed
features reach the driver. Everything else covers all texts.

Defined cases: a null text is empty; a text without words has no evidence and is clean; repeated rows each
get their score; a label without a text is ignored; with labels of one class only, or none, all texts are clean.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import slices, utf8, words

GRADES = 3
BITS = 20
#: labelled texts of each class that the model is fitted on, at most
SAMPLE = 2500
#: a text is toxic if the probability of a grade over 0 is at least this
THRESHOLD = 0.5

#: the first threshold stays above zero, so that a text without evidence is clean
LEAST_THRESHOLD = 1.0

_STEMS = (4, 5, 6)
#: words whose scores a task keeps
_KEPT_WORDS = 400_000


def places(word: bytes) -> list[int]:
    """Hashed features of a word."""
    mask = (1 << BITS) - 1
    return [zlib.crc32(word) & mask, *[zlib.crc32(word[:n], n) & mask for n in _STEMS if len(word) > n]]


@dataclass
class Severity:
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) of each score, one column for each threshold."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -500, 500)))


def graded(documents: list[np.ndarray], hostile_in: np.ndarray, toxic: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """Grade 0 for clean texts; 1 to ``grades`` for toxic ones, at equal shares of their counts of hostile features."""
    counts = np.array([hostile_in[d].sum() for d in documents], np.float64)
    out = np.zeros(len(documents), np.int64)
    if toxic.any():
        edges = np.quantile(counts[toxic], np.arange(1, grades) / grades)
        out[toxic] = 1 + np.searchsorted(edges, counts[toxic], side="left")
    return out


def fit(documents: list[np.ndarray], toxic: np.ndarray, grades: int = GRADES, epochs: int = 25, rate: float = 0.3, l1: float = 3e-3) -> Severity:
    """Weights and thresholds by AdaGrad in small batches; the L1 step keeps weights without evidence at zero."""
    size = 1 << BITS
    model = Severity(np.zeros(size), np.full(grades, 50.0))
    if not len(documents) or toxic.all() or not toxic.any():
        return model
    inside = [np.unique(d) for d in documents]
    both = np.bincount(np.concatenate(inside), minlength=size)
    bad = np.bincount(np.concatenate([d for d, t in zip(inside, toxic) if t]), minlength=size)
    grade = graded(inside, (both >= 3) & (bad >= 0.9 * both), toxic, grades)
    w, t = model.weights, 1.0 + np.arange(grades, dtype=np.float64)
    w_sum, t_sum = np.full(size, 1e-8), np.full(grades, 1e-8)
    draw = np.random.default_rng(0)
    for epoch in range(epochs):
        order = draw.permutation(len(documents))
        step = rate / (1 + epoch / 8)
        for at in range(0, len(order), 64):
            batch = order[at : at + 64]
            rows = np.repeat(np.arange(len(batch)), [len(documents[i]) for i in batch])
            cols = np.concatenate([documents[i] for i in batch]) if len(rows) else np.zeros(0, np.int64)
            score = np.bincount(rows, w[cols], minlength=len(batch))
            y = grade[batch]
            edge = np.concatenate(([-np.inf], t, [np.inf]))
            a = 1 / (1 + np.exp(-np.clip(score - edge[y], -500, 500)))
            b = 1 / (1 + np.exp(-np.clip(score - edge[y + 1], -500, 500)))
            inner = np.maximum(a - b, 1e-9)
            slope = (a + b - 1) / len(batch)
            used, back = np.unique(cols, return_inverse=True)
            gradient = np.bincount(back, slope[rows], minlength=len(used))
            w_sum[used] += gradient**2
            pace = step / np.sqrt(w_sum[used])
            moved = w[used] - pace * gradient
            w[used] = np.sign(moved) * np.maximum(np.abs(moved) - pace * l1, 0)
            pull = np.zeros(grades + 2)
            np.add.at(pull, y, a * (1 - a) / inner / len(batch))
            np.add.at(pull, y + 1, -b * (1 - b) / inner / len(batch))
            t_sum += pull[1:-1] ** 2
            t -= step / np.sqrt(t_sum) * pull[1:-1]
            t[0] = max(t[0], LEAST_THRESHOLD)
            for k in range(1, grades):
                t[k] = max(t[k], t[k - 1] + 1e-3)
    return Severity(w, t)


def sample_labels(labels: DataFrame, doc_id: str, label: str, per_class: int) -> DataFrame:
    """At most ``per_class`` rows of each class, by a hash of the id."""
    rows = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).dropna().distinct()
    one, zero = [
        rows.filter(F.col("label") == c).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(per_class) for c in (1, 0)
    ]
    return one.unionAll(zero)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = SAMPLE) -> Severity:
    """Fit on the labelled texts of a bounded sample; the sample's ids have a proven size and are broadcast."""
    sample = F.broadcast(sample_labels(labels, doc_id, label, per_class))
    texts = docs.select(F.col(doc_id).alias("doc_id"), utf8(text).alias("bytes")).join(sample, "doc_id").select("doc_id", "bytes", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes"):
            found = [np.array([p for w in set(words(t)) for p in places(w)], np.int32) for t in batch.column("bytes").to_pylist()]
            # a hash of the features orders the rows, so that the fit doesn't depend on how they were dealt
            yield pa.RecordBatch.from_arrays(
                [pa.array([np.sort(f).tobytes() for f in found], pa.binary()), batch.column("label"), batch.column("doc_id").cast(pa.string())],
                names=["features", "label", "doc_id"],
            )

    rows = texts.mapInArrow(run, "features binary, label int, doc_id string").toPandas()
    rows = rows.sort_values(["doc_id", "label", "features"])
    return fit([np.frombuffer(f, np.int32) for f in rows["features"]], rows["label"].to_numpy() == 1)


def _scorer(model: Severity):
    weights = model.weights

    class Scores(dict):
        def __missing__(self, word: bytes) -> float:
            if len(self) >= _KEPT_WORDS:
                self.clear()
            value = self[word] = float(sum(weights[p] for p in places(word)))
            return value

    kept = Scores()

    def score(text: bytes) -> float:
        # in order of the words, so that sums agree between runs
        return sum(filter(None, map(kept.__getitem__, sorted(set(words(text))))))

    return score


def score_texts(docs: DataFrame, model: Severity, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, severity, grade, score, predicted, toxic): expected severity, likeliest grade, P(grade > 0), and whether it reaches the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(Severity(model.weights.astype(np.float32), model.thresholds))
    source = docs.select(F.col(doc_id).alias("doc_id"), utf8(text).alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(sent.value)
        for batch in slices(batches, "bytes"):
            above = sent.value.above(np.array([score(t) for t in batch.column("bytes").to_pylist()]))
            at_least = np.hstack((np.ones((len(above), 1)), above, np.zeros((len(above), 1))))
            grade = (at_least[:, :-1] - at_least[:, 1:]).argmax(axis=1)
            toxic = above[:, 0] >= threshold
            columns = [above.sum(axis=1), grade.astype(np.int32), above[:, 0], toxic.astype(np.int32), toxic]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, columns)], names=["doc_id", "severity", "grade", "score", "predicted", "toxic"]
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, severity double, grade int, score double, predicted int, toxic boolean")


def drop_toxic(docs: DataFrame, model: Severity, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without its toxic rows; columns and other rows untouched."""
    sent = docs.sparkSession.sparkContext.broadcast(Severity(model.weights.astype(np.float32), model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(sent.value)
        for batch in slices(batches, text):
            texts = ((t or "").encode("utf-8", "surrogatepass") for t in batch.column(text).to_pylist())
            clean = sent.value.above(np.array([score(t) for t in texts]))[:, 0] < threshold
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
