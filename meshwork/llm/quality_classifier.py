"""Quality classifier: a regularised quadratic discriminant over transformed statistics of a text.

Each text becomes a short vector of counts and shares, brought near to normal by logs.  Each class has a mean and a
covariance, shrunk towards the pooled covariance and its diagonal; the score is the logistic of the difference of the
log densities, whose Mahalanobis terms come from Cholesky factors that are computed once.

All labelled rows that ``train`` selects are used: tasks add up sums and products, and only those (a few hundred
numbers) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as k
from .shared import checkpoint, small_batches

THRESHOLD = 0.7


def _table(*members: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[x for m in members for x in m]] = True
    return t


_UPPER = _table(bytes(range(0x41, 0x5B)))
_LETTER = _table(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)), bytes(range(0x80, 0x100)))
_DIGIT = _table(b"0123456789")
_SYMBOL = _table(b"#*$%&|<>@^~_=+{}[]\\/")
_LOUD = _table(b"!?")
_STOP = _table(b".,;:")

FEATURES = ("length", "word_length", "word_spread", "upper", "digits", "symbols", "loud", "stops", "spaces", "lines", "doubled", "distinct", "distinct_windows", "capital_words")


def statistics(s: k.Slice) -> np.ndarray:
    """One row of FEATURES for each text of a slice; an empty text has a fixed row."""
    n = np.maximum(np.diff(s.offsets), 1).astype(float)
    share = lambda table: np.log(k.sums(table[s.data], s.offsets) / n + 1e-3)
    w = k.words(s, k.NOT_SPACE)
    words = np.maximum(w.counts, 1).astype(float)
    size = (w.ends - w.starts).astype(float)
    mean = np.bincount(w.row, size, s.rows) / words
    spread = np.sqrt(np.maximum(np.bincount(w.row, size**2, s.rows) / words - mean**2, 0))
    doubled = np.bincount(w.row[1:][(w.hashes[1:] == w.hashes[:-1]) & (w.row[1:] == w.row[:-1])], minlength=s.rows) if len(w.row) else np.zeros(s.rows)
    salt = k.mix(np.arange(s.rows, dtype=np.uint64) + np.uint64(7))
    count = lambda keys, row: np.bincount(row[np.unique(keys, return_index=True)[1]], minlength=s.rows)
    pairs, at = k.window_hashes(w, 2)
    capital = np.bincount(w.row[_UPPER[s.data[w.starts]]], minlength=s.rows) if len(w.row) else np.zeros(s.rows)
    newline = k.sums(s.data == 0x0A, s.offsets)
    letters = k.sums(_LETTER[s.data], s.offsets) / n
    return np.column_stack([
        np.log1p(w.counts), np.log1p(mean), np.log1p(spread), share(_UPPER), share(_DIGIT), share(_SYMBOL), share(_LOUD), share(_STOP), np.log(letters + 0.02),
        np.log((newline + 1) / words), np.log(doubled / words + 1e-3), np.log(count(w.hashes ^ salt[w.row], w.row) / words + 1e-2),
        np.log((count(pairs ^ salt[w.row[at]], w.row[at]) + 1) / words + 1e-2), np.log(capital / words + 1e-2),
    ])


@dataclass
class Model:
    """What scoring needs of each class: mean, inverse of the Cholesky factor, and the constant of the log density."""

    means: list[np.ndarray]
    inverses: list[np.ndarray]
    constants: list[float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if len(self.means) < 2:
            return np.full(len(x), self.constants[0])
        low, high = (c - 0.5 * (((x - m) @ i.T) ** 2).sum(axis=1) for m, i, c in zip(self.means, self.inverses, self.constants, strict=True))
        return 1 / (1 + np.exp(np.clip(low - high, -700, 700)))


def fit(sums: dict[int, np.ndarray], shrink: float, ridge: float) -> Model:
    """sums: by class, the number of rows, the sum of the vectors and the sum of their outer products, in one array."""
    d = len(FEATURES)
    seen = {c: s for c in (0, 1) if (s := sums.get(c)) is not None and s[0] > 0}
    if len(seen) < 2:  # nothing to tell apart: the score is the only class there is, or a half
        return Model([], [], [float([*seen][0]) if seen else 0.5])
    n = {c: s[0] for c, s in seen.items()}
    mean = {c: s[1 : d + 1] / n[c] for c, s in seen.items()}
    cov = {c: s[d + 1 :].reshape(d, d) / n[c] - np.outer(mean[c], mean[c]) for c, s in seen.items()}
    pooled = sum(n[c] * cov[c] for c in seen) / sum(n.values())
    means, inverses, constants = [], [], []
    for c in (0, 1):
        keep = n[c] / (n[c] + shrink)  # the fewer rows, the more of the pooled covariance
        s = keep * cov[c] + (1 - keep) * pooled
        s = (1 - ridge) * s + ridge * np.diag(np.diag(pooled) + 1e-3)
        factor = np.linalg.cholesky(s)
        means.append(mean[c])
        inverses.append(np.linalg.inv(factor))
        constants.append(float(np.log(n[c] / sum(n.values())) - np.log(np.diag(factor)).sum()))
    return Model(means, inverses, constants)


def _vectors(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in k.slices(b.column(b.schema.get_field_index("__text"))):
                x = statistics(s)
                part = b.slice(s.first, s.rows)
                vector = pa.ListArray.from_arrays(pa.array(np.arange(s.rows + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in names), vector], [*names, "__x"])

    return run


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, len(FEATURES))


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(FEATURES)
    total = np.zeros((2, 1 + d + d * d))
    for b in batches:
        x, y = _matrix(b.column(0), b.num_rows), b.column(1).to_numpy()
        for c in (0, 1):
            z = x[y == c]
            total[c] += np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])
    yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["c", "s"])


def train_model(vectors: DataFrame, labels: DataFrame, key: str, label: str, train: Column, shrink: float, ridge: float) -> Model:
    marked = labels.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__y")).filter(train & F.col("__y").isin(0, 1)).distinct()
    rows = vectors.join(marked, F.col(key) == F.col("__key")).select("__x", "__y")
    parts = rows.mapInArrow(k.task(_add_up), "c int, s array<double>").select("c", F.posexplode("s").alias("i", "v"))
    sums: dict[int, np.ndarray] = {}
    for r in parts.groupBy("c", "i").agg(F.sum("v").alias("v")).collect():  # two classes of a few hundred numbers
        sums.setdefault(r.c, np.zeros(1 + len(FEATURES) + len(FEATURES) ** 2))[r.i] = r.v
    return fit(sums, shrink, ridge)


def quality_scores(docs: DataFrame, labels: DataFrame, train: Column | None = None, text: str = "text", key: str = "doc_id", label: str = "quality", shrink: float = 50.0, ridge: float = 0.02, threshold: float = THRESHOLD) -> DataFrame:
    """key, score (0 to 1; higher: class 1 likelier) and predicted (1 if score >= threshold) for each row of docs.

    ``train`` selects the rows of labels to learn from (a condition on ``__key``); rows whose label is not 0 or 1, or whose
    key is null, teach nothing, and a label that is given twice teaches once (two different labels of a key teach both classes).  A score depends on the text alone: null counts as empty, an empty text has a score like
    any other, repeated rows score alike.  With labels of one class only, or none, all scores are that class, or 0.5.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    vectors = checkpoint(docs.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(k.task(_vectors([key])), f"`{key}` {kind}, __x array<double>"))
    model = train_model(vectors, labels, key, label, F.lit(True) if train is None else train, shrink, ridge)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = model.scores(_matrix(b.column(1), b.num_rows))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [key, "score", "predicted"])

    return vectors.mapInArrow(k.task(score), f"`{key}` {kind}, score double, predicted int")
