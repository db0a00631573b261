"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Random cosines approximate a Gaussian kernel over the standardised statistics. Partitions sum their
part of the normal equations, whose size does not depend on the data, and the driver solves them.
The fitted values of the training rows are counted in a fixed number of bins, on which pool
adjacent violators gives the calibration.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import keep, tidy

FEATURES = 256
BINS = 2048
LOW, HIGH = -0.5, 1.5
_LETTERS = bytes(c for c in range(128) if chr(c).isalpha()) + bytes(range(128, 256))
_UPPER, _DIGITS, _SPACE = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c"
_STOPS, _REST = b".,;:!?", bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in b".,;:!?'\"-()")


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a text; zeros for one without words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * STATISTICS
    n, k = len(data), len(words)
    share = lambda chars: (n - len(data.translate(None, chars))) / n
    lengths = np.fromiter(map(len, words), np.int64, k)
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    line_counts = Counter(lines)
    repeated = sum(len(x) * (c - 1) for x, c in line_counts.items())
    pairs = len(set(zip(words, words[1:])))
    top = counts.most_common(3)
    stops = n - len(data.translate(None, b".!?"))
    return [
        math.log1p(n),
        math.log1p(k),
        float(lengths.mean()),
        float(lengths.std()),
        float(min(lengths.max(), 100)),
        share(_LETTERS),
        share(_UPPER),
        share(_DIGITS),
        share(_SPACE),
        share(_STOPS),
        share(_REST),
        len(counts) / k,
        math.log(len(counts)) / math.log(k + 1),
        top[0][1] / k,
        sum(c for _, c in top) / k,
        pairs / max(1, k - 1),
        math.log1p(len(lines)),
        len(line_counts) / len(lines),
        repeated / n,
        math.log1p(n / len(lines)),
        math.log1p(k / (stops + 1)),
        float((lengths <= 3).mean()),
        len(zlib.compress(data, 1)) / (n + 32),
        sum(x[:1].isupper() for x in words) / k,
    ]


STATISTICS = 24


def with_statistics(documents: DataFrame) -> DataFrame:
    """(doc_id, stats) of documents(doc_id, text, ...)."""
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))

    @tidy
    def scan(batches):
        for batch in batches:
            stats = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.list_(pa.float64()))], names=["doc_id", "stats"])

    return rows.mapInArrow(scan, f"doc_id {dict(rows.dtypes)['doc_id']}, stats array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)


#: Sums that are added up in one place: of tasks in a group, of groups on the driver.
FAN_IN = (1024, 16)


def _summed(rows: DataFrame, part, size: int) -> np.ndarray:
    """The sum over all batches of part(batch), an array of fixed size: summed in each task, then in two levels of groups, then here.

    Sums of whole numbers are exact; others are added in the tasks' order, so that the same partitions give the same sum.
    """

    def local(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(batch)
        if total.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())],
                names=["g", "data"]
            )

    def group(table: pa.Table) -> pa.Table:
        total = np.zeros(size)
        for _, i in sorted(zip(table.column("g").to_pylist(), range(table.num_rows))):
            total += np.frombuffer(table.column("data")[i].as_py(), np.float64)
        return pa.table({"g": pa.array([min(table.column("g").to_pylist())], pa.int64()), "data": pa.array([total.tobytes()], pa.binary())})

    sums = rows.mapInArrow(local, "g long, data binary")
    for groups in FAN_IN:
        sums = sums.groupBy((F.col("g") % groups).alias("to")).applyInArrow(group, "g long, data binary")
    total = np.zeros(size)
    for r in sorted(sums.collect(), key=lambda r: r["g"]):
        total += np.frombuffer(r["data"], np.float64)
    return total


def pool_adjacent_violators(sums: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing fit to sums / weights with these weights, by bin; bins without weight follow their left neighbour."""
    blocks: list[list[float]] = []  # sum, weight, bins
    for s, w in zip(sums, weights):
        blocks.append([s, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, w2, n2 = blocks.pop()
            blocks[-1][0] += s2
            blocks[-1][1] += w2
            blocks[-1][2] += n2
    return np.concatenate([[s / w if w else 0.0] * n for s, w, n in blocks]) if blocks else np.zeros(0)


class QualityModel:
    """What scoring needs: a few arrays of fixed size."""

    def __init__(self, mean, scale, directions, phases, weights, steps):
        self.mean, self.scale, self.directions, self.phases, self.weights, self.steps = mean, scale, directions, phases, weights, steps

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.sqrt(2 / len(self.phases)) * np.cos(x @ self.directions + self.phases), np.ones((len(x), 1))], 1)

    def bins(self, stats: np.ndarray) -> np.ndarray:
        raw = self.features(stats) @ self.weights
        return np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int64)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return self.steps[self.bins(stats)]


def fit(rows: DataFrame, label: str, features: int = FEATURES, width: float = 5.0, ridge: float = 1e-4, seed: int = 7) -> QualityModel:
    """Fit to rows(stats, label); rows with a null label teach nothing. Without any row all scores are 0.5."""
    train = rows.where(F.col(label).isNotNull()).select("stats", F.col(label).cast("double").alias("y"))
    d = STATISTICS

    def moments(batch):
        x = _matrix(batch.column(0))
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    m = _summed(train, moments, 1 + 2 * d)
    n = max(m[0], 1)
    mean = m[1 : d + 1] / n
    scale = np.sqrt(np.maximum(m[d + 1 :] / n - mean**2, 0))
    scale[scale < 1e-9] = 1
    rng = np.random.default_rng(seed)
    model = QualityModel(mean, scale, rng.normal(0, 1 / width, (d, features)), rng.uniform(0, 2 * np.pi, features), None, None)
    size = features + 1

    def equations(batch):
        z, y = model.features(_matrix(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    e = _summed(train, equations, size * size + size)
    gram = e[: size * size].reshape(size, size) + n * ridge * np.diag([*[1.0] * features, 1e-9])
    model.weights = np.linalg.lstsq(gram, e[size * size :], rcond=None)[0] if m[0] else np.zeros(size)

    def histogram(batch):
        at = model.bins(_matrix(batch.column(0)))
        return np.concatenate([
            np.bincount(at, minlength=BINS), np.bincount(at, batch.column(1).to_numpy(zero_copy_only=False), minlength=BINS)
        ])

    h = _summed(train, histogram, 2 * BINS) if m[0] else np.ones(2 * BINS) * 0.5
    model.steps = np.clip(pool_adjacent_violators(h[BINS:], h[:BINS]), 0, 1) if m[0] else np.full(BINS, 0.5)
    return model


def scored(documents: DataFrame, labels: DataFrame, label: str, learn: Column) -> DataFrame:
    """(doc_id, score) of documents(doc_id, text, ...), learned from labels(doc_id, label, ...) where learn holds.

    Null or empty texts have statistics of zero and get a score like any other. A doc_id that
    is null or that no label has is scored all the same; every matching label row teaches once. Repeated
    documents get equal scores. Statistics are computed once and kept in the shared folder.
    """
    stats = keep(with_statistics(documents), "quality-stats")
    known = labels.where(learn).select("doc_id", F.col(label).alias("label"))
    model = fit(keep(stats.join(known.where("label is not null"), "doc_id").select("stats", "label"), "quality-train"), "label")

    def score(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.score(_matrix(batch.column(1))), pa.float64())], names=["doc_id", "score"]
            )

    return stats.mapInArrow(score, f"doc_id {dict(stats.dtypes)['doc_id']}, score double")
