"""Quality scores by regularised quadratic discriminant analysis.

A document becomes a few transformed statistics. Each class has its mean and
a covariance shrunk towards the pooled variances, whose Cholesky factor is
computed once. The difference of the classes' log densities, from squared
Mahalanobis distances, is turned into a probability by a logistic curve fitted
to a histogram of the training differences.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from evalgrid.llm.common import blank, stored

#: Weight of the pooled variances in a class covariance.
SHRINKAGE = 0.2
#: Weight of the unit matrix, which keeps constant statistics harmless.
FLOOR = 0.05
#: Bins of the histogram of differences, and its ends.
BINS, REACH = 400, 60.0
N_STATISTICS = 12
_SYMBOLS = "#*$%&|<>"
_UPPER, _LOWER = string.ascii_uppercase.encode(), string.ascii_lowercase.encode()
_DIGITS, _ENDS = string.digits.encode(), ".!?"


def statistics(text: str) -> list[float]:
    """Transformed statistics; all zero for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * N_STATISTICS
    data = text.encode()
    size = len(data)
    upper = size - len(data.translate(None, _UPPER))
    lower = size - len(data.translate(None, _LOWER))
    digits = size - len(data.translate(None, _DIGITS))
    counts = Counter(words)
    lines = [line for line in text.split("\n") if line.strip()]
    ratio = np.array(
        [
            sum(map(text.count, _SYMBOLS)) / n,
            text.count("!") / n,
            text.count("|") / n,
            upper / (upper + lower + 1),
            digits / size,
            sum(map(eq, words, words[1:])) / n,
            max(counts.values()) / n,
            1 - len(set(lines)) / len(lines),
            sum(map(text.count, _ENDS)) / n,
        ]
    )
    spread = [np.log(len(counts)) / np.log(n) if n > 1 else 1.0, np.log(size / n), np.log1p(n) / 10]
    return [*np.arcsinh(10 * ratio).tolist(), *map(float, spread)]


@dataclass
class Model:
    """Means, inverse Cholesky factors and log determinants by class, and the curve."""

    means: np.ndarray
    inverse: np.ndarray
    logdet: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 minus that of class 0 for the rows of ``x``."""
        logs = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.inverse[k].T
            logs.append(-0.5 * (z * z).sum(axis=1) - self.logdet[k])
        return logs[1] - logs[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        d = np.clip(self.difference(x), -REACH, REACH)
        return 1 / (1 + np.exp(-np.clip(self.slope * d + self.offset, -500, 500)))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.list_(pa.float64()))], ["id", "x"])


def describe(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, x): the statistics of every row, written once; null texts as empty."""
    rows = docs.select(F.col(id).alias("id"), blank(F.col(text)).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return stored(rows.mapInArrow(_describe, f"id {kind}, x array<double>"), "statistics")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = 1 + N_STATISTICS + N_STATISTICS**2
    sums = {0: np.zeros(size), 1: np.zeros(size)}
    for batch in batches:
        y = np.array(batch.column("y").to_pylist(), dtype=int)
        x = np.array(batch.column("x").to_pylist(), dtype=float).reshape(-1, N_STATISTICS)
        for k in sums:
            own = x[y == k]
            sums[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
    yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()])], ["y", "sums"])


def _histogram(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BINS), dtype=np.int64)
        for batch in batches:
            y = np.array(batch.column("y").to_pylist(), dtype=int)
            x = np.array(batch.column("x").to_pylist(), dtype=float).reshape(-1, N_STATISTICS)
            at = np.clip((model.difference(x) + REACH) * BINS / (2 * REACH), 0, BINS - 1).astype(int)
            np.add.at(sums, (y, at), 1)
        y, at = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(at), pa.array(sums[y, at])], ["y", "bin", "n"])

    return run


def _curve(counts: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of class 1 over the bins, by Newton steps.

    Targets are drawn in by one pseudo-row for each class, so separated
    classes give a finite slope.
    """
    n0, n1 = counts.sum(axis=1)
    d = (np.arange(BINS) + 0.5) * (2 * REACH / BINS) - REACH
    high, low = (n1 + 1) / (n1 + 2), 1 / (n0 + 2)
    weight, hits = counts.sum(axis=0), counts[1] * high + counts[0] * low
    slope, offset = 0.1, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * d + offset, -500, 500)))
        g = np.array([((hits - weight * p) * d).sum(), (hits - weight * p).sum()])
        v = weight * p * (1 - p) + 1e-12
        h = np.array([[(v * d * d).sum() + 1e-6, (v * d).sum()], [(v * d).sum(), v.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        slope, offset = slope + move[0], offset + move[1]
        if np.abs(move).max() < 1e-8:
            break
    return float(slope), float(offset)


def fit(described: DataFrame, labels: DataFrame, id: str = "doc_id", label: str = "quality") -> Model | None:
    """Fit on all rows of ``described`` that ``labels`` (``id``, ``label`` 0 or 1) names.

    Tasks send moments and histogram counts, whose size does not depend on the
    rows. Null ids and labels teach nothing; an id with several rows counts
    with each. Without rows of both classes there is no model.
    """
    known = labels.select(F.col(id).alias("id"), (F.col(label) > 0).cast("int").alias("y")).dropna()
    rows = stored(described.join(known, "id").select("y", "x"), "training")
    parts = rows.mapInArrow(_moments, "y bigint, sums array<double>")
    each = parts.select("y", F.posexplode("sums").alias("at", "v")).groupBy("y", "at").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros((2, 1 + N_STATISTICS + N_STATISTICS**2))
    for r in each:
        sums[r["y"], r["at"]] = r["v"]
    n = sums[:, 0]
    if n.min() < 1:
        return None
    means = sums[:, 1 : 1 + N_STATISTICS] / n[:, None]
    second = sums[:, 1 + N_STATISTICS :].reshape(2, N_STATISTICS, N_STATISTICS) / n[:, None, None]
    own = second - means[:, :, None] * means[:, None, :]
    mean = (n[:, None] * means).sum(axis=0) / n.sum()
    pooled = np.diag(np.maximum(np.diag((n[:, None, None] * second).sum(axis=0) / n.sum()) - mean**2, 0))
    inverse, logdet = [], []
    for k in (0, 1):
        shrunk = (1 - SHRINKAGE) * own[k] + SHRINKAGE * pooled + FLOOR**2 * np.eye(N_STATISTICS)
        factor = np.linalg.cholesky(shrunk)
        inverse.append(np.linalg.inv(factor))
        logdet.append(np.log(np.diag(factor)).sum())
    model = Model(means, np.array(inverse), np.array(logdet))
    counts = np.zeros((2, BINS))
    for r in rows.mapInArrow(_histogram(model), "y bigint, bin bigint, n bigint").groupBy("y", "bin").agg(F.sum("n").alias("n")).collect():
        counts[r["y"], r["bin"]] = r["n"]
    model.slope, model.offset = _curve(counts)
    return model


def score(described: DataFrame, model: Model | None, id: str = "doc_id") -> DataFrame:
    """(``id``, score) of every row, between 0 and 1; 0.5 without a model."""

    @F.pandas_udf(DoubleType())
    def scored(xs: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series([0.5] * len(xs))
        return pd.Series(model.score(np.array(xs.tolist(), dtype=float).reshape(-1, N_STATISTICS)))

    return described.select(F.col("id").alias(id), scored("x").alias("score"))
