"""Severity of toxic language by cumulative-link ordinal regression.

Features are the words of a text and their first four and five characters
(word families), valued by log(1 + count). The model is
P(grade >= k) = sigmoid(w.x - t_k) with one weight vector for all ordered
thresholds t_1 < t_2 < ...; the score is the expected severity, the sum of
these probabilities. A document is toxic if P(grade >= 1) reaches the cut
that tells the labels of the sample apart best.

It is fitted on a bounded sample of labelled rows: ``PER_LABEL`` of each
label, those with the least hashes of their id. Its features are at most
``FEATURES``, those that tell the labels apart best and beyond chance.
Thresholds are moved by the share of each label among all labelled rows, since
the sample is balanced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from evalgrid.llm.common import blank, stored

#: Labelled rows per label that the fit reads at most.
PER_LABEL = 6000
#: Features of the model at most.
FEATURES = 2048
#: Grades: none, and mild, marked and severe by the number of telling words.
GRADE_FROM = (1, 3, 6)
#: Standard errors by which a feature's shares under the two labels differ at least.
MIN_Z = 4.0
_STEMS = (4, 5)
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str) -> Counter[str]:
    """Counts of words and of word families (a stem and an underscore)."""
    counts = Counter(_WORD.findall(text.lower()))
    for word, n in list(counts.items()):
        for k in _STEMS:
            if len(word) > k:
                counts[word[:k] + "_"] += n
    return counts


@dataclass
class Model:
    """Weights by feature, the ordered thresholds, and the cut."""

    weights: dict[str, float]
    thresholds: np.ndarray
    cut: float = 0.5  # P(grade >= 1) from which a document is toxic

    def exceed(self, text: str) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        known = self.weights
        score = 0.0
        counts = Counter(_WORD.findall(text.lower()))
        stems: Counter[str] = Counter()
        for word, n in counts.items():
            if word in known:
                score += known[word] * np.log1p(n)
            for k in _STEMS:
                if len(word) > k and (stem := word[:k] + "_") in known:
                    stems[stem] += n
        for stem, n in stems.items():
            score += known[stem] * np.log1p(n)
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -500, 500)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_ordinal(
    rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int, ridge: float = 1e-3, steps: int = 300
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by maximum likelihood, Adam steps on the whole sample.

    (rows, columns, values) are the sparse features. Thresholds are the first
    one and the logarithms of the gaps, so they stay in order.
    """
    top = int(grades.max(initial=1))
    w, b = np.zeros(n_features), np.concatenate([[0.0], np.zeros(top - 1)])
    m = v = np.zeros(n_features + top)
    n = max(1, len(grades))
    for step in range(1, steps + 1):
        gaps = np.exp(b[1:])
        t = b[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(rows, values * w[columns], minlength=len(grades))
        above = np.hstack([np.ones((len(grades), 1)), _sigmoid(score[:, None] - t), np.zeros((len(grades), 1))])
        slope = above * (1 - above)
        here = np.arange(len(grades))
        chance = np.maximum(above[here, grades] - above[here, grades + 1], 1e-12)
        d_score = (slope[here, grades] - slope[here, grades + 1]) / chance
        d_t = np.zeros((len(grades), top + 2))
        d_t[here, grades] -= slope[here, grades] / chance
        d_t[here, grades + 1] += slope[here, grades + 1] / chance
        by_t = d_t[:, 1 : top + 1].sum(axis=0) / n
        d_b = np.concatenate([[by_t.sum()], [by_t[k + 1 :].sum() * gaps[k] for k in range(top - 1)]])
        d_w = np.bincount(columns, values * d_score[rows], minlength=n_features) / n - ridge * w
        g = np.concatenate([d_w, d_b])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w + move[:n_features], b + move[n_features:]
    return w, b[0] + np.concatenate([[0.0], np.cumsum(np.exp(b[1:]))])


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t) for t in batch.column("text").to_pylist()]
        columns = [
            batch.column("row"),
            batch.column("toxic"),
            pa.array([list(f) for f in found], pa.list_(pa.string())),
            pa.array([list(f.values()) for f in found], pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["row", "toxic", "features", "counts"])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    per_label: int = PER_LABEL,
    n_features: int = FEATURES,
) -> Model:
    """Fit on at most ``2 * per_label`` labelled rows.

    Rows with a null id or label teach nothing. Without a labelled row of
    either kind, or without a telling feature, the model knows no word and
    calls nothing toxic.
    """
    known = labels.select(F.col(id).alias("id"), (F.col(label) > 0).alias("toxic")).dropna()
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return Model({}, np.array([50.0] * len(GRADE_FROM)))
    ordered = [known.where(F.col("toxic") == kind).orderBy(F.xxhash64("id"), "id").limit(per_label) for kind in (True, False)]
    chosen = stored(ordered[0].union(ordered[1]), "labelled")  # at most 2 * per_label rows of two small columns
    texts = docs.select(F.col(id).alias("id"), blank(F.col(text)).alias("text")).join(F.broadcast(chosen), "id")
    rows = texts.groupBy("id", "toxic").agg(F.min("text").alias("text"))  # repeated ids stay within the bound
    sample = rows.select(F.monotonically_increasing_id().alias("row"), "toxic", "text")
    sample = stored(sample.mapInArrow(_featurise, "row bigint, toxic boolean, features array<string>, counts array<bigint>"), "sample")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model({}, np.array([50.0] * len(GRADE_FROM)))
    n1, n0 = sizes[True], sizes[False]

    each = sample.select("toxic", F.explode("features").alias("feature")).groupBy("feature")
    seen = each.agg(F.sum(F.col("toxic").cast("int")).alias("c1"), F.sum((~F.col("toxic")).cast("int")).alias("c0")).where("c1 + c0 >= 3")
    gap = F.col("c1") / n1 - F.col("c0") / n0
    share = (F.col("c1") + F.col("c0")) / (n1 + n0)
    z = gap / F.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-9)
    odds = F.log((F.col("c1") + 0.5) / (n1 + 1)) - F.log((F.col("c0") + 0.5) / (n0 + 1))
    best = seen.select("feature", z.alias("z"), odds.alias("odds")).where(F.abs("z") >= MIN_Z).orderBy(F.abs("z").desc(), "feature").limit(n_features).collect()
    if not best:
        return Model({}, np.array([50.0] * len(GRADE_FROM)))
    index = {r["feature"]: k for k, r in enumerate(best)}
    telling = {r["feature"] for r in best if r["z"] > 0 and r["odds"] > 2 and not r["feature"].endswith("_")}

    wanted = sorted(index)
    slim = F.filter(F.arrays_zip("features", "counts"), lambda f: f["features"].isin(wanted))
    rows_at, columns, values, grades = [], [], [], []
    for at, r in enumerate(sample.select("toxic", slim.alias("f")).toLocalIterator()):
        hits = 0
        for f in r["f"]:
            rows_at.append(at)
            columns.append(index[f["features"]])
            values.append(np.log1p(f["counts"]))
            hits += f["counts"] if f["features"] in telling else 0
        grades.append(max(1, sum(hits >= least for least in GRADE_FROM)) if r["toxic"] else 0)
    grades_at = np.array(grades)
    w, t = fit_ordinal(np.array(rows_at, dtype=int), np.array(columns, dtype=int), np.array(values), grades_at, len(index))
    shift = np.log(n1 / n0) - np.log(total[True] / total[False])  # back to the shares of all labels
    thresholds = t + shift
    score = np.bincount(np.array(rows_at, dtype=int), np.array(values) * w[np.array(columns, dtype=int)], minlength=len(grades))
    place = best_cut(score - thresholds[0], grades_at > 0)
    cut = np.inf if np.isinf(place) else _sigmoid(place)
    return Model({f: float(w[k]) for f, k in index.items()}, thresholds, float(cut))


def best_cut(values: np.ndarray, positive: np.ndarray) -> float:
    """The value that divides the two kinds with the fewest errors.

    It lies midway between two different values, never among equal ones (to
    nine decimals), or is infinite where calling nothing positive has the
    fewest errors; of equally good places it is the one with the widest gap.
    """
    levels, at = np.unique(np.round(values, 9), return_inverse=True)
    hits = np.bincount(at, positive, minlength=len(levels))
    misses = np.bincount(at, ~positive, minlength=len(levels))
    errors = np.cumsum(hits) + np.append(misses[::-1].cumsum()[::-1][1:], 0)  # cuts above each level
    gaps = np.append(np.diff(levels), 0)
    best = np.lexsort((-gaps, errors))[0]
    return np.inf if best == len(levels) - 1 else (levels[best] + levels[best + 1]) / 2


def exceedances(model: Model):
    """A column function: array of P(grade >= k) of a text column."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([model.exceed(t).tolist() for t in texts])

    return run


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``id``, severity, p_toxic, toxic) of every row.

    Null and empty texts have no feature; they score as the thresholds say.
    Only the two columns are read, repeated rows each come out.
    """
    chances = docs.select(F.col(id).alias(id), exceedances(model)(blank(F.col(text))).alias("p"))
    return chances.select(
        id, F.aggregate("p", F.lit(0.0), lambda a, x: a + x).alias("severity"), F.col("p")[0].alias("p_toxic"), (F.col("p")[0] >= model.cut).alias("toxic")
    )


def reject(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    return docs.where(exceedances(model)(blank(F.col(text)))[0] < model.cut)
