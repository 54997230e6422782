"""Languages of a text as a mixture, inferred by expectation-maximisation.

Training counts hashed character trigrams per language over all documents
whose language is known. A text is a mixture of those languages: its n-grams
come from language l with proportion p_l, and EM finds the proportions. The
set of languages is chosen by penalised likelihood: the smallest proportion
leaves, and the smaller set stays if the likelihood lost is less than the
penalty saved.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrid.llm.common import blank

#: Buckets of hashed trigrams; with the languages the size of the model.
BUCKETS = 1 << 14
#: Added to every count.
SMOOTHING = 0.5
#: Penalty of one more language, in units of log(n-grams).
PENALTY = 3.0
#: A proportion below this leaves the set without a test.
LEAST_SHARE = 0.01
#: What a text without letters, or without a known language, is called (fixed value).
UNDETERMINED = "und"
_OTHER = re.compile(r"[\W\d_]+")
_STEPS, _SETTLED = 40, 1e-4


def grams(text: str) -> np.ndarray:
    """Buckets of the trigrams of the words, each word between blanks."""
    plain = f" {_OTHER.sub(' ', text.lower()).strip()} "
    codes = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if len(codes) < 3:
        return np.zeros(0, dtype=np.int64)
    mixed = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    return (mixed & np.uint32(BUCKETS - 1)).astype(np.int64)


@dataclass
class Model:
    """Languages and P(bucket | language), one column each."""

    languages: list[str]
    chances: np.ndarray


def mixture(chances: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions and log likelihood of ``counts`` under the columns of ``chances``."""
    k, total = chances.shape[1], counts.sum()
    share = np.full(k, 1.0 / k)
    for _ in range(_STEPS):
        fresh = share * (chances.T @ (counts / (chances @ share))) / total
        moved = np.abs(fresh - share).max()
        share = fresh
        if moved < _SETTLED:
            break
    return share, float(counts @ np.log(chances @ share))


def infer(model: Model, text: str) -> list[tuple[str, float]]:
    """(language, proportion) of a text, largest first; empty if undetermined."""
    if not model.languages or not any(map(str.isalpha, text)):
        return []
    tally = np.bincount(grams(text), minlength=BUCKETS)
    here = np.flatnonzero(tally)
    if not len(here):
        return []
    counts, table = tally[here].astype(float), model.chances[here]
    penalty = PENALTY * np.log(counts.sum() + 1)
    chosen = np.arange(len(model.languages))
    share, likelihood = mixture(table, counts)
    while len(chosen) > 1:
        large = share >= LEAST_SHARE
        if large.all():
            large[np.argmin(share)] = False
            fewer, less = mixture(table[:, large], counts)
            if likelihood - less > penalty:
                break
        else:
            fewer, less = mixture(table[:, large], counts)
        chosen, table, share, likelihood = chosen[large], table[:, large], fewer, less
    return sorted(((model.languages[c], float(s)) for c, s in zip(chosen, share)), key=lambda x: (-x[1], x[0]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS, dtype=np.int64))
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            totals[lang] += np.bincount(grams(text), minlength=BUCKETS)
    for lang, counts in totals.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(counts[at])], ["lang", "bucket", "n"])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Count over all rows with a language; the rows to learn from are the caller's.

    Each task sums what it reads and the sums are added up by key. The driver
    gets the model: ``BUCKETS`` numbers for each language. Null texts and
    languages teach nothing.
    """
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).dropna()
    sums = rows.mapInArrow(_count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.toArrow().to_pandas()
    languages = sorted(found["lang"].unique())
    counts = np.full((BUCKETS, len(languages)), SMOOTHING)
    counts[found["bucket"], np.searchsorted(languages, found["lang"])] += found["n"]
    return Model(languages, counts / counts.sum(axis=0))


def _predictor(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [infer(model, t) for t in batch.column("text").to_pylist()]
            columns = [
                batch.column("id"),
                pa.array([f[0][0] if f else UNDETERMINED for f in found], pa.string()),
                pa.array([min(1.0, f[0][1]) if f else 0.0 for f in found], pa.float64()),
                pa.array([",".join(f"{lang}:{share:.4f}" for lang, share in f) for f in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "lang_pred", "score", "languages"])

    return run


def predict(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``id``, lang_pred, score, languages) of every row.

    ``lang_pred`` has the largest proportion, which is the score; ``languages``
    lists the chosen set with proportions. Null and letterless texts, and all
    texts if nothing was learned, are ``und`` with score 0. Ties go to the
    first name.
    """
    rows = docs.select(F.col(id).alias("id"), blank(F.col(text)).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_predictor(model), f"id {kind}, lang_pred string, score double, languages string")
    return out.withColumnRenamed("id", id)


def fold(id: Column, folds: int) -> Column:
    """Remainder of the CRC-32 of an id as text; null for a null id."""
    return F.crc32(id.cast("string").cast("binary")) % folds
