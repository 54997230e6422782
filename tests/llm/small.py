"""Small tables and plain references for the tests of the operators."""

from __future__ import annotations

import numpy as np

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns that a table may have besides, with names the operators use inside.
EXTRA = ("fp", "row", "ids", "spans", "weight", "bin", "tokens", "hash", "p", "x", "part", "mark", "toxic", "probability", "fingerprint")


def docs_table(spark, rows, extra=False):
    """Documents from (doc_id, text[, lang[, source]]) rows, with clashing columns if asked."""
    full = []
    for doc_id, text, *rest in rows:
        lang, source = (*rest, *(None, None)[len(rest) :])
        full.append((doc_id, text, lang, source, None if text is None else len(text)))
    df = spark.createDataFrame(full, DOCS).repartition(3)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({name: F.lit(name) for name in EXTRA})
    return df


def classes(items, linked):
    """Class representative (least key) of each key, by plain union-find over all pairs."""
    keys = sorted(items)
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if linked(items[a], items[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: root(k) for k in keys}


def prose(seed, words=80, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{int(k)}x" for k in rng.integers(0, vocabulary, words)) + "."
