"""Raking against plain iteration, and calibrated draws."""

import numpy as np
from pyspark.sql import functions as F
from small import docs_table, prose

from evalgrid.llm import mixing

CELLS = [("a", "en", "x", 100), ("a", "fr", "x", 50), ("b", "en", "y", 400), ("b", "fr", "x", 10), ("c", "en", "x", 30), ("c", "en", "y", 70), ("c", "fr", "y", 5)]
TARGETS = {"source": {"a": 0.3, "b": 0.3, "c": 0.3, "absent": 0.1}, "lang": {"en": 0.6, "fr": 0.4}, "topic": {"x": 0.5, "y": 0.5}}


def plain_rake(cells, targets, sweeps=2000):
    w = np.array([c[3] for c in cells], dtype=float)
    total = w.sum()
    for _ in range(sweeps):
        for k, d in enumerate(("source", "lang", "topic")):
            values = [c[k] for c in cells]
            known = {v: s for v, s in targets[d].items() if v in values}
            for v, s in known.items():
                at = np.array([x == v for x in values])
                w[at] *= s / sum(known.values()) * total / w[at].sum()
    return w


def test_rake(spark):
    cells = spark.createDataFrame(CELLS, "source string, lang string, topic string, tokens bigint")
    targets = spark.createDataFrame([(d, v, s) for d, t in TARGETS.items() for v, s in t.items()], "dimension string, value string, share double")
    got = {(r["source"], r["lang"], r["topic"]): r["weight"] for r in mixing.rake(cells, targets, 1e-9).collect()}
    want = plain_rake(CELLS, TARGETS)
    assert np.allclose([got[c[:3]] for c in CELLS], want, rtol=1e-5)


def test_draws_follow_their_probabilities(spark):
    rows = [(i, prose(i % 50, 20) + str(i), "en" if i % 4 else "fr", "hot" if i % 3 else f"s{i % 5}") for i in range(3000)]
    rows += [(None, None), (None, "", None, None), (7, "same"), (7, "same")]
    docs = docs_table(spark, rows, extra=True)
    out, chance, drawn = mixing.mixed(docs, F.length("text"), mixing.genre(F.col("text")))
    found = out.select(F.col(chance).alias("c"), F.col(drawn).cast("int").alias("d"), F.length("text").alias("n")).collect()
    assert len(found) == len(rows) and all(0 <= r["c"] <= 1 for r in found)
    assert max(r["c"] for r in found) == 1.0
    assert abs(sum(r["d"] for r in found) - sum(r["c"] for r in found)) < 4 * np.sqrt(len(found)) / 2
    assert mixing.sample(docs, F.length("text"), mixing.genre(F.col("text"))).columns == docs.columns
    budget = sum(r["n"] or 0 for r in found) / 10
    out, chance, _ = mixing.mixed(docs, F.length("text"), mixing.genre(F.col("text")), budget=budget)
    assert abs(out.agg(F.sum(F.col(chance) * F.length("text"))).first()[0] / budget - 1) < 1e-6


def test_one_rare_cell_beside_a_hot_one(spark):
    rows = [(i, prose(i % 50, 20) + str(i), "en" if i % 4 else "fr", "hot" if i % 3 else f"s{i % 5}") for i in range(3000)]
    docs = docs_table(spark, [*rows, (-1, prose(77, 20), "xx", None)])
    out, chance, _ = mixing.mixed(docs, F.length("text"), mixing.genre(F.col("text")))
    found = out.select("doc_id", "source", F.col(chance).alias("c"), F.length("text").alias("n")).collect()
    assert {r["c"] for r in found if r["doc_id"] == -1} == {1.0}
    assert abs(sum(r["c"] * r["n"] for r in found) / sum(r["n"] for r in found) - mixing.KEEP) < 1e-6
    assert all(r["c"] > 0.4 for r in found if r["source"] == "hot")


def test_targets_of_a_small_value_are_shared_out(spark):
    cells = spark.createDataFrame([("a", "en", "x", 1000), ("b", "en", "x", 1000), ("c", "en", "x", 10)], "source string, lang string, topic string, tokens bigint")
    targets = spark.createDataFrame([("source", "a", 0.4), ("source", "b", 0.2), ("source", "c", 0.4), ("lang", "en", 1.0), ("topic", "x", 1.0)], "dimension string, value string, share double")
    raked = mixing.rake(cells, mixing.reachable(cells, targets, 610))
    got = {r["source"]: r["probability"] * r["tokens"] for r in mixing.calibrated(raked, 610).collect()}
    assert np.allclose([got[k] for k in "abc"], [400, 200, 10], rtol=1e-5)


def test_no_rows(spark):
    docs = docs_table(spark, [(1, "x")]).where("false")
    assert mixing.sample(docs, F.length("text"), mixing.genre(F.col("text"))).count() == 0
