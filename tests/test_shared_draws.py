"""Pairs share the draws of their models; that must not change a figure."""

import numpy as np
import pytest
from helpers import atoms
from pyspark.sql import functions as F

from evalgrid.operators import aggregate, pairs, rank, resample


def _board(spark, odd_model):
    rng = np.random.default_rng(5)
    names = {"restraint": 7, "honesty": 5, "conviction": 6}
    per_model = {}
    for m in range(5):
        rows = [(f"{d[0]}{i}", d, s, rng.random() < 0.4 + m / 10, 1.0 + i % 2) for d, k in names.items() for i in range(k) for s in ("x", "y")]
        per_model[f"m{m}"] = rows[:-3] if odd_model and m == 2 else rows
    scores = atoms(spark, per_model)
    sums = aggregate.check_sums(scores, ["model"])
    means = sums.select("model", "item", "sub", "dimension", (F.col("den") / F.col("n")).alias("weight"), (F.col("n_correct") / F.col("n")).alias("rate"))
    return means, rank.positions(aggregate.headline(aggregate.dimension_scores(sums, ["model"]), ["model"]))


@pytest.mark.parametrize("odd_model", [False, True])
def test_equal_to_resampling_every_pair(spark, odd_model):
    means, order = _board(spark, odd_model)
    clusters = pairs.pair_clusters(pairs.shared_checks(means, order))
    plain = {(r["a"], r["b"]): (r["lo"], r["hi"]) for r in resample.headline_intervals(clusters, pairs.PAIR, 300).collect()}
    shared = {(r["a"], r["b"]): (r["lo"], r["hi"]) for r in pairs.pair_intervals(means, order, 300).collect()}
    assert shared.keys() == plain.keys() and len(plain) == 10
    assert all(np.allclose(shared[k], plain[k], atol=1e-12) for k in plain)
    plain = {(r["a"], r["b"]): r["p_value"] for r in resample.sign_flip_p(clusters, pairs.PAIR, 2300).collect()}
    shared = {(r["a"], r["b"]): r["p_value"] for r in pairs.pair_tests(means, order, 2300).collect()}
    assert shared == plain


def test_resamples_by_hand(spark):
    import hashlib

    clusters = spark.createDataFrame([("g", "d", f"i{k}", float(k), 1.0 + k % 3) for k in range(9)], "key string, dimension string, item string, num double, den double")
    got = {r["draw"]: r["ratio"] for r in resample.replicates(clusters, ["key"], 700, 3).collect()}
    assert sorted(got) == list(range(700))
    for draw in (0, 455, 699):  # blocks of 455 resamples
        at = [int(hashlib.md5(f"3:{draw}:d:{slot}".encode()).hexdigest()[:8], 16) % 9 for slot in range(9)]
        assert got[draw] == pytest.approx(sum(at) / sum(1.0 + k % 3 for k in at))
