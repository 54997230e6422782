"""Weighted scores, resampling, pairs and bands."""

import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalgrid import DIMENSIONS
from evalgrid.operators import aggregate, agreement, coverage, gates, pairs, rank, resample
from evalgrid.plans import boards
from helpers import atoms, flat


def _board(spark, per_model):
    sums = aggregate.check_sums(atoms(spark, per_model), ["model"])
    return sums, {r["model"]: r["score"] for r in aggregate.headline(aggregate.dimension_scores(sums, ["model"]), ["model"]).collect()}


def test_weighted_mean_and_headline(spark):
    _, scores = _board(spark, {
        "a": [("x", "restraint", "s", 1, 2.0), ("x", "restraint", "t", 0, 1.0), ("y", "honesty", "s", 1, 1.0)],
        "b": [("x", "restraint", "s", 0, 1.0)],
    })
    assert scores["a"] == pytest.approx((2 / 3 + 1) / 2 * 100)
    assert scores["b"] == 0.0


def test_published_sample_scores(spark):
    """Shares 5/13, 3/10 and 3/19 give a floor of 28.08; all right gives 100."""
    def dim(name, right, total):
        return [("i", name, f"s{i}", i < right, 1.0) for i in range(total)]

    weak = dim("restraint", 5, 13) + dim("honesty", 3, 10) + dim("conviction", 3, 19)
    strong = [(i, d, s, 1, w) for i, d, s, _, w in weak]
    _, scores = _board(spark, {"weak": weak, "strong": strong})
    assert round(scores["weak"], 2) == 28.08 and scores["strong"] == 100.0


def test_interval_needs_more_than_one_item(spark):
    one = {"a": [("x", "restraint", f"s{i}", i % 2, 1.0) for i in range(6)]}
    sums, _ = _board(spark, one)
    row = resample.dimension_intervals(aggregate.cluster_sums(sums, ["model"]), ["model"], n=50).collect()[0]
    assert row["lo"] == row["hi"] == 0.5


def test_cluster_interval_is_wider_than_an_atomic_one(spark):
    rows = [(f"i{i}", "restraint", f"s{j}", i < 5, 1.0) for i in range(10) for j in range(5)]
    apart = [(f"i{i}_{j}", "restraint", "s", c, w) for i, d, j, c, w in rows]
    sums, _ = _board(spark, {"together": rows, "apart": apart})
    out = resample.headline_intervals(aggregate.cluster_sums(sums, ["model"]), ["model"], n=800)
    width = {r["model"]: r["hi"] - r["lo"] for r in out.collect()}
    assert width["together"] > 1.5 * width["apart"]


def _random_scores(seed=3, models="abcd", items=7):
    rng = np.random.default_rng(seed)
    return {
        m: [(f"i{i}", DIMENSIONS[i % 3], f"s{j}", rng.random() < 0.4 + 0.1 * k, 1.0 + (j % 2), g)
            for i in range(items) for j in range(4) for g in range(2) if rng.random() < 0.9]
        for k, m in enumerate(models)
    }


def _pick(*parts, k):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) % k


def test_resampling_by_hand(spark):
    clusters = aggregate.cluster_sums(_board(spark, _random_scores())[0], ["model"])
    n, sums = 60, {}
    for r in clusters.collect():
        sums.setdefault(r["model"], {}).setdefault(r["dimension"], []).append((r["item"], r["num"], r["den"]))
    heads = {(r["model"],): (r["lo"], r["hi"]) for r in resample.headline_intervals(clusters, ["model"], n=n).collect()}
    alls = {r["model"]: r for r in resample.all_intervals(clusters, ["model"], DIMENSIONS, n=n, n_dimension=40).collect()}
    dims = {(r["model"], r["dimension"]): (r["lo"], r["hi"]) for r in resample.dimension_intervals(clusters, ["model"], n=40).collect()}
    for model, by_dim in sums.items():
        ratios = {}
        for d, rows in by_dim.items():
            rows = sorted(rows)
            for draw in range(n):
                picks = [rows[_pick(0, draw, d, slot, k=len(rows))] for slot in range(len(rows))]
                ratios[d, draw] = sum(p[1] for p in picks) / sum(p[2] for p in picks)
            want = np.quantile([ratios[d, draw] for draw in range(40)], [0.025, 0.975])
            assert dims[model, d] == pytest.approx(want) and (alls[model][f"{d}_lo"], alls[model][f"{d}_hi"]) == pytest.approx(want)
        want = np.quantile([np.mean([ratios[d, draw] for d in by_dim]) for draw in range(n)], [0.025, 0.975])
        assert heads[model,] == pytest.approx(want) and (alls[model]["score_lo"], alls[model]["score_hi"]) == pytest.approx(want)


def test_sign_flips_by_hand(spark):
    rows = [("x", d, f"i{i}", 1.0 + i % 3, 0.4 * (i % 4) - 0.3) for d in DIMENSIONS[:2] for i in range(6)]
    clusters = spark.createDataFrame(rows, "model string, dimension string, item string, den double, num double")
    dens = {d: sum(r[3] for r in rows if r[1] == d) for d in DIMENSIONS[:2]}
    coef = {(r[1], r[2]): r[4] / dens[r[1]] / 2 for r in rows}
    observed, extreme = sum(coef.values()), 0
    for flip in range(300):
        signs = {u: 1 if int(hashlib.md5(f"0:{flip}:{u[0]}:{u[1]}".encode()).hexdigest()[7], 16) % 2 else -1 for u in coef}
        extreme += abs(sum(signs[u] * c for u, c in coef.items())) >= abs(observed) - 1e-12
    got = resample.sign_flip_p(clusters, ["model"], n=300).first()["p_value"]
    assert got == pytest.approx((extreme + 1) / 301)


def test_draws_are_uniform_and_whole(spark):
    sizes = spark.createDataFrame([("honesty", 5), ("restraint", 3000)], "dimension string, k bigint")
    drawn = resample.draws(sizes, 400, seed=0)
    assert {(r["k"], r["n"]) for r in drawn.groupBy("draw", "k").agg(F.count("*").alias("n")).collect()} == {(5, 5), (3000, 3000)}
    counts = [r["n"] for r in drawn.where("k = 5").groupBy("idx").agg(F.count("*").alias("n")).collect()]
    assert len(counts) == 5 and all(300 < c < 500 for c in counts)


def _pairs(spark, per_model, n=400):
    return {(r["a"], r["b"]): r for r in boards.pair_table(atoms(spark, per_model), n=n, permutations=n).collect()}


def test_pairs_cover_each_pair_once_and_name_the_winner(spark):
    got = _pairs(spark, {"a": flat([1] * 20), "b": flat([1] * 10 + [0] * 10), "c": flat([0] * 20)}, n=2000)
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    assert (got["a", "c"]["winner"], got["a", "b"]["winner"], got["b", "c"]["winner"]) == ("a", "a", "b")
    assert got["a", "c"]["lo"] > 0 and got["a", "b"]["n_items"] == 20


def test_equal_models_have_no_winner(spark):
    row = _pairs(spark, {"a": flat([1, 0, 1, 0]), "b": flat([1, 0, 1, 0])})["a", "b"]
    assert row["diff"] == 0.0 and row["p_value"] == 1.0 and row["winner"] is None


def test_every_generation_counts(spark):
    a = [("i", "restraint", f"s{i}", g == 0, 1.0, g) for i in range(6) for g in range(2)]
    b = [("i", "restraint", f"s{i}", c, 1.0, g) for i in range(6) for g, c in enumerate((1, 0))]
    row = _pairs(spark, {"a": a, "b": b})["a", "b"]
    assert row["diff"] == 0.0 and row["n_pairs"] == 6


def test_dimensions_weigh_the_same(spark):
    a = flat([0] * 8) + [("h", "honesty", "s", 1, 1.0), ("c", "conviction", "s", 1, 1.0)]
    b = flat([1] * 8) + [("h", "honesty", "s", 0, 1.0), ("c", "conviction", "s", 0, 1.0)]
    row = _pairs(spark, {"a": a, "b": b})["a", "b"]
    assert row["diff"] == pytest.approx(1 / 3)


def test_changing_metadata_stops_a_comparison(spark):
    scores = atoms(spark, {"a": flat([1, 0]), "b": flat([1, 0])})
    bad = scores.withColumn("weight", F.when(F.col("model") == "b", 2.0).otherwise(F.col("weight")))
    with pytest.raises(gates.GateError, match="changes"):
        boards.pair_table(bad, n=10)


def test_order_only_flips_the_sign(spark):
    means = aggregate.generation_means(atoms(spark, _random_scores(models="ab")), ["model"])
    results = []
    for first, second in (("a", "b"), ("b", "a")):
        order = spark.createDataFrame([(first, 1), (second, 2)], "model string, pos int")
        results.append(pairs.compare(means, order, n=200).collect()[0])
    x, y = results
    assert x["diff"] == pytest.approx(-y["diff"]) and x["lo"] == pytest.approx(-y["hi"])
    assert x["p_value"] == pytest.approx(y["p_value"])


def test_exact_sign_flip_distribution(spark):
    """With three clusters the test must agree with full enumeration."""
    deltas = [0.5, 0.2, -0.1]
    clusters = spark.createDataFrame(
        [("p", "restraint", f"i{i}", 1.0, d) for i, d in enumerate(deltas)],
        "a string, dimension string, item string, den double, num double",
    )
    p = resample.sign_flip_p(clusters, ["a"], n=4000).collect()[0]["p_value"]
    observed = abs(sum(deltas))
    exact = np.mean([abs(sum(s * d for s, d in zip(signs, deltas))) >= observed - 1e-12
                     for signs in itertools.product((1, -1), repeat=3)])
    assert p == pytest.approx(exact, abs=0.03)


def test_holm(spark):
    df = spark.createDataFrame([("x", "y", 0.01), ("x", "z", 0.03), ("y", "z", 0.04)], "a string, b string, p_value double")
    got = [r["p_adjusted"] for r in pairs.holm_adjust(df).orderBy("p_value").collect()]
    assert got == pytest.approx([0.03, 0.06, 0.06])


def test_holm_by_plain_steps(spark):
    rows = [(f"f{k % 3}" if k % 3 else None, f"a{k:04d}", "z", None if k % 50 == 7 else ((k * 7919) % 900) / 3e5) for k in range(900)]
    df = spark.createDataFrame(rows, "fam string, a string, b string, p_value double").repartition(5)

    def plain(rows):
        ordered, out, top = sorted(rows, key=lambda r: (r[3] is not None, r[3] or 0, r[1])), {}, None
        for at, r in enumerate(ordered):
            if r[3] is not None:
                top = max(top or 0.0, (len(rows) - at) * r[3])
            out[r[1]] = 1.0 if top is None else min(1.0, top)
        return out

    one = {r["a"]: r["p_adjusted"] for r in pairs.holm_adjust(df).collect()}
    assert one == pytest.approx(plain(rows))
    apart = {r["a"]: r["p_adjusted"] for r in pairs.holm_adjust(df, family=["fam"]).collect()}
    want = {}
    for name in (None, "f1", "f2"):
        want |= plain([r for r in rows if r[0] == name])
    assert apart == pytest.approx(want)
    assert pairs.holm_adjust(df.filter("false")).count() == 0


def test_wins_cells_and_grid(spark):
    records = spark.createDataFrame(
        [("x", "y", 0.1, 0.05, 0.2, "x"), ("x", "z", 0.1, 0.01, 0.2, None), ("y", "z", 0.0, -0.1, 0.1, None)],
        "a string, b string, diff double, lo double, hi double, winner string",
    )
    assert {r["model"]: r["wins"] for r in pairs.wins(records).collect()} == {"x": 1, "y": 0, "z": 0}
    best = pairs.best_record(pairs.wins(records)).collect()[0]
    assert (best["best"], best["compared"], best["decisive"]) == (1, 2, 1)
    grid = {r["model"]: r.asDict() for r in pairs.head_to_head(records, ["x", "y", "z"]).collect()}
    assert (grid["x"]["y"], grid["y"]["x"], grid["x"]["z"], grid["z"]["x"], grid["y"]["z"]) == ("wd", "ld", "ws", "ls", "nd")
    assert grid["x"]["x"] is None and grid["x"]["decisive_wins"] == 1


def _rows(spark, rows):
    full = [(m, float(v), float(lo), float(hi), m.startswith("naive"), ok) for m, v, lo, hi, ok in rows]
    return spark.createDataFrame(
        full, "model string, score double, lo double, hi double, is_baseline boolean, ranked_eligible boolean"
    )


def test_bands_compare_with_their_leader(spark):
    board = _rows(spark, [("A", 90, 85, 95, True), ("B", 87, 82, 92, True), ("C", 84, 80, 88, True),
                          ("D", 80, 76, 84, True), ("E", 78, 72, 83, True), ("P", 99, 98, 100, False), ("naive", 40, 39, 41, True)])
    got = {r["model"]: (r["rank"], r["pos"], r["tied"]) for r in rank.overlap_bands(board).collect()}
    assert got == {"A": (1, 1, True), "B": (1, 2, True), "C": (1, 3, True), "D": (2, 4, True), "E": (2, 5, True),
                   "P": (None, None, False)}
    assert {r["model"] for r in rank.leader_band(board.filter("ranked_eligible and not is_baseline")).collect()} == {"A", "B", "C"}
    assert [r["model"] for r in rank.board_order(board).collect()][-2:] == ["P", "naive"]


def test_price_span_needs_two_prices(spark):
    board = rank.overlap_bands(_rows(spark, [("A", 90, 80, 95, True), ("B", 87, 82, 92, True), ("C", 60, 50, 70, True)]))
    prices = spark.createDataFrame([("A", 3.0, 9.0), ("B", 1.0, 2.0), ("C", 0.1, 0.1)], "model string, price_in double, price_out double")
    row = rank.price_span(board.join(prices, "model")).collect()[0]
    assert (row["cheapest"], row["dearest"]) == ("B", "A")
    assert rank.price_span(board.join(prices.filter("model <> 'B'"), "model")).collect() == []


def test_difficulty_and_live_checks(spark):
    sums, _ = _board(spark, {
        "a": [("x", "restraint", "dead", 1, 1.0), ("x", "restraint", "live", 1, 1.0)],
        "b": [("x", "restraint", "dead", 1, 1.0), ("x", "restraint", "live", 0, 1.0)],
        "naive": [("x", "restraint", "dead", 0, 1.0)],
    })
    assert {(r["model"], r["sub"]) for r in aggregate.live_sums(sums).collect()} == {("a", "live"), ("b", "live")}


def test_dimension_structure(spark):
    values = [(f"m{i}", d, v) for i in range(6) for d, v in
              zip(DIMENSIONS, (0.1 * i, 0.9 - 0.1 * i, 0.05 * i + 0.2))]
    df = spark.createDataFrame(values, "model string, dimension string, value double")
    row = agreement.dimension_structure(df).collect()[0]
    assert row["corr_rc"] == pytest.approx(1) and row["corr_rh"] == pytest.approx(-1)
    assert row["pc1_share"] > 0.99
    assert agreement.dimension_structure(df.filter("model < 'm4'")).collect() == []
    flat_column = df.withColumn("value", F.when(F.col("dimension") == "honesty", 0.5).otherwise(F.col("value")))
    assert agreement.dimension_structure(flat_column).collect() == []


def test_first_component_matches_an_eigenvalue_solver(spark):
    rng = np.random.default_rng(5)
    table = rng.random((9, 3))
    rows = [(f"m{i}", d, float(v)) for i, line in enumerate(table) for d, v in zip(DIMENSIONS, line)]
    row = agreement.dimension_structure(spark.createDataFrame(rows, "model string, dimension string, value double")).collect()[0]
    values = np.linalg.eigvalsh(np.corrcoef(table, rowvar=False))
    assert row["pc1_share"] == pytest.approx(values.max() / values.sum())


def test_coverage_is_measured_against_the_bank(spark):
    expected = spark.createDataFrame(
        [("x", "restraint", "s"), ("y", "honesty", "s"), ("z", "conviction", "s"), ("z", "conviction", "t")],
        "item string, dimension string, sub string",
    )
    rows = {
        "full": [("x", "restraint", "s", 1, 1.0), ("y", "honesty", "s", 1, 1.0), ("z", "conviction", "s", 1, 1.0), ("z", "conviction", "t", 1, 1.0)],
        "part": [("x", "restraint", "s", 1, 1.0), ("y", "honesty", "s", 1, 1.0), ("z", "conviction", "s", 1, 1.0)],
        "thin": [("x", "restraint", "s", 1, 1.0)],
        "naive": [("x", "restraint", "s", 1, 1.0)],
    }
    sums = aggregate.check_sums(atoms(spark, rows), ["model"])
    got = {r["model"]: r for r in coverage.coverage_board(sums, expected, ["model"]).collect()}
    assert [got[m]["coverage_status"] for m in ("full", "part", "thin", "naive")] == ["ranked", "provisional", "provisional", "baseline"]
    assert got["part"]["coverage_ratio"] == 1.0 and got["part"]["check_coverage_ratio"] == 0.75
    assert got["thin"]["missing_dimensions"] == "honesty,conviction"


def test_metadata_must_not_change(spark):
    good = atoms(spark, {"a": flat([1, 0]), "b": flat([1, 0])})
    assert gates.inconsistent_metadata(good).collect() == []
    bad = good.withColumn("weight", F.when(F.col("model") == "b", 2.0).otherwise(F.col("weight")))
    assert gates.inconsistent_metadata(bad).count() == 2
    assert gates.item_dimensions(good).collect() == []


def test_snapshot(spark):
    rows = {m: [(f"i{i}", DIMENSIONS[i % 3], "s", i % (k + 2) > 0, 1.0) for i in range(9)] for k, m in enumerate(("a", "b", "naive"))}
    scores = atoms(spark, rows)
    expected = scores.select("item", "dimension", "sub").distinct()
    models = spark.createDataFrame([("a", "A 1", "x", 1.0, 2.0, None)], "name string, label string, provider string, price_in double, price_out double, superseded_by string")
    board = {r["model"]: r for r in boards.snapshot(scores, expected, models, n=100).collect()}
    assert set(board) == {"a", "b"} and board["a"]["label"] == "A 1" and board["b"]["label"] == "b"
    stored = boards.stored_models(boards.snapshot(scores, expected, models, n=50), "r1").filter("model = 'a'").collect()[0]
    assert stored["score"]["value"] == board["a"]["score"] and stored["run_id"] == "r1"
    assert board["a"]["ranked_eligible"] and board["a"]["lo"] <= board["a"]["score"] <= board["a"]["hi"]
