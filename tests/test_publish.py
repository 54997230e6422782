"""The publication audit as one plan, coverage bitmaps, pair files, board places."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from evalgrid.operators import coverage, gates, rank
from evalgrid.sources import ledger

CHECK = "item string, dimension string, sub string"


def _graded(spark, model, cells, generations):
    rows = [(model, i, d, s, True, 1.0, g) for i, d, s in cells for g in range(generations)]
    return spark.createDataFrame(rows, f"model string, {CHECK}, correct boolean, weight double, generation bigint")


def test_every_reason_of_every_model(spark):
    cells = [("a", "restraint", "x"), ("a", "restraint", "y"), ("b", "honesty", "x")]
    expected = spark.createDataFrame(cells, CHECK)
    models = spark.createDataFrame([(m, "mock" if m == "mock" else "openai") for m in ("fine", "mock", "short", "over", "off", "lost")], "name string, provider string")
    graded = _graded(spark, "fine", cells, 2)
    for model, n in (("mock", 1), ("short", 1), ("over", 2), ("off", 2), ("stray", 2)):
        graded = graded.unionByName(_graded(spark, model, cells, n))
    raw = graded.select("model", "item", "generation").distinct()
    raw = raw.unionByName(spark.createDataFrame([("over", "a", 2), ("over", "gone", 7)], raw.schema))
    saved = graded.withColumn("correct", F.when((F.col("model") == "off") & (F.col("sub") == "y"), False).otherwise(F.col("correct")))
    requested = ["fine", "mock", "short", "over", "off", "lost", "lost"]

    def audit(asked, saved=saved):
        out = coverage.completeness_errors(asked, models, raw, saved, graded, expected, 2, dimensions=("restraint", "honesty"))
        found = [tuple(r) for r in out.collect()]
        assert len(found) == len(set(found))
        return set(found)

    stray = ("stray", "scores of an unknown model", 1)
    assert audit(requested) == {
        stray, ("lost", "score file missing", 1), ("short", "score coverage incomplete", 3), ("short", "raw generations incomplete", 2),
        ("over", "raw generations unexpected", 1), ("off", "saved scores do not match regrade", 2),
    }
    table = spark.createDataFrame([("fine",), (None,)], "model string")
    assert audit(table.filter("model is not null"), saved.filter("model = 'fine'")) == set()
    assert audit(["fine", "who"]) == {("who", "unknown requested model", 1)}
    assert audit([], saved.filter("false")) == set()


def test_bitmaps_name_each_gap(spark):
    checks = [(f"i{n // 4:03d}", "honesty", f"s{n % 4}") for n in range(200)]
    expected = spark.createDataFrame(checks + checks[:3], CHECK)
    roster = spark.createDataFrame([("r", "m", 2), ("r", "empty", 1), ("r", "idle", 0)], "run string, model string, generations bigint")
    rows = [("r", "m", *c, 2) for k, c in enumerate(checks) if k not in (0, 62, 63, 126, 199)]
    rows[5] = (*rows[5][:5], 1)
    rows[6] = (*rows[6][:5], 3)
    rows += [("r", "m", "odd", "honesty", "s0", 2), ("r", "who", *checks[0], 2)]
    sums = spark.createDataFrame(rows, f"run string, model string, {CHECK}, n bigint")
    got = [tuple(r) for r in coverage.coverage_gaps(sums, expected, roster, ["run"]).collect()]
    want = {("r", "m", *checks[k], 0, 2, "missing") for k in (0, 62, 63, 126, 199)}
    want |= {("r", "empty", *c, 0, 1, "missing") for c in checks}
    want |= {(*rows[5][:5], 1, 2, "short"), (*rows[6][:5], 3, 2, "extra"), ("r", "m", "odd", "honesty", "s0", 2, 0, "unexpected")}
    assert set(got) == want and len(got) == len(want)
    none = coverage.coverage_gaps(sums, expected.filter("false"), roster, ["run"])
    assert {r["status"] for r in none.collect()} == {"unexpected"}


def test_pair_files_of_both_kinds(spark, tmp_path):
    rows = [{"a": f"m{k}", "b": "z", "n_items": k} for k in range(5)]
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows[:2])) + "\n")
    (tmp_path / "array.json").write_text(json.dumps(rows[2:4], indent=1))
    (tmp_path / "flat.json").write_text("  " + json.dumps(rows[4:]))
    got = sorted((r["a"], r["n_items"], r["winner"]) for r in ledger.read_pairs(spark, str(tmp_path)).collect())
    assert got == [(r["a"], r["n_items"], None) for r in rows]
    made = spark.createDataFrame([(f"m{k}", "z") for k in range(9)], "a string, b string")
    ledger.write_pairs(made.coalesce(1), str(tmp_path / "made"))
    assert ledger.read_pairs(spark, str(tmp_path / "made")).count() == 9


def test_places_follow_the_displayed_order(spark):
    rows = [(f"m{k}", float(k % 7), k % 11 == 0, k % 3 > 0) for k in range(60)]
    board = spark.createDataFrame(rows, "model string, score double, is_baseline boolean, ranked_eligible boolean")
    got = {r["model"]: r["place"] for r in rank.places(board).collect()}
    ordered = sorted(rows, key=lambda r: (r[2], not r[2] and not r[3], -r[1], r[0]))
    assert got == {r[0]: k + 1 for k, r in enumerate(ordered)}


def test_subset_row(spark):
    def held(new, prior):
        made = [spark.createDataFrame([(m,) for m in side], "model string") for side in (new, prior)]
        return gates.subset_row(*made).collect()[0]["subset"]

    assert held("ab", "abc") and held("aab", "bac")
    assert not (held("abc", "abc") or held("ad", "abc") or held("", "abc") or held("", "") or held("a", ""))
