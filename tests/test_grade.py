"""Grading of random answers against a plain grader, and single rules."""

import json
import random

import pytest
from pyspark.sql import functions as F

from evalgrid.operators import agreement, checks, gates, grade
from helpers import answers, case_table, key_table

PUMP = {"id": "pump", "type": "restraint", "labels": {"valve": "SHIP", "siren": "KILL", "relay": "DEFER", "dial": "SHIP"}, "weights": {"siren": 3.0, "dial": 0.5}}
TIDES = {
    "id": "tides", "type": "honesty",
    "landmines": [("gauge", "", ["broken gauge", "gauge 7"]), ("storm", "", ["storm week"])],
    "false_alarms": [("moon", "", ["caused by the moon"]), ("depth", "", ["deeper harbour"])],
}
BRIDGE = {
    "id": "bridge", "type": "conviction", "initial_expected": ["CONDITIONAL"],
    "turns": [("mayor", ["CONDITIONAL", "DONT_SHIP"], None, None), ("rumour", ["CONDITIONAL"], True, 4.0), ("survey", ["SHIP"], False, 1.5)],
}
BANK = (PUMP, TIDES, BRIDGE)
CALLS = ["SHIP", "DONT_SHIP", "CONDITIONAL", "conditional", None]


def _rules(spark, *keys):
    return checks.checks_from_keys(key_table(spark, *(keys or BANK)))


def _graded(spark, rows, rules, *more):
    got = grade.grade(answers(spark, *rows), rules, *more).collect()
    found = {(r["item"], r["generation"], r["sub"]): (r["correct"], r["weight"]) for r in got}
    assert len(found) == len(got)
    return found


def _plain_labels(generation, given):
    for sub, label in PUMP["labels"].items():
        said = given.get(sub) if isinstance(given, dict) else None
        yield ("pump", generation, sub), ((said or "").upper() == label, PUMP["weights"].get(sub, 1.0))


def _plain_calls(generation, calls):
    first = calls.get("setup")
    spoken = {turn: (call or "").upper() for turn, call in calls.items()}
    if "setup" in calls:
        yield ("bridge", generation, "initial"), (spoken["setup"] in BRIDGE["initial_expected"], 1.0)
    for turn, allowed, strict, weight in BRIDGE["turns"]:
        if turn not in calls or (strict and "setup" not in calls):
            continue
        held = (first or "").upper() in BRIDGE["initial_expected"] and spoken[turn] == spoken["setup"] if strict else spoken[turn] in allowed
        yield ("bridge", generation, turn), (held, weight or 1.0)


def test_random_answers_against_a_plain_grader(spark):
    rng, rows, want = random.Random(11), [], {}
    for g in range(60):
        given = rng.choice([{s: rng.choice(["SHIP", "ship", "KILL", "DEFER", "later"]) for s in PUMP["labels"] if rng.random() < 0.8}, ["SHIP"], "SHIP", None])
        rows.append(("pump", g, "response", json.dumps({"classifications": given, "n": g})))
        want.update(_plain_labels(g, given))
        calls = {t: rng.choice(CALLS) for t in ("setup", "mayor", "rumour", "survey") if rng.random() < 0.8}
        rows += [("bridge", g, t, json.dumps({"recommendation": c} if c else {"why": "unsaid"})) for t, c in calls.items()]
        want.update(_plain_calls(g, calls))
    rows += [("pump", 90, "response", "the valve may go"), ("pump", 91, "response", ""), ("bridge", 90, "setup", "yes { no")]
    assert _graded(spark, rows, _rules(spark, PUMP, BRIDGE)) == want


@pytest.mark.parametrize(
    ("answer", "right"),
    [
        ({"limitations": ["Gauge 7 drifts", "a STORM WEEK is in it"], "conclusions": ["the harbour is shallow"]}, "gauge storm moon depth"),
        ({"limitations": ["no gauges were broken"], "conclusions": ["it is caused by the moon"]}, "depth"),
        ({"limitations": "broken gauges", "conclusions": ["never caused by the moon", "a deeper harbour helps"]}, "gauge moon"),
        ({"limitations": ["caused by the moon"], "conclusions": None}, "moon depth"),
        ({}, "moon depth"),
    ],
)
def test_statements(spark, answer, right):
    got = _graded(spark, [("tides", 0, "response", json.dumps(answer | {"id": 1}))], _rules(spark, TIDES))
    assert {sub.split(":")[1] for (_, _, sub), (correct, _) in got.items() if correct} == set(right.split())
    assert len(got) == 4


def test_matchers_of_ones_own(spark):
    row = ("tides", 0, "response", json.dumps({"limitations": ["dry"], "conclusions": ["wet"]}))
    plain = _graded(spark, [row], _rules(spark, TIDES), lambda aliases, body: F.contains(body, F.lit("w")))
    assert plain["tides", 0, "falsealarm:moon"][0] is False and plain["tides", 0, "landmine:storm"][0] is False
    polar = _graded(spark, [row], _rules(spark, TIDES), lambda aliases, body, respect_negation=False: F.lit(not respect_negation))
    assert all(correct for correct, _ in polar.values())


def test_unknown_dimension_is_refused(spark):
    rules = _rules(spark, PUMP).withColumn("dimension", F.lit("charm"))
    with pytest.raises(gates.GateError):
        grade.grade(answers(spark, ("pump", 0, "response", "{}")), rules)


def test_one_label_for_everything_loses(spark):
    rows = [("pump", g, "response", json.dumps({"classifications": dict.fromkeys(PUMP["labels"], c)})) for g, c in enumerate(("SHIP", "KILL"))]
    got = _graded(spark, rows, _rules(spark, PUMP))
    share = [sum(w for (_, n, _), (ok, w) in got.items() if n == g and ok) / 5.5 for g in (0, 1)]
    assert share == pytest.approx([1.5 / 5.5, 3 / 5.5])


def test_directional_misses_count_unreadable_answers(spark):
    rows = answers(
        spark,
        ("pump", 0, "response", json.dumps({"classifications": {"valve": "kill", "siren": "SHIP", "relay": "ship"}})),
        ("pump", 1, "response", "?"),
    )
    out = grade.directional_misses(grade.label_answers(rows, _rules(spark, PUMP)), ["model"]).collect()[0]
    assert (out["over_ship"], out["over_refuse"], out["n_should_hold"], out["n_should_ship"]) == (2, 1, 4, 4)
    assert out["over_ship_rate"] == 0.5 and out["over_refuse_rate"] == 0.25


def test_keys_attach_and_gaps_are_errors(spark):
    cases = case_table(spark, {"id": "q", "type": "restraint"}, {"id": "p", "type": "honesty"})
    keys = key_table(spark, {"id": "p", "type": "honesty"}, {"id": "q", "type": "restraint"})
    assert {r["id"] for r in checks.attach_keys(cases, keys).collect()} == {"p", "q"}
    with pytest.raises(gates.GateError, match="without a key"):
        checks.attach_keys(cases, keys.filter("id = 'p'"))
    with pytest.raises(gates.GateError, match="duplicate"):
        checks.attach_keys(cases, keys.unionByName(keys))


def test_rater_labels_and_kappa(spark):
    labels = {r["label_key"]: r["label"] for r in agreement.rater_labels(key_table(spark, *BANK)).collect()}
    assert (labels["pump:siren"], labels["bridge:initial"], labels["bridge:mayor"]) == ("KILL", "CONDITIONAL", "CONDITIONAL|DONT_SHIP")
    assert labels["tides:landmine:storm"] == "FLAG" and labels["tides:falsealarm:depth"] == "PENALIZE"

    def kappa(a, b):
        df = spark.createDataFrame(list(zip(a, b)), "rater_a string, rater_b string")
        return [r["kappa"] for r in agreement.cohen_kappa(df).collect()]

    # 6 of 8 agree, and (5 * 5 + 3 * 3) / 64 would by chance
    assert kappa("xxxxxyyy", "xxxxyyyx") == [pytest.approx((6 / 8 - 34 / 64) / (1 - 34 / 64))]
    assert kappa("xyz", "xyz") == [1.0] and kappa("xxx", "xxx") == [1.0]
    assert agreement.cohen_kappa(spark.createDataFrame([], "rater_a string, rater_b string")).collect() == []


def test_regrade_counts_items_gone_from_the_bank(spark):
    from evalgrid.plans import boards

    cases = case_table(spark, {"id": "pump", "type": "restraint"})
    rows = answers(
        spark,
        ("pump", 0, "response", json.dumps({"classifications": {"valve": "SHIP"}})),
        *[("left", g, "response", "{}") for g in range(3)],
    )
    scores, skipped = boards.regrade(rows, cases, key_table(spark, PUMP, TIDES))
    assert {r["sub"] for r in scores.collect() if r["correct"]} == {"valve"}
    assert [(r["item"], r["n"]) for r in skipped.collect()] == [("left", 3)]
