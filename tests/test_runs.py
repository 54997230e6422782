"""Requests, results, audits, history, banks and costs on literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from evalgrid import schemas
from evalgrid.functions import hashing, ids, lineage, usage
from evalgrid.operators import audit, bank, checks, cost, coverage, gates, generations, grade, leaks, ledger, rank, requests, scope
from evalgrid.sources.bank import with_meta
from evalgrid.session import cut
from helpers import answers, atoms, case_table, flat, key_table


def _one(spark, value, expression):
    kind = "array<string>" if isinstance(value, list) else "string"
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("o")).collect()[0]["o"]


@pytest.mark.parametrize(("label", "family", "version"), [
    ("Lyra Song 4.6", "lyra song", [4, 6]), ("Vega K3", "vega", [3]), ("ORI-5.6", "ori", [5, 6]),
    ("Flash-Lite", "flash lite", None), ("Orion 4.10.2", "orion", [4, 10, 2]), ("Fast 3 Mini", "fast mini", [3]),
    ("V2x Mini", "v2x mini", None), ("Pro  5 - Max", "pro max", [5]),
])
def test_lineage(spark, label, family, version):
    assert _one(spark, label, lineage.family_of) == family
    assert _one(spark, label, lineage.version_of) == version


def test_dates_in_ids(spark):
    assert _one(spark, "orion-5.4-2026-03-05", ids.released_from_id) == "2026-03-05"
    assert _one(spark, "lyra-4-5-20251001", ids.released_from_id) == "2025-10-01"
    assert _one(spark, "model-20251399", ids.released_from_id) is None
    assert _one(spark, "2026-07-10-rerun", ids.run_date) == "2026-07-10"
    assert _one(spark, "sample", ids.run_date) is None


def test_tokens_are_safe_and_short(spark):
    assert _one(spark, "a b/c", lambda v: ids.safe_token(v, 16)) == "a_b_c"
    assert _one(spark, "///", lambda v: ids.safe_token(v, 16)) == "x"
    long = _one(spark, "x" * 40, lambda v: ids.safe_token(v, 16))
    assert len(long) == 16 and long.startswith("x" * 9 + "-")
    made = _one(spark, "m" * 99, lambda v: ids.custom_id(v, v, F.lit(12), v))
    assert len(made) <= 64


def _usage(spark, value):
    row = _one(spark, json.dumps(value), lambda v: usage.normalize_usage(F.try_parse_json(v)))
    return (row["input_tokens"], row["output_tokens"], row["total_tokens"], row["cached_input_tokens"])


def test_usage_shapes(spark):
    assert _usage(spark, {"input_tokens": 10, "output_tokens": 5, "total_tokens": 15, "input_tokens_details": {"cached_tokens": 4}}) == (10, 5, 15, 4)
    assert _usage(spark, {"prompt_tokens": 90, "completion_tokens": 41, "total_tokens": 148, "completion_tokens_details": {"reasoning_tokens": 17}}) == (90, 58, 148, None)
    assert _usage(spark, {"prompt_tokens": 90, "completion_tokens": 58, "total_tokens": 148, "completion_tokens_details": {"reasoning_tokens": 17}}) == (90, 58, 148, None)
    assert _usage(spark, {"promptTokenCount": 3, "candidatesTokenCount": 4, "thoughtsTokenCount": 2}) == (3, 6, None, None)
    assert _usage(spark, {"cache_read_input_tokens": 7}) == (None, None, None, 7)


def test_costs(spark):
    def price(tokens_in, tokens_out, cached, price_in=2.0, price_out=4.0, price_cached=None, discount=None, mode="live"):
        values = F.struct(*[F.lit(v).cast("bigint").alias(n) for v, n in (
            (tokens_in, "input_tokens"), (tokens_out, "output_tokens"), (None, "total_tokens"), (cached, "cached_input_tokens"))])
        columns = [F.lit(v).cast("double") for v in (price_in, price_out, price_cached, discount)]
        return spark.range(1).select(usage.cost_usd(values, *columns, F.lit(mode))).collect()[0][0]

    assert price(1_000_000, 500_000, None) == 4.0
    assert price(1_000_000, 500_000, None, discount=0.5, mode="batch") == 2.0
    assert price(1_000_000, 0, 400_000, price_cached=0.5) == pytest.approx(1.4)
    assert price(1_000_000, 0, 400_000) == 2.0
    assert price(100, 0, 400, price_cached=0.5) == 0.0002
    assert price(None, None, None) is None and price(1, 1, 1, price_in=None) is None


def test_cost_is_unknown_only_if_every_row_is(spark):
    rows = [("a", (1, 2, 3, None), None), ("a", (1, None, None, None), 0.5), ("b", (1, 1, 1, 1), None)]
    df = spark.createDataFrame(rows, f"model string, usage {schemas.USAGE}, cost_usd double")
    got = {r["model"]: r for r in cost.cost_summary(df, ["model"]).collect()}
    assert got["a"]["estimated_cost_usd"] == 0.5 and got["b"]["estimated_cost_usd"] is None
    assert (got["a"]["requests"], got["a"]["input_tokens"], got["a"]["output_tokens"]) == (2, 2, 2)


def test_settings_audit(spark):
    lines = spark.createDataFrame([
        ("a", json.dumps({"body": {"max_output_tokens": 700}})),
        ("a", json.dumps({"body": {"temperature": 0.2, "max_tokens": 5}})),
        ("b", json.dumps({"x": [{"y": {"max_tokens": 9}}]})),
    ], "model string, value string")
    assert [r["forbidden"] for r in cost.with_forbidden(lines).collect()] == [None, "temperature", None]
    found = {(r["model"], r["key"], r["value"]): r["n"] for r in cost.ceilings(lines).collect()}
    assert found == {("a", "max_output_tokens", "700"): 1, ("a", "max_tokens", "5"): 1, ("b", "max_tokens", "9"): 1}


def test_scopes_and_routes(spark):
    df = spark.createDataFrame([("example_a",), ("b",)], "item string")
    assert scope.in_scope(df, scope.OFFICIAL).collect()[0]["item"] == "b"
    assert scope.in_scope(df, scope.EXAMPLES).collect()[0]["item"] == "example_a"
    assert scope.in_scope(df, scope.ALL).count() == 2
    with pytest.raises(ValueError, match="unknown scope"):
        scope.in_scope(df, "some")
    models = spark.createDataFrame([("m", "mock", None), ("b", "x", True), ("d", "x", None)], "name string, provider string, batch_supported boolean")
    assert {r["name"]: r["route"] for r in scope.with_route(models).collect()} == {"m": "local", "b": "batch", "d": "direct"}


MULTI = {"id": "c", "type": "conviction", "setup_prompt": "go?", "turns": [("t1", "k", "sure?", ""), ("t2", "k", "really?", "")]}
SINGLE = {"id": "r", "type": "restraint", "brief": "B", "prompt": "P", "features": [("f", "Feature")]}
MODELS = [("m", "openai", "m-1", 1.0, 2.0, None, 0.5, True), ("mock", "mock", "x", None, None, None, None, None),
          ("solo", "x", "s", None, None, None, None, False)]


def _models(spark):
    return spark.createDataFrame(MODELS, "name string, provider string, id string, price_in double, price_out double, "
                                 "price_cached_in double, batch_discount double, batch_supported boolean")


def _stage(spark, *rows, previous=None):
    said = answers(spark, *rows).select("model", "item", "generation", "turn_id", "text")
    out = requests.stage_requests(_models(spark), case_table(spark, MULTI, SINGLE), said, 2, "r1", previous, system="S")
    return {(r["item"], r["generation"]): r for r in out.collect()}


def test_stages_ask_the_first_open_turn(spark):
    first = _stage(spark)
    assert len(first) == 4 and first["c", 0]["turn_id"] == "setup"
    assert [m["content"] for m in first["r", 0]["messages"]] == ["S", "B\n\nCandidate features:\n- f: Feature\n\nP"]
    done = [("r", 0, "response", "ok"), ("c", 0, "setup", "A0"), ("c", 1, "setup", ""), ("c", 0, "t2", "early")]
    second = _stage(spark, *done)
    assert set(second) == {("r", 1), ("c", 0), ("c", 1)}
    assert second["c", 0]["turn_id"] == "t1" and second["c", 1]["turn_id"] == "setup"
    assert [(m["role"], m["content"]) for m in second["c", 0]["messages"]] == [
        ("system", "S"), ("user", "go?"), ("assistant", "A0"), ("user", "sure?")]
    previous = spark.createDataFrame([("m", 3)], "model string, stage int")
    assert {r["stage"] for r in _stage(spark, previous=previous).values()} == {4}


def _manifest(spark, provider):
    row = ("id1", "r1", 1, "c", 0, "setup", "s", provider, "m", "model-1", 2.0, 4.0, None, 0.5)
    return spark.createDataFrame([row], schemas.ddl(schemas.MANIFEST))


def _results(spark, provider, *lines):
    df = spark.createDataFrame([(l if isinstance(l, str) else json.dumps(l),) for l in lines], "value string")
    return requests.normalize_results(df, _manifest(spark, provider)).collect()


def test_openai_results(spark):
    body = {"id": "resp", "model": "served", "status": "completed",
            "output": [{"type": "reasoning"}, {"type": "message", "content": [{"type": "output_text", "text": "a"}, {"type": "text", "text": "b"}]}],
            "usage": {"input_tokens": 10, "output_tokens": 5, "total_tokens": 15}}
    ok, bad, stray, refused = _results(
        spark, "openai",
        {"custom_id": "id1", "response": {"status_code": 200, "body": body}, "error": None},
        "", "  ",
        {"custom_id": "id1", "error": {"code": "x"}},
        {"custom_id": "other", "response": {"body": body}},
        {"custom_id": "id1", "response": {"status_code": 500, "body": {"e": 1}}},
    )
    assert (ok["text"], ok["finish_reason"], ok["served_model"], ok["request_id"], ok["outcome"]) == ("ab", "completed", "served", "resp", "merged")
    assert ok["cost_usd"] == pytest.approx((10 * 2 + 5 * 4) / 1e6 * 0.5)
    assert json.loads(bad["error"]) == {"code": "x"} and bad["outcome"] == "error"
    assert stray["outcome"] == "unknown" and json.loads(refused["error"]) == {"e": 1}


def test_anthropic_and_google_results(spark):
    message = {"id": "msg", "stop_reason": "max_tokens", "usage": {"input_tokens": 1, "output_tokens": 2},
               "content": [{"type": "thinking", "text": "no"}, {"type": "text", "text": "yes"}]}
    ok, bad = _results(spark, "anthropic", {"custom_id": "id1", "result": {"type": "succeeded", "message": message}},
                       {"custom_id": "id1", "result": {"type": "errored", "error": {"t": 1}}})
    assert (ok["text"], ok["finish_reason"], ok["request_id"]) == ("yes", "max_tokens", "msg")
    assert json.loads(bad["error"]) == {"t": 1}
    candidate = {"finishReason": "MAX_TOKENS", "content": {"parts": [{"text": "x"}, {"thought": True}]}}
    ok, plain, bad = _results(
        spark, "google",
        {"key": "id1", "response": {"candidates": [candidate, {"finish_reason": "STOP"}], "finishReason": "STOP",
                                    "usageMetadata": {"promptTokenCount": 3, "candidatesTokenCount": 4}}},
        {"metadata": {"key": "id1"}, "candidates": [candidate]},
        {"key": "id1", "error": {"code": 5}},
    )
    assert (ok["text"], ok["finish_reason"], ok["usage"]["output_tokens"]) == ("x", "STOP,MAX_TOKENS", 4)
    assert (plain["text"], plain["finish_reason"], plain["outcome"]) == ("x", "MAX_TOKENS", "merged")
    assert bad["outcome"] == "error"


def test_generation_gaps_are_padded(spark):
    rows = answers(spark, ("r", 2, "response", "x"), ("c", 1, "setup", "y"))
    got = {(r["item"], r["generation"]): (r["turn_id"], r["text"]) for r in requests.pad_generations(rows).collect()}
    assert got == {("r", 0): ("response", ""), ("r", 1): ("response", ""), ("r", 2): ("response", "x"),
                   ("c", 0): ("setup", ""), ("c", 1): ("setup", "y")}


def test_occurrence_numbers_follow_the_order(spark, monkeypatch):
    rows = [("k", g) for g in (5, 1, 900, 3, 44)] + [("z", 7), ("z", None), (None, 8), (None, None)]
    df = spark.createDataFrame(rows, "k string, g bigint")
    for stretches in (1, 3, 64):
        monkeypatch.setattr(audit, "STRETCHES", stretches)
        got = {(r["k"], r["g"]): r["occurrence"] for r in audit.with_occurrence(df, ["k"], "g").collect()}
        assert got == {("k", 1): 0, ("k", 3): 1, ("k", 5): 2, ("k", 44): 3, ("k", 900): 4, ("z", None): 0, ("z", 7): 1,
                       (None, None): 0, (None, 8): 1}


def test_occurrence_numbers_of_a_hot_key(spark):
    df = spark.range(5000).selectExpr("'k' as k", "case when id = 0 then 1000000000 else id % 1000 end as g", "id as tie")
    got = audit.with_occurrence(df, ["k"], "g", ["tie"]).orderBy("g", "tie").collect()
    assert [r["occurrence"] for r in got] == list(range(5000))


def _seeds(spark):
    scores = atoms(spark, {"m": [("i", "conviction", "initial", 1, 1.0, 0), ("i", "conviction", "initial", 0, 1.0, 1), ("j", "restraint", "s", 0, 1.0, 0)]})
    return audit.seed_records(scores)


def test_seeds_point_at_the_generation_that_missed(spark):
    seeds = {r["item"]: r for r in _seeds(spark).collect()}
    assert seeds["i"]["occurrence"] == 0 and seeds["i"]["generation"] == 1
    assert seeds["i"]["raw_output_pointer"] == "outputs/r/raw/m__i.json#1"
    assert seeds["i"]["audit_id"].startswith("ja_") and len(seeds["i"]["audit_id"]) == 19
    raw = answers(spark, ("i", 0, "setup", "first"), ("i", 1, "setup", "second"), ("j", 0, "response", "only"))
    payloads = {r["item"]: r["saved_model_output"] for r in audit.request_payloads(_seeds(spark), raw).collect()}
    assert payloads == {"i": "second", "j": "only"}


def _judge_lines(spark, seeds, **changes):
    record = {"audit_id": seeds[0]["audit_id"], "judge_model": "j", "recommended_action": "review_key", "rationale": "why",
              **{f: f in ("key_valid", "overstrict") for f in schemas.AUDIT_FLAGS}, **changes}
    wrapped = {"custom_id": seeds[1]["audit_id"], "result": {"message": {"content": [
        {"type": "text", "text": "```json\n" + json.dumps({k: v for k, v in {**record, "recommended_action": "keep", "overstrict": False}.items() if k != "audit_id"}) + "\n```"}]}}}
    return spark.createDataFrame([(json.dumps(record),), (json.dumps(wrapped),)], "value string")


def test_judgments_are_taken_in_whole_or_not_at_all(spark):
    seeds = _seeds(spark).orderBy("item").collect()
    merged = audit.ingest_judgments(_judge_lines(spark, seeds), _seeds(spark))
    rows = {r["item"]: r for r in merged.collect()}
    assert rows["i"]["overstrict"] and rows["j"]["recommended_action"] == "keep" and rows["j"]["graded_model"] == "m"
    summary = {(r["facet"], r["value"]): r for r in audit.summarize(merged).collect()}
    assert summary["all", ""]["records"] == 2 and summary["all", ""]["overstrict"] == 1
    assert summary["action", "keep"]["records"] == 1 and summary["item", "i"]["disputed_miss"] == 1
    assert summary["all", ""]["key_review"] == 1 and summary["model", "m"]["records"] == 2
    with pytest.raises(gates.GateError, match="invalid judge lines"):
        audit.ingest_judgments(_judge_lines(spark, seeds, rationale=""), _seeds(spark))
    broken = _judge_lines(spark, seeds).unionByName(spark.createDataFrame([('{"x": 1}',), ("nope",)], "value string"))
    with pytest.raises(gates.GateError, match="unreadable"):
        audit.ingest_judgments(broken, _seeds(spark))


def test_record_errors(spark):
    seeds = _seeds(spark).withColumn("recommended_action", F.lit("maybe")).withColumn("overstrict", F.lit(None).cast("boolean"))
    errors = gates.judgment_errors(seeds).collect()[0]["errors"]
    assert errors == ["missing judge_model", "overstrict must be boolean", "recommended_action invalid", "non-keep action requires rationale"]


def _board(spark, *rows):
    full = [(m, label, None if succ is None else succ, m.startswith("naive"), ok) for m, label, succ, ok in rows]
    return spark.createDataFrame(full, "model string, label string, superseded_by string, is_baseline boolean, ranked_eligible boolean")


def test_successions(spark):
    board = _board(spark, ("g45", "Orion 4.5", None, True), ("g46", "Orion 4.6", None, True), ("g410", "Orion 4.10", None, True),
                   ("old", "Lyra-5.5", "g46", True), ("k2", "Vega K2", None, True), ("k3", "Vega K3", None, False), ("naive", "Naive 9", None, True))
    got = {r["model"]: r["successor"] for r in generations.successions(board).collect()}
    assert got == {"g45": "g410", "g46": "g410", "old": "g46"}
    current, previous = generations.split(board)
    assert {r["model"] for r in previous.collect()} == set(got)
    assert "naive" in {r["model"] for r in current.collect()}


def test_succession_pairs_are_turned_round(spark):
    board = _board(spark, ("a1", "A 1", None, True), ("a2", "A 2", None, True), ("b1", "B 1", None, True), ("b2", "B 2", None, True),
                   ("c1", "C 1", None, True), ("c2", "C 2", None, True))
    records = spark.createDataFrame([("a1", "a2", -0.05, -0.09, -0.01, 0.001, 9, "a2"), ("b2", "b1", 0.02, 0.001, 0.04, 0.2, 9, None)], schemas.ddl(schemas.PAIRS))
    got = [r.asDict() for r in generations.succession_pairs(board, records).collect()]
    assert [(r["prev"], r["verdict"], r["confidence"]) for r in got] == [
        ("a1", "decisive upgrade", "statistically significant"), ("b1", "slight upgrade", "not conclusive after correction"), ("c1", "not paired", "")]
    assert got[0]["delta"] == pytest.approx(5) and got[0]["lo"] == pytest.approx(1) and got[0]["holm_p"] == 0.001


def test_merging_runs(spark):
    one, two = atoms(spark, {"a": flat([1]), "mock-naive": flat([0])}), atoms(spark, {"b": flat([1])}).withColumn("run_id", F.lit("q"))
    assert {r["model"] for r in ledger.merge_runs(one, two).collect()} == {"a", "b"}
    with pytest.raises(gates.GateError, match="more than one run"):
        ledger.merge_runs(one, one.withColumn("run_id", F.lit("q")))


RUN = "run_id string, run_date string, items_hash string, content_hash string, evaluation_hash string, version string"


def _runs(spark, *rows):
    return spark.createDataFrame(list(rows), RUN)


def _members(spark, run, *models):
    return spark.createDataFrame([(run, m, 1.0) for m in models], "run_id string, model string, score double")


def test_history_rules(spark):
    old, models = _runs(spark, ("r1", "2026-01-01", "h", None, None, "v1")), _members(spark, "r1", "a", "b", "naive")
    same = _runs(spark, ("r2", "2026-02-01", "h", None, None, None)).drop("version")
    out = {r["run_id"]: r["version"] for r in ledger.append_run(old, models, same, _members(spark, "r2", "a", "b", "c")).collect()}
    assert out == {"r1": "v1", "r2": "v1"}
    with pytest.raises(gates.GateError, match="subset"):
        ledger.append_run(old, models, same, _members(spark, "r2", "a"))
    changed = same.withColumn("items_hash", F.lit("other"))
    with pytest.raises(gates.GateError, match="declare a version"):
        ledger.append_run(old, models, changed, _members(spark, "r2", "a", "b"))
    assert ledger.append_run(old, models, changed, _members(spark, "r2", "a", "b"), "v2").filter("version = 'v2'").count() == 1
    replaced = ledger.append_snapshot(old, _runs(spark, ("r1", "2026-01-01", "x", None, None, "v9")))
    assert [r["version"] for r in replaced.collect()] == ["v9"]


def test_late_models(spark):
    runs, models = _runs(spark, ("r1", "2026-01-01", "h", "c", None, "v1")), _members(spark, "r1", "a", "b")
    late, same_bank = _members(spark, "late", "b", "c").withColumn("score", F.lit(2.0)), _runs(spark, ("late", None, "h", "c", None, None))
    got = {r["model"]: (r["run_id"], r["score"]) for r in ledger.merge_models(models, runs, "r1", late, same_bank).collect()}
    assert got == {"a": ("r1", 1.0), "b": ("r1", 2.0), "c": ("r1", 2.0)}
    for bank_row, members, target, message in (
        (same_bank.withColumn("content_hash", F.lit("d")), late, "r1", "another bank"),
        (same_bank, _members(spark, "late", "naive"), "r1", "baseline"),
        (same_bank, late, "nope", "no run"),
    ):
        with pytest.raises(gates.GateError, match=message):
            ledger.merge_models(models, runs, target, members, bank_row)


def test_versions_are_carried_over(spark):
    runs = _runs(spark, ("a", "1", "h", None, None, "v1"), ("b", "2", "h", None, None, None), ("c", "3", "g", None, None, None)).withColumn("scope", F.lit("all"))
    got = {r["run_id"]: (r["effective_version"], r["must_declare"]) for r in ledger.inherit_versions(runs).collect()}
    assert got == {"a": ("v1", False), "b": ("v1", False), "c": (None, True)}


def test_fingerprints(spark):
    cases, keys = case_table(spark, MULTI, SINGLE), key_table(spark, {"id": "c", "type": "conviction", "initial_expected": ["SHIP"], "turns": []},
                                                            {"id": "r", "type": "restraint", "labels": {"b": "SHIP", "a": "KILL"}})
    first = bank.signature(cases, keys, "all", "rules-1").collect()[0]
    shuffled = bank.signature(cases.repartition(3), keys.orderBy(F.desc("id")).withColumn("_path", F.lit("x")), "all", "rules-1").collect()[0]
    assert first == shuffled and first["n_checks"] == 3 and first["n_items"] == 2
    edited = bank.signature(cases, keys.withColumn("initial_expected", F.array(F.lit("KILL"))), "all", "rules-1").collect()[0]
    assert edited["case_hash"] == first["case_hash"] and edited["key_hash"] != first["key_hash"]
    assert bank.signature(cases, keys, "all", "rules-2").collect()[0]["evaluation_hash"] != first["evaluation_hash"]

    signed, other = bank.signature(cases, keys, "all", "rules-1"), bank.signature(cases, keys, "all", "rules-2")
    empty = spark.createDataFrame([], signed.withColumn("run_id", F.lit("")).schema)
    saved = bank.record_manifest(empty, "r1", signed)
    assert bank.record_manifest(saved, "r1", signed).count() == 1
    with pytest.raises(gates.GateError, match="another evaluation"):
        bank.record_manifest(saved, "r1", other)
    assert bank.record_manifest(saved, "r1", other, replace=True).collect()[0]["scorer_hash"] == "rules-2"
    edited_cases = bank.signature(cases.withColumn("prompt", F.lit("Q")), keys, "all", "rules-1")
    with pytest.raises(gates.GateError, match="other case prompts"):
        bank.record_manifest(saved, "r1", edited_cases, replace=True)
    assert bank.manifest_mismatches(saved, signed).count() == 0 and bank.manifest_mismatches(saved, other).count() == 1


def test_roster_hash_is_the_digest_of_sorted_lines(spark):
    import hashlib

    df = spark.createDataFrame([("b",), ("a",), ("b",)], "id string")
    assert df.agg(hashing.roster_hash(F.col("id"))).collect()[0][0] == "sha256:" + hashlib.sha256(b"a\nb").hexdigest()
    assert hashing.set_fingerprint(df, "id").collect()[0]["n_values"] == 2
    shown = spark.range(1).select(hashing.display_hash(F.lit(None).cast("string"), F.lit("sha256:" + "ab" * 32)).alias("d"))
    assert tuple(shown.collect()[0]["d"]) == ("abababababab", "roster hash")


def test_bank_audit(spark):
    cases = case_table(spark, {"id": "a", "type": "honesty", "source": "s"}, {"id": "b", "type": "restraint"}, {"id": "example_x", "type": "restraint"})
    keys = key_table(spark, {"id": "a", "type": "honesty", "landmines": [("l", "", ["fine", "(bad)"])], "false_alarms": []})
    rows, register = spark.createDataFrame([("a",), ("a",)], "id string"), spark.createDataFrame([("b",), ("zz",)], "id string")
    got = {(r["finding"], r["item"], r["detail"]) for r in bank.audit(cases, keys, rows, register).collect()}
    assert got == {("missing_source", "b", ""), ("duplicate_provenance", "a", ""), ("missing_provenance", "b", ""),
                   ("unmatchable_alias", "a", "(bad)"), ("signoff_pending", "b", "")}


def test_leaks(spark):
    items = spark.createDataFrame([("acme_deal_v1",), ("example_x_y",), ("solo",)], "id string")
    tokens = leaks.leak_tokens(items)
    assert {(r["token"], r["kind"]) for r in tokens.collect()} == {("acme_deal_v1", "id"), ("acme_", "prefix"), ("solo", "id")}
    documents = spark.createDataFrame([(1, "about acme_deal_v1 and acme_x"), (2, "soloist"), (3, None), (4, "clean")], "doc_id bigint, text string")
    want = {(1, "acme_deal_v1"), (1, "acme_"), (2, "solo")}
    assert {tuple(r) for r in leaks.find_tokens(documents, tokens, "doc_id").collect()} == want


def test_leaks_by_plain_search(spark):
    words = ["ab", "abcd", "cdab x", " y", "z z", "abcdabcd", "\u00e9t\u00e9", "q", "prefix_one", "prefix_two", "prefix_", "  "]
    texts = ["", None, "xx abcd x y", "prefix_one,prefix_two", "an \u00e9t\u00e9", "abcdabcdab xz z", "cdab  x", "z\nz", "q" * 5000]
    tokens = spark.createDataFrame([(w,) for w in words], "token string")
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = {(i, w) for i, t in enumerate(texts) for w in words if w.strip() and t and w in t}
    found = leaks.find_tokens(documents, tokens, "doc_id")
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    assert "Python" not in found._jdf.queryExecution().toString()


def test_completeness(spark):
    key = {"id": "a", "type": "restraint", "labels": {"x": "SHIP", "y": "KILL"}}
    rules = checks.checks_from_keys(key_table(spark, key))
    expected = cut(rules.select("item", "dimension", "sub"))
    text = json.dumps({"classifications": {"x": "SHIP", "y": "SHIP"}})
    raw = answers(spark, ("a", 0, "response", text), ("a", 1, "response", text))
    models = spark.createDataFrame([("m", "openai"), ("absent", "openai")], "name string, provider string")
    graded = cut(grade.grade(raw, rules))

    def errors(requested, raw, saved, graded):
        out = coverage.completeness_errors(requested, models, raw, saved, graded, expected, 2, dimensions=("restraint",))
        return {(r["model"], r["error"]) for r in out.collect()}

    assert errors(["m"], raw, graded, graded) == set()
    assert errors(["m", "absent", "who"], raw, graded, graded) == {("who", "unknown requested model")}
    assert errors(["m", "absent"], raw, graded, graded) == {("absent", "score file missing")}
    left = answers(spark, *[("gone", g, "response", "{}") for g in range(5)])
    assert errors(["m"], raw.unionByName(left), graded, graded) == set()
    signed = spark.createDataFrame([("all", "h1")], "scope string, evaluation_hash string")
    for old, want in ((signed, set()), (signed.withColumn("evaluation_hash", F.lit("h0")), {"saved evaluation fingerprint does not match"}),
                      (signed.where("false"), {"saved bank manifest missing"})):
        out = coverage.completeness_errors(["m"], models, raw, graded, graded, expected, 2, dimensions=("restraint",), recorded=old, current=signed)
        assert {r["error"] for r in out.collect()} == want
    out = coverage.completeness_errors(["m"], models, raw, graded, graded, expected, 2)
    assert {r["error"] for r in out.collect()} == {"score coverage incomplete"}
    garbled = raw.withColumn("text", F.when(F.col("generation") == 1, "??").otherwise(F.col("text")))
    assert errors(["m"], garbled, graded, grade.grade(garbled, rules)) == {("m", "raw generations incomplete")}
    renamed = graded.withColumn("sub", F.when(F.col("sub") == "x", "z").otherwise(F.col("sub")))
    assert errors(["m"], raw, renamed, graded) == {("m", "score coverage incomplete"), ("m", "saved scores do not match regrade")}
    flipped = graded.withColumn("correct", ~F.col("correct"))
    assert errors(["m"], raw, flipped, graded) == {("m", "saved scores do not match regrade")}
    surplus = answers(spark, *[("a", g, "response", text) for g in range(3)])
    assert ("m", "raw generations unexpected") in errors(["m"], surplus, graded, grade.grade(surplus, rules))


def test_gaps_of_one_run(spark):
    expected = spark.createDataFrame([("r", "a", "restraint", s) for s in "xyz"], "run_id string, item string, dimension string, sub string")
    seen = spark.createDataFrame([("r", "m", "a", "restraint", "x", 2), ("r", "m", "a", "restraint", "y", 1), ("r", "m", "a", "restraint", "q", 1)],
                                 "run_id string, model string, item string, dimension string, sub string, n bigint")
    roster = spark.createDataFrame([("r", "m", 2)], "run_id string, model string, generations bigint")
    got = {(r["sub"], r["status"]) for r in coverage.coverage_gaps(seen, expected, roster, ["run_id"]).collect()}
    assert got == {("y", "short"), ("z", "missing"), ("q", "unexpected")}


def test_gates(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "id string")
    assert [tuple(r) for r in gates.duplicate_ids(df, "id").collect()] == [("a", 2)]
    new, prior = spark.createDataFrame([("a",)], "model string"), spark.createDataFrame([("a",), ("b",)], "model string")
    assert gates.strict_subset(new, prior) and not gates.strict_subset(prior, prior) and not gates.strict_subset(prior, new)
    traces = spark.createDataFrame([("MAX_TOKENS",), ("stop",), (None,)], "finish_reason string")
    assert gates.truncated(traces).count() == 1
    diff = gates.multiset_difference(df, spark.createDataFrame([("a",), ("b",), ("b",)], "id string"), ["id"])
    assert {r["id"]: r["excess"] for r in diff.collect()} == {"a": 1, "b": -1}
    assert [r["id"] for r in gates.missing_from(df, spark.createDataFrame([("b",)], "id string"), "id").collect()] == ["a"]


def test_registry_meta(spark):
    blank = dict.fromkeys(schemas.MODELS)
    rows = [{**blank, "name": "a", "id": "a-2026-03-05"}, {**blank, "name": "b", "label": "B", "released": "2025-01-01", "id": "b-20260101"}]
    df = spark.createDataFrame([tuple(r[c] for c in schemas.MODELS) for r in rows], schemas.ddl(schemas.MODELS))
    assert [(r["label"], r["released"]) for r in with_meta(df).orderBy("name").collect()] == [("a", "2026-03-05"), ("B", "2025-01-01")]


def test_floor_and_history(spark):
    board = spark.createDataFrame([("r1", "x", 90.0), ("r1", "a", 90.0), ("r1", "naive", 39.14)], "run_id string, model string, score double")
    assert rank.best_per_run(board).collect()[0]["best_model"] == "a"
    assert rank.naive_floor(board).collect()[0]["naive_floor"] == 39.1


def test_payloads_do_not_grade_the_answers_anew_for_every_use(spark, data):
    """Numbering and joining read what was graded once: no answer is parsed in the last plan."""
    from evalgrid.plans.run_queries import audit_payloads

    plan = audit_payloads(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "parse_json" not in plan.lower() and "parsejson" not in plan.lower() and "lineitem" not in plan


def test_a_usage_count_is_looked_up_once_in_a_line(spark):
    from evalgrid.plans import vendor_text

    events = spark.createDataFrame([(1, 2, "view", 3.0, '{"k": 4}')], "event_id bigint, user_id bigint, event_type string, value double, props string")
    lines = vendor_text.result_lines(events)
    found = requests.normalize_results(lines, vendor_text.manifest(events))
    assert found.select("usage.*").first().asDict() == {"input_tokens": 4, "output_tokens": 3, "total_tokens": 7, "cached_input_tokens": None}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$.candidatesTokenCount") == plan.count("$.prompt_token_count") == 1
