"""Files in and out, and the result stream."""

import csv
import glob
import json

import pytest
from pyspark.sql import functions as F

from evalgrid import schemas
from evalgrid.operators import cost, requests
from evalgrid.sources import bank, batch_files, judge_files, ledger, responses, scores
from evalgrid.streaming import ingest
from helpers import atoms, flat


def _write(folder, name, value):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))


def test_bank_documents(spark, tmp_path):
    _write(tmp_path, "cases/deep/b.json", {"id": "b", "type": "restraint", "features": [{"id": "f", "label": "F"}]})
    _write(tmp_path, "cases/a.json", {"id": "a", "type": "conviction", "turns": [{"id": "t", "content": "c"}]})
    _write(tmp_path, "cases/none.json", {"type": "restraint"})
    _write(tmp_path, "keys/a.json", {"id": "a", "type": "conviction", "initial_expected": ["SHIP"], "turns": [{"id": "t", "pass_if_in": ["SHIP"], "weight": 2.0}]})
    cases = {r["id"]: r for r in bank.read_cases(spark, str(tmp_path / "cases")).collect()}
    assert set(cases) == {"a", "b"} and cases["b"]["features"][0]["label"] == "F" and cases["b"]["_path"].endswith("b.json")
    keys = bank.read_keys(spark, str(tmp_path / "keys")).collect()
    assert keys[0]["turns"][0]["weight"] == 2.0 and keys[0]["turns"][0]["strict_hold"] is None


def test_registry(spark, tmp_path):
    _write(tmp_path, "models.json", '{"name": "a", "id": "x-20260101"}\n{"name": "b", "label": "B", "price_in": 1.5}\n')
    got = {r["name"]: (r["label"], r["released"], r["price_in"]) for r in bank.read_models(spark, str(tmp_path / "models.json")).collect()}
    assert got == {"a": ("a", "2026-01-01", None), "b": ("B", None, 1.5)}


def test_responses_and_traces(spark, tmp_path):
    _write(tmp_path, "raw/my model__it__em.json", ["first", "second"])
    _write(tmp_path, "raw/m__c.json", [{"setup": "a", "t1": "b"}, {"setup": "c"}])
    _write(tmp_path, "raw/broken__x.json", "not json")
    _write(tmp_path, "raw/notes.json", "[]")
    got = {(r["model"], r["item"], r["generation"], r["turn_id"]): r["text"] for r in responses.read_responses(spark, str(tmp_path / "raw"), "r").collect()}
    assert got == {
        ("my model", "it__em", 0, "response"): "first", ("my model", "it__em", 1, "response"): "second",
        ("m", "c", 0, "setup"): "a", ("m", "c", 0, "t1"): "b", ("m", "c", 1, "setup"): "c",
    }
    trace = {"text": "x", "provider": "p", "model": "served", "run_mode": "live", "usage": {"input_tokens": 3}, "cost_usd": 0.5}
    _write(tmp_path, "traces/m__r.json", [trace, trace])
    _write(tmp_path, "traces/m__c.json", [{"setup": trace, "t1": {**trace, "cost_usd": None}}])
    rows = responses.read_traces(spark, str(tmp_path / "traces"), "r")
    assert {(r["item"], r["generation"], r["turn_id"]) for r in rows.collect()} == {("r", 0, "response"), ("r", 1, "response"), ("c", 0, "setup"), ("c", 0, "t1")}
    total = cost.cost_summary(rows, ["model"]).collect()[0]
    assert (total["requests"], total["input_tokens"], total["estimated_cost_usd"]) == (4, 12, 1.5)


def test_score_store(spark, tmp_path):
    store, trail = str(tmp_path / "store"), str(tmp_path / "trail")
    scores.write_scores(atoms(spark, {"a": flat([1, 0]), "b": flat([1])}), store)
    scores.write_scores(atoms(spark, {"a": flat([0])}), store)  # replaces a, leaves b
    got = scores.read_scores(spark, store, "r").groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("c"))
    assert {r["model"]: (r["n"], r["c"]) for r in got.collect()} == {"a": (1, 0), "b": (1, 1)}
    assert "PartitionFilters: [isnotnull(run_id" in scores.read_scores(spark, store, "r")._jdf.queryExecution().toString()
    scores.write_audit_trail(atoms(spark, {"a": flat([1, 0])}), trail)
    rows = [row for path in glob.glob(f"{trail}/*.csv") for row in csv.DictReader(open(path))]
    assert sorted(r["correct"] for r in rows) == ["0", "1"] and list(rows[0]) == ["model", "item", "dimension", "sub", "correct", "weight"]


def test_score_files(spark, tmp_path):
    _write(tmp_path, "m-1.json", [{"item": "i", "dimension": "honesty", "sub": "s", "correct": True, "weight": 1.0}] * 2)
    rows = scores.read_score_files(spark, str(tmp_path), "r").collect()
    assert len(rows) == 2 and rows[0]["model"] == "m-1" and rows[0]["correct"]


def test_judge_files(spark, tmp_path):
    df = spark.createDataFrame([("x", None, 1)], "b string, c string, a int")
    judge_files.write_lines(df, str(tmp_path / "out"))
    assert [r["value"] for r in judge_files.read_lines(spark, str(tmp_path / "out")).collect()] == ['{"a":1,"b":"x","c":null}']
    payload = spark.createDataFrame([("ja_1", "text")], "audit_id string, saved_model_output string")
    judge_files.write_requests(payload, str(tmp_path / "req"), "judge", "Review.")
    line = json.loads(judge_files.read_lines(spark, str(tmp_path / "req")).collect()[0]["value"])
    assert line["custom_id"] == "ja_1" and json.loads(line["body"]["input"]) == {"audit_id": "ja_1", "saved_model_output": "text"}


def test_ledger_files(spark, tmp_path):
    path = str(tmp_path / "runs")
    ledger.write_runs(spark.createDataFrame([("r1", 1), ("r2", 1)], "run_id string, v int"), path)
    ledger.write_runs(spark.createDataFrame([("r1", 2)], "run_id string, v int"), path)
    assert {r["run_id"]: r["v"] for r in ledger.read_runs(spark, path).collect()} == {"r1": 2, "r2": 1}
    _write(tmp_path, "pairs/p.json", [{"a": "x", "b": "y", "delta": 0.1, "lo": 0.0, "hi": 0.2, "holm_p": 0.5, "n_items": 3, "winner": None}])
    assert ledger.read_pairs(spark, str(tmp_path / "pairs")).collect()[0]["n_items"] == 3


def _manifest_row(cid, item, generation, turn):
    return (cid, "r1", 1, item, generation, turn, "s", "openai", "m", "m-1", 1.0, 1.0, None, 1.0)


def _line(cid, text):
    return json.dumps({"custom_id": cid, "response": {"body": {"output_text": text, "usage": {"input_tokens": 1, "output_tokens": 1}}}})


@pytest.mark.parametrize("max_files", [1, 10])
def test_results_arrive_in_any_order(spark, tmp_path, max_files):
    manifest = spark.createDataFrame(
        [_manifest_row("q1", "c", 0, "setup"), _manifest_row("q2", "c", 1, "t1"), _manifest_row("q3", "r", 0, "response")],
        schemas.ddl(schemas.MANIFEST))
    lines, log, marks = (str(tmp_path / n) for n in ("lines", "log", "marks"))

    def run():
        ingest.ingest_results(spark, lines, manifest, log, marks, max_files=max_files).awaitTermination()
        return ingest.read_log(spark, log)

    import os
    import time

    _write(tmp_path, "lines/1.jsonl", "\n".join([_line("q2", "early"), "", _line("nobody", "x")]))
    os.utime(tmp_path / "lines/1.jsonl", (time.time() - 100, time.time() - 100))
    _write(tmp_path, "lines/2.jsonl", "\n".join([_line("q1", "first"), _line("q1", "second"), json.dumps({"custom_id": "q3", "error": {"code": 1}})]))
    found = run()
    current = {(r["item"], r["generation"], r["turn_id"]): r["text"] for r in ingest.current_responses(found).collect()}
    assert current == {("c", 0, "setup"): "second", ("c", 1, "t1"): "early"}
    assert {r["outcome"]: r["n"] for r in ingest.ingest_counts(found).collect()} == {"merged": 3, "error": 1, "unknown": 1}
    errors = {r["item"]: r["error"] for r in ingest.current_traces(found).collect() if r["error"]}
    assert json.loads(errors["r"]) == {"code": 1}

    _write(tmp_path, "lines/3.jsonl", "\n".join([_line("q3", "at last"), _line("q2", "late")]))
    found = run()  # only the new file is read
    current = {(r["item"], r["generation"], r["turn_id"]): r["text"] for r in ingest.current_responses(found).collect()}
    assert current == {("c", 0, "setup"): "second", ("c", 1, "t1"): "late", ("r", 0, "response"): "at last"}
    assert ingest.current_responses(found, padded=True).count() == 3
    ingest.compact(found, str(tmp_path / "small"))
    small = ingest.read_log(spark, str(tmp_path / "small"))
    assert small.count() < found.count() and small.filter("outcome = 'unknown'").count() == 1
    for view in (ingest.current_responses, ingest.current_traces):
        assert sorted(map(str, view(small).collect())) == sorted(map(str, view(found).collect()))
    assert not any(r["parse_ok"] for r in ingest.current_traces(found).collect())


def test_request_files(spark, tmp_path):
    rows = spark.createDataFrame([("q1", "m", 1, "m-1", [("user", "hi")], 100)],
                                 "custom_id string, model string, stage int, model_id string, messages array<struct<role:string,content:string>>, max_tokens int")
    batch_files.write_requests(rows, str(tmp_path / "req"))
    batch_files.write_manifest(rows, str(tmp_path / "man"))
    line = batch_files.read_request_lines(spark, str(tmp_path / "req")).collect()[0]
    assert line["model"] == "m" and json.loads(line["value"])["body"]["messages"] == [{"role": "user", "content": "hi"}]
    assert batch_files.read_manifest(spark, str(tmp_path / "man")).collect()[0]["created_at"] is not None
    _write(tmp_path, "res.jsonl", "a\n\n  \nb")
    _write(tmp_path, "err.jsonl", "c")
    found = batch_files.read_result_lines(spark, str(tmp_path / "res.jsonl"), str(tmp_path / "err.jsonl"))
    assert {r["value"] for r in found.collect()} == {"a", "b", "c"}
