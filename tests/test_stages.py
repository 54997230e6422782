"""The state of turns and the loop of staged batches."""

import json

from helpers import case_table
from pyspark.sql import functions as F
from test_runs import MODELS, MULTI, SINGLE

from evalgrid import schemas
from evalgrid.operators import requests
from evalgrid.sources import files
from evalgrid.streaming import ingest
from evalgrid.streaming.stages import StagedRun
from evalgrid.streaming.state import TurnState

MODEL_TYPES = ("name string, provider string, id string, price_in double, price_out double, price_cached_in double, "
               "batch_discount double, batch_supported boolean")
SYSTEM = "S"


def _line(cid, text=None, at=None):
    body = {"error": {"code": "x"}} if text is None else {"response": {"status_code": 200, "body": {"output_text": text}}}
    return json.dumps({"custom_id": cid, "written_at": at, **body})


def _deliver(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines))


def _seen(df):
    return sorted(map(str, df.collect()))


def test_state_follows_late_and_repeated_lines(spark, tmp_path):
    rows = [(f"q{g}", "r", 1, "i", g, "response", "s", "openai", "m", "m-1", 1.0, 2.0, None, 0.5) for g in range(4)]
    asked = spark.createDataFrame(rows, schemas.ddl(schemas.MANIFEST))
    lines, log = tmp_path / "lines", str(tmp_path / "log")

    def take_in():
        ingest.ingest_results(
            spark, str(lines), asked, log, str(tmp_path / "marks"), written_at="$.written_at"
        ).awaitTermination()
        state = TurnState(spark, log, str(tmp_path / "state"))  # as in a new session
        state.follow()
        return state

    _deliver(lines, "1", _line("q0", "new", 9), _line("q3", "x", 1), _line("nobody", "y", 1), "no json")
    state = take_in()
    assert {r["generation"]: r["answer"] for r in state.turns().collect()} == {0: "new", 3: "x"}
    assert state.responses(padded=True).count() == 4
    _deliver(lines, "2", _line("q0", "late but old", 5), _line("q3", None, 2), _line("q0", "new", 9))
    _deliver(lines, "3", _line("q1", None, 1))
    state = take_in()
    found = {r["generation"]: (r["answer"], r["error"] is not None, r["n_calls"]) for r in state.turns().collect()}
    assert found == {0: ("new", False, 3), 1: (None, True, 1), 3: ("x", True, 2)}
    state.follow()  # nothing new
    logged = ingest.read_log(spark, log)
    columns = ["run_id", "model", "item", "generation", "turn_id", "text"]
    for padded in (False, True):
        assert _seen(state.responses(padded).select(columns)) == _seen(ingest.current_responses(logged, padded).select(columns))
    assert _seen(state.traces()) == _seen(ingest.current_traces(logged).select(state.traces().columns))


def test_owed_turns_are_all_there_once(spark):
    models = spark.createDataFrame([(f"m{n}",) for n in range(7)], "model string")
    plan = requests.turn_plan(case_table(spark, MULTI, SINGLE))
    got = requests.owed_turns(plan, models, 3)
    want = [(f"m{n}", turn, g) for n in range(7) for turn in ("setup", "t1", "t2", "response") for g in range(3)]
    assert sorted((r["model"], r["turn_id"], r["generation"]) for r in got.collect()) == sorted(want)
    assert requests.owed_turns(plan, models.limit(0), 3).count() == 0
    assert not got.filter(F.col("position").isNull()).count()


def _run(spark, base):
    models = spark.createDataFrame(MODELS, MODEL_TYPES)
    return StagedRun(spark, str(base), models, case_table(spark, MULTI, SINGLE), 1, "r1", system=SYSTEM)


def test_a_run_goes_on_from_its_folder(spark, tmp_path):
    base = tmp_path / "run"
    first = {r["item"]: r for r in _run(spark, base).ask().collect()}
    assert {(i, r["turn_id"], r["stage"]) for i, r in first.items()} == {("c", "setup", 1), ("r", "response", 1)}
    _deliver(base / "lines", "1", _line(first["c"]["custom_id"], "A0"), _line(first["r"]["custom_id"]))
    _run(spark, base).take_in()
    second = {r["item"]: r for r in _run(spark, base).ask().collect()}
    assert {(i, r["turn_id"], r["stage"]) for i, r in second.items()} == {("c", "t1", 2), ("r", "response", 2)}
    assert [m["content"] for m in second["c"]["messages"]] == [SYSTEM, "go?", "A0", "sure?"]
    assert _run(spark, base).asked().count() == 4
    assert not files.exists(spark, str(base / "nowhere"))


def test_a_run_settles(spark, tmp_path):
    """All that can be answered is, and what stays open is asked once more than it moves the run on."""
    def send(replies):
        def put(stage, folder):
            rows = stage.select("custom_id", "item", "turn_id", "stage").collect()
            lines = [_line(r["custom_id"], replies.get((r["item"], r["turn_id"]))) for r in rows]
            spark.createDataFrame([(v,) for v in lines], "value string").write.mode("append").text(folder)
        return put

    everything = {("c", "setup"): "a", ("c", "t1"): "b", ("c", "t2"): "c", ("r", "response"): "d"}
    full = _run(spark, tmp_path / "full")
    full.settle(send(everything))
    assert full.asked().filter("item = 'c'").count() == 3 and full.asked().filter("item = 'r'").count() == 1
    assert full.answers().count() == 4 and full.ask().isEmpty()

    stuck = _run(spark, tmp_path / "stuck")
    stuck.settle(send({k: v for k, v in everything.items() if k != ("c", "t1")}))
    found = sorted((r["item"], r["turn_id"], r["stage"]) for r in stuck.asked().collect())
    assert found == [("c", "setup", 1), ("c", "t1", 2), ("r", "response", 1)]
