"""Digest trees, versioned histories, and files written by name."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from evalgrid.operators import digest_tree, gates
from evalgrid.sources import commits, files, responses
from evalgrid.sources import scores as score_files

LEVELS = ["dimension", "item"]
ROWS = "dimension string, item string, id bigint, content map<string,string>, _private int"


def _tree(spark, path, *rows):
    digest_tree.write_tree(spark.createDataFrame(list(rows), ROWS), LEVELS, "id", str(path))
    return str(path)


def _changes(spark, old, new):
    nodes = digest_tree.changed_nodes(spark, old, new, LEVELS, "id")
    return [sorted(tuple(r) for r in n.collect()) for n in nodes], nodes


def test_changes_are_named_on_every_level(spark, tmp_path):
    same = ("d", "same", 1, {"a": "x"}, 1)
    old = _tree(spark, tmp_path / "old", same, ("d", "i", 1, {"a": "x"}, 1), ("d", "i", 2, {"a": "y"}, 1), ("gone", "g", 1, None, 1))
    new = _tree(spark, tmp_path / "new", ("d", "same", 1, {"a": "x"}, 99), ("d", "i", 1, {"a": "x", "b": ""}, 1),
                ("d", "i", 3, {"a": "y"}, 1), ("e", "h", 1, None, 1))
    found, nodes = _changes(spark, old, new)
    assert found == [
        [("edited",)],
        [("d", "edited"), ("e", "added"), ("gone", "removed")],
        [("d", "i", "edited"), ("e", "h", "added"), ("gone", "g", "removed")],
        [("d", "i", 1, "edited"), ("d", "i", 2, "removed"), ("d", "i", 3, "added"), ("e", "h", 1, "added"), ("gone", "g", 1, "removed")],
    ]
    items = digest_tree.changed_items(nodes, LEVELS, "id").collect()
    assert {(r["item"], r["n_added"], r["n_removed"], r["n_edited"]) for r in items} == {("i", 1, 1, 1), ("h", 1, 0, 0), ("g", 0, 1, 0)}


def test_equal_trees_end_at_the_top(spark, tmp_path):
    rows = [("d", "i", n, {"b": "1", "a": "2"}, n) for n in range(50)]
    old = _tree(spark, tmp_path / "a", *rows)
    again = _tree(spark, tmp_path / "b", *[(d, i, n, {"a": "2", "b": "1"}, 0) for d, i, n, _, _ in reversed(rows)])
    assert _changes(spark, old, again)[0] == [[], [], [], []]


def test_odd_rows(spark, tmp_path):
    """Null names are names, repeated rows count, an empty bank has a top only."""
    twice = [(None, None, None, None, None)] * 2
    one, two = _tree(spark, tmp_path / "one", twice[0]), _tree(spark, tmp_path / "two", *twice)
    assert _changes(spark, one, two)[0][-1] == [(None, None, None, "edited")]
    none = _tree(spark, tmp_path / "none")
    assert _changes(spark, none, none)[0] == [[], [], [], []]
    assert _changes(spark, none, one)[0][-1] == [(None, None, None, "added")]
    assert _changes(spark, one, none)[0][1:] == [[(None, "removed")], [(None, None, "removed")], [(None, None, None, "removed")]]


RUNS = "run_id string, model string, n int"


def _put(spark, *rows):
    return lambda base: spark.createDataFrame(list(rows), RUNS)


def _all(history, number=None):
    return sorted(tuple(r) for r in history.read(number).collect())


def test_a_commit_replaces_its_runs(spark, tmp_path):
    history = commits.History(spark, str(tmp_path / "h"), RUNS)
    assert _all(history) == [] and history.version().number == 0
    assert history.commit(_put(spark, ("2026-01-01", "a", 1), ("r/ 2=%", "a", 1))).number == 1
    assert history.commit(_put(spark, ("r/ 2=%", "b", 2))).number == 2
    assert _all(history) == [("2026-01-01", "a", 1, 1), ("r/ 2=%", "b", 2, 2)]
    assert _all(history, 1) == [("2026-01-01", "a", 1, 1), ("r/ 2=%", "a", 1, 1)]
    assert history.commit(_put(spark)).number == 2  # nothing to write
    with pytest.raises(gates.GateError, match="run id"):
        history.commit(_put(spark, (None, "a", 1)))
    assert history.version().number == 2


def test_a_refusal_and_a_lost_writer_change_nothing(spark, tmp_path, monkeypatch):
    history = commits.History(spark, str(tmp_path / "h"), RUNS)
    history.commit(_put(spark, ("r", "a", 1)))

    def refuse(base):
        gates.must_be_empty(base, "refused")
        return base

    with pytest.raises(gates.GateError, match="refused"):
        history.commit(refuse)

    def lost(*_):
        raise ConnectionError

    with monkeypatch.context() as patched:
        patched.setattr(files, "claim", lost)
        with pytest.raises(ConnectionError):
            history.commit(_put(spark, ("r", "lost", 9)))
    assert _all(history) == [("r", "a", 1, 1)] and len(history.orphans()) == 1
    assert history.commit(_put(spark, ("r", "b", 2))).number == 2
    assert _all(history) == [("r", "b", 2, 2)]


def test_two_writers_both_count(spark, tmp_path):
    """Who comes second judges its change again on what the first one left."""
    path, calls = str(tmp_path / "h"), []
    commits.History(spark, path, RUNS).commit(_put(spark, ("r", "sum", 0)))
    ready = threading.Barrier(2)

    def add(base):
        calls.append(1)
        if len(calls) <= 2:
            ready.wait(60)
        return base.withColumn("n", F.col("n") + 1)

    writers = [threading.Thread(target=lambda: commits.History(spark, path, RUNS).commit(add)) for _ in range(2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join(120)
    history = commits.History(spark, path, RUNS)
    assert _all(history) == [("r", "sum", 2, 3)] and len(calls) == 3 and len(history.orphans()) == 1


def test_claim_makes_one_whole_file(spark, tmp_path):
    place = str(tmp_path / "x" / "1.json")
    assert files.claim(spark, place, "one") and not files.claim(spark, place, "two")
    assert files.read_text(spark, place) == "one" and files.names(spark, str(tmp_path / "x")) == ["1.json"]


def test_entries_are_files_by_name(spark, tmp_path):
    rows = [("m", "i__x", 0, '"a"'), ("m", "i__x", 2, '{"setup": "s", "t1": "\\u00e9\\n"}'), ("m{2},*", "i", 0, '"other"'), ("n", "i", 0, "3")]
    responses.write_entries(spark.createDataFrame(rows, "model string, item string, generation bigint, entry string"), str(tmp_path / "raw"))
    assert sorted(p.name for p in (tmp_path / "raw").iterdir() if p.suffix == ".json" and p.name[0] != ".") == ["m__i__x.json", "m{2},*__i.json", "n__i.json"]
    assert json.loads((tmp_path / "raw" / "m__i__x.json").read_text()) == ["a", "", {"setup": "s", "t1": "é\n"}]

    def read(models=None):
        found = responses.read_responses(spark, str(tmp_path / "raw"), "r", models)
        return {(r["model"], r["item"], r["generation"], r["turn_id"]): r["text"] for r in found.collect()}, len(found.inputFiles())

    everything, n_files = read()
    assert n_files == 3 and everything["m", "i__x", 2, "t1"] == "é\n" and everything["m", "i__x", 1, "response"] == ""
    some, n_files = read(["m"])
    assert n_files == 1 and some == {k: v for k, v in everything.items() if k[0] == "m"}
    assert set(read(["m{2},*"])[0]) == {("m{2},*", "i", 0, "response")}
    # a file written again is replaced
    responses.write_entries(spark.createDataFrame([("n", "i", 0, '"new"')], "model string, item string, generation bigint, entry string"), str(tmp_path / "raw"))
    assert read(["n"])[0] == {("n", "i", 0, "response"): "new"}


def test_entries_in_a_pack_read_like_files(spark, tmp_path):
    rows = [("m", "i__x", 0, '"a"'), ("m", "i__x", 2, '{"setup": "s", "t1": "\\u00e9\\n"}'), ("m{2},*", "i %2F/", 0, '"other"'), ("n", "i", 0, "3")]
    entries = spark.createDataFrame(rows, "model string, item string, generation bigint, entry string")
    responses.write_entries(entries, str(tmp_path / "raw"), packed=True)

    def read(models=None):
        found = responses.read_responses(spark, str(tmp_path / "raw"), "r", models).collect()
        return {(r["model"], r["item"], r["generation"], r["turn_id"]): r["text"] for r in found}

    assert read() == {
        ("m", "i__x", 0, "response"): "a", ("m", "i__x", 1, "response"): "", ("m", "i__x", 2, "setup"): "s",
        ("m", "i__x", 2, "t1"): "é\n", ("m{2},*", "i %2F/", 0, "response"): "other",
    }
    assert set(read(["m{2},*"])) == {("m{2},*", "i %2F/", 0, "response")} and read([]) == {}
    with pytest.raises(Exception, match="without a name"):
        responses.write_entries(entries.withColumn("model", F.lit(None).cast("string")), str(tmp_path / "none"), packed=True)


def test_score_files_keep_their_order(spark, tmp_path):
    rows = [("m", n, "i", "d", f"s{n % 3}", n % 2 == 0, 0.5) for n in range(300)]
    scores = spark.createDataFrame(rows, "model string, at int, item string, dimension string, sub string, correct boolean, weight double")
    score_files.write_score_files(scores.repartition(5), str(tmp_path / "scores"), ["at"])
    got = score_files.read_score_files(spark, str(tmp_path / "scores"), "r").orderBy("position").collect()
    assert [(r["sub"], r["correct"], r["generation"]) for r in got] == [(s, c, at // 3) for _, at, _, _, s, c, _ in rows]


def test_packed_score_files_read_as_loose_ones(spark, tmp_path):
    rows = [(f"m{n % 7}", n, "i", "d", f"s{n % 3}", n % 2 == 0, 0.5) for n in range(200)]
    scores = spark.createDataFrame(rows, "model string, at int, item string, dimension string, sub string, correct boolean, weight double")
    loose, pack = str(tmp_path / "loose"), str(tmp_path / "pack")
    score_files.write_score_files(scores, loose, ["at"])
    score_files.write_score_files(scores, pack, ["at"], packed=True)
    assert not [p for p in (tmp_path / "pack").rglob("*.json")]
    odd = spark.createDataFrame([("bad.json", "[{"), ("none.json", "[]"), ("one.json", '{"item": "i", "sub": "s"}')], "name string, value string")
    files.write_named(odd, loose)
    odd.select("name", "value").write.mode("append").parquet(f"{pack}/packed")
    read = [sorted(map(repr, score_files.read_score_files(spark, path, "r").collect())) for path in (loose, pack)]
    assert len(read[0]) == 202 and read[0] == read[1]
