"""Registered queries against their SQL, and what their plans must look like."""

import pathlib

import duckdb
import pytest

import __spark_entry__ as entry_points
from evalgrid.plans import catalog, views

#: Quick ones only; tools/check_oracle.py runs them all.
QUICK = ("headline_board", "coverage_board", "difficulty", "paired_diff", "conviction_grade", "kappa",
         "usage_cost", "judge_summary", "lineage", "leak_scan", "pending_turns")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in pathlib.Path("/root/testdata/sf0.001").glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(round(v, 9) if isinstance(v := r[i], float) else v for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_its_sql(spark, data, sql, name):
    df = catalog.queries()[name](spark, data)
    cursor = sql.execute(catalog.oracles()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, df.collect()) == _rows(columns, cursor.fetchall())


def test_every_oracle_belongs_to_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert len(entry_points.queries()) >= 70


def test_entry_runs(spark):
    assert entry_points.entry(spark).count() > 0


def test_scan_reads_only_what_a_score_needs(spark, data):
    plan = catalog.queries()["dimension_scores"](spark, data)._jdf.queryExecution().toString()
    read = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert "l_extendedprice" not in read and "l_orderkey" not in read and "l_shipdate" not in read


def test_no_plan_of_scores_and_grades_multiplies_rows(spark, data):
    for name in ("coverage_gaps", "paired_diff", "restraint_grade", "conviction_grade", "leak_scan", "successions"):
        plan = catalog.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_scores_view_is_whole(spark, data):
    assert views.scores(spark, data).count() == views.table(spark, data, "lineitem").count()


def test_the_rest_registers_without_the_training_package(monkeypatch):
    import importlib.util

    found = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *rest: None if name.startswith("evalgrid.llm") else found(name, *rest))
    assert set(entry_points.queries()) == set(catalog.queries())
    assert set(entry_points.oracle_sql()) == set(catalog.oracles())
