"""Plans and folders that decide whether a query grows with its tables."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from evalgrid.operators import digest_tree
from evalgrid.plans import grade_queries, store_queries, version_queries


def test_cases_lie_in_one_folder(spark, data, tmp_path, monkeypatch):
    monkeypatch.setattr(store_queries, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    rows = store_queries.cases_read(spark, data).count()
    suppliers = spark.read.parquet(f"{data}/supplier.parquet")
    names = {r["s_suppkey"] for r in suppliers.select("s_suppkey").collect()}
    assert {n for n in os.listdir(tmp_path / "cases") if n.endswith(".json")} == {f"{k}.json" for k in names}
    assert rows == suppliers.filter("s_acctbal >= 0").count()


@pytest.mark.parametrize("name", ["traces_roundtrip", "responses_roundtrip"])
def test_saved_runs_lie_in_few_files(spark, data, tmp_path, monkeypatch, name):
    """As many as tasks wrote, not one per model and item."""
    monkeypatch.setattr(version_queries, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    rows = getattr(version_queries, name)(spark, data)
    assert len(rows.inputFiles()) <= 8 < rows.select("model", "item").distinct().count()
    orders = spark.read.parquet(f"{data}/orders.parquet").selectExpr("count(*) + count_if(floor(o_orderkey / 64) % 3 = 0)")
    assert rows.count() == orders.first()[0]


def test_a_level_of_a_tree_shuffles_once(spark):
    children = spark.range(40).select((F.col("id") % 3).alias("item"), "id", F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    level = digest_tree._level(children, ["item"], "id")
    assert level._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {r["item"]: r["n_children"] for r in level.collect()} == {0: 14, 1: 13, 2: 13}
    assert level.select("digest").distinct().count() == 3


def test_texts_stay_where_they_are_read(spark, data):
    """The rules go to the texts: the texts are neither broadcast nor dealt by item."""
    plan = grade_queries.honesty_grade(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan and "SortMergeJoin" not in plan
