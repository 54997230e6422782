"""Small literal tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalgrid import schemas

_BLANK_KEY = dict.fromkeys(schemas.KEYS)


def key_table(spark: SparkSession, *keys: dict) -> DataFrame:
    rows = [tuple({**_BLANK_KEY, **k}[c] for c in schemas.KEYS) for k in keys]
    return spark.createDataFrame(rows, schemas.ddl(schemas.KEYS)).coalesce(1)


def case_table(spark: SparkSession, *cases: dict) -> DataFrame:
    blank = dict.fromkeys(schemas.CASES)
    rows = [tuple({**blank, **c}[f] for f in schemas.CASES) for c in cases]
    return spark.createDataFrame(rows, schemas.ddl(schemas.CASES)).coalesce(1)


def answers(spark: SparkSession, *rows: tuple) -> DataFrame:
    """(item, generation, turn_id, text) of model ``m`` in run ``r``."""
    full = [("r", "m", item, generation, turn, text) for item, generation, turn, text in rows]
    return spark.createDataFrame(full, schemas.ddl(schemas.RESPONSES)).coalesce(1)


def atoms(spark: SparkSession, per_model: dict[str, list[tuple]]) -> DataFrame:
    """Score rows from (item, dimension, sub, correct, weight[, generation])."""
    rows = [
        ("r", model, item, dimension, sub, (rest[0] if rest else 0), bool(correct), float(weight))
        for model, results in per_model.items()
        for item, dimension, sub, correct, weight, *rest in results
    ]
    return spark.createDataFrame(rows, schemas.ddl(schemas.SCORES)).coalesce(1)


def flat(corrects: list[int], dimension: str = "restraint") -> list[tuple]:
    return [(f"i{i:02d}", dimension, "s", c, 1.0) for i, c in enumerate(corrects)]
