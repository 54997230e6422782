"""From raw documents to packed training sequences.

Five stages, each applied to all that its predecessor kept: toxic documents
go, one document of each near-duplicate class stays, secrets are replaced,
documents are drawn to balanced marginals, and what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.llm import mixing, near_copies, packing, secret_scan, toxicity
from evalgrid.llm.common import stored, table

#: Models, draws and bins have no SQL; the stages are tested by brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, folder, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return near_copies.keep_one(docs)


def replace_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return secret_scan.redact(docs, length="n_chars")


def balance(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    text = F.col("text")
    return mixing.sample(docs, packing.word_count(text), mixing.genre(text))


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    text = F.col("text")
    return packing.best_fit(docs, packing.word_count(text), packing.text_cluster(text))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("secrets", replace_secrets),
    ("mixing", balance),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return run(spark, folder)


def queries() -> dict:
    return {"pipeline": pipeline}


def oracles() -> dict[str, str]:
    return {}
