"""Fingerprints and audits of a case bank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrid import DIMENSIONS
from evalgrid.functions import hashing
from evalgrid.operators import checks as checks_ops
from evalgrid.operators import gates, scope
from evalgrid.session import cut


def dimension_counts(items: DataFrame) -> DataFrame:
    """Distinct items per dimension, and how many of them are examples."""
    return items.groupBy("dimension").agg(
        F.countDistinct("item").alias("n_items"),
        F.countDistinct(F.when(scope.is_example(F.col("item")), F.col("item"))).alias("n_examples"),
    )


def row_digests(df: DataFrame, *columns: str) -> DataFrame:
    """``id`` and the digest of its canonical public content."""
    return df.select("id", F.sha2(hashing.canonical_json(df, *columns), 256).alias("digest"))


def content_hash(df: DataFrame) -> str:
    """Digest of a table's public content, whatever its row order or size."""
    lines = row_digests(df).select(F.concat_ws(":", "id", "digest").alias("line"))
    found = hashing.set_fingerprint(lines, "line").first()
    return found["fingerprint"]


def signature(cases: DataFrame, keys: DataFrame, case_scope: str, scorer_version: str) -> DataFrame:
    """One row that identifies a bank and the rules scoring it.

    Reveals counts and digests only, never ids or text.
    """
    scoped_cases = scope.in_scope(cases, case_scope, "id")
    scoped_keys = keys.join(scoped_cases.select("id"), "id", "left_semi")
    case_digest, key_digest = content_hash(scoped_cases), content_hash(scoped_keys)
    content = F.concat(F.lit("sha256:"), F.sha2(F.lit(f"{case_digest}\n{key_digest}"), 256))
    n_checks = checks_ops.expected_checks(scoped_keys).agg(F.count(F.lit(1)).alias("n")).scalar()
    examples = scope.in_scope(cases, scope.EXAMPLES, "id").agg(F.count(F.lit(1)).alias("n")).scalar()
    excluded = examples if case_scope == scope.OFFICIAL else F.lit(0).cast("bigint")
    by_dimension = [F.count_if(F.col("type") == d).alias(f"n_{d}") for d in DIMENSIONS]
    row = scoped_cases.agg(
        F.lit(case_scope).alias("scope"),
        F.count(F.lit(1)).alias("n_items"),
        *by_dimension,
        hashing.roster_hash(F.col("id")).alias("items_hash"),
        F.coalesce(F.bool_or(scope.is_example(F.col("id"))), F.lit(False)).alias("includes_examples"),
    ).select(
        "*",
        n_checks.alias("n_checks"),
        F.lit(case_digest).alias("case_hash"),
        F.lit(key_digest).alias("key_hash"),
        content.alias("content_hash"),
        F.lit(scorer_version).alias("scorer_hash"),
        hashing.evaluation_hash(content, F.lit(scorer_version)).alias("evaluation_hash"),
        excluded.alias("examples_excluded"),
    )
    return cut(row)


def record_manifest(saved: DataFrame, run_id: str, signed: DataFrame, replace: bool = False) -> DataFrame:
    """The bank manifest with a run's signature added.

    A run keeps the evaluation it was started with: another one is refused.
    With ``replace`` (a regrade) changed keys are accepted, changed cases never.
    """
    new = signed.select(F.lit(run_id).alias("run_id"), *signed.columns)
    both = saved.alias("old").join(new.alias("new"), ["run_id", "scope"])
    old_hash = F.coalesce("old.evaluation_hash", "old.content_hash")
    changed = both.filter(old_hash != F.col("new.evaluation_hash"))
    if replace:
        edited = changed.filter(F.col("old.case_hash") != F.col("new.case_hash"))
        gates.must_be_empty(edited.select("run_id", "scope"), "saved answers saw other case prompts")
    else:
        gates.must_be_empty(changed.select("run_id", "scope"), "run already records another evaluation")
    return saved.join(new, ["run_id", "scope"], "left_anti").unionByName(new, allowMissingColumns=True)


def manifest_mismatches(saved: DataFrame, current: DataFrame) -> DataFrame:
    """Runs whose saved evaluation is no longer the current one."""
    now = current.select("scope", F.col("evaluation_hash").alias("current_hash"))
    return saved.join(now, "scope").filter(
        ~F.coalesce(F.col("evaluation_hash") == F.col("current_hash"), F.lit(False))
    )


def missing_sources(cases: DataFrame) -> DataFrame:
    return cases.filter(F.coalesce(F.trim("source"), F.lit("")) == "").select("id")


def provenance_counts(items: DataFrame, provenance: DataFrame) -> DataFrame:
    """How many provenance rows each item has, and whether that is right.

    The provenance side is counted before the join, so an item with very many
    rows costs no more than another.
    """
    counted = provenance.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    joined = items.select("id").join(counted, "id", "left")
    n = F.coalesce("n", F.lit(0))
    status = F.when(n == 0, "missing").when(n > 1, "duplicate").otherwise("ok")
    return joined.select("id", n.alias("n_rows"), status.alias("status"))


def pending_signoff(items: DataFrame, register: DataFrame) -> DataFrame:
    """Items of the bank that still wait for a sign-off."""
    return items.select("id").join(register.select("id"), "id", "left_semi")


def audit(cases: DataFrame, keys: DataFrame, provenance: DataFrame, register: DataFrame) -> DataFrame:
    """Findings of a bank audit over official items: (finding, item, detail)."""
    official = scope.in_scope(cases, scope.OFFICIAL, "id")
    own_keys = keys.join(official.select("id"), "id", "left_semi")
    none = F.lit("")

    def finding(df: DataFrame, name: str, item: str, detail=none) -> DataFrame:
        return df.select(F.lit(name).alias("finding"), F.col(item).alias("item"), detail.alias("detail"))

    counts = provenance_counts(official, provenance).filter("status <> 'ok'")
    parts = [
        finding(missing_sources(official), "missing_source", "id"),
        counts.select(
            F.concat("status", F.lit("_provenance")).alias("finding"), F.col("id").alias("item"), none.alias("detail")
        ),
        finding(
            checks_ops.dead_pattern_aliases(checks_ops.checks_from_keys(own_keys)),
            "unmatchable_alias", "item", F.col("alias"),
        ),
        finding(pending_signoff(official, register), "signoff_pending", "id"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
