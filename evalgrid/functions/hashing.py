"""Roster, content and comparison fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PREFIX = "sha256:"


def roster_hash(ids: Column) -> Column:
    """Aggregate: digest of the sorted distinct ids, one per line.

    For rosters such as a case bank, whose size is bounded; tables of any size
    use :func:`set_fingerprint`.
    """
    listed = F.array_join(F.sort_array(F.collect_set(ids)), "\n")
    return F.concat(F.lit(_PREFIX), F.sha2(listed, 256))


def evaluation_hash(content_hash: Column, scorer_version: Column) -> Column:
    """Digest of a bank's content together with the rules that score it."""
    return F.concat(
        F.lit(_PREFIX), F.sha2(F.concat(content_hash, F.lit("\n"), scorer_version), 256)
    )


def display_hash(content: Column, roster: Column) -> Column:
    """The short digest shown for a bank, and what kind it is."""
    shown = F.coalesce(content, roster)
    kind = F.when(content.isNotNull(), "content hash").otherwise("roster hash")
    return F.struct(
        F.substring(F.substring_index(shown, ":", -1), 1, 12).alias("digest"), kind.alias("kind")
    )


def same_bank(a: Column, b: Column) -> Column:
    """Whether two bank structs agree on the strongest digest both carry."""
    return (
        F.when(
            a["evaluation_hash"].isNotNull() & b["evaluation_hash"].isNotNull(),
            a["evaluation_hash"] == b["evaluation_hash"],
        )
        .when(
            a["content_hash"].isNotNull() & b["content_hash"].isNotNull(),
            a["content_hash"] == b["content_hash"],
        )
        .otherwise(a["items_hash"] == b["items_hash"])
    )


def public_value(value: Column, dtype: T.DataType) -> Column:
    """``value`` without ``_`` fields, its fields and map entries in name order."""
    if isinstance(dtype, T.StructType):
        kept = sorted((f for f in dtype.fields if not f.name.startswith("_")), key=lambda f: f.name)
        rebuilt = F.struct(*[public_value(value[f.name], f.dataType).alias(f.name) for f in kept])
        return F.when(value.isNotNull(), rebuilt)
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda element: public_value(element, dtype.elementType))
    if isinstance(dtype, T.MapType):
        entries = F.filter(
            F.map_entries(value), lambda e: ~F.startswith(e["key"].cast("string"), F.lit("_"))
        )
        return F.map_from_entries(
            F.array_sort(
                F.transform(
                    entries,
                    lambda e: F.struct(
                        e["key"].alias("key"), public_value(e["value"], dtype.valueType).alias("value")
                    ),
                ),
                lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0),
            )
        )
    return value


def canonical_json(df: DataFrame, *columns: str) -> Column:
    """One row's public columns as canonical JSON text."""
    chosen = sorted(c for c in (columns or df.columns) if not c.startswith("_"))
    return F.to_json(
        F.struct(*[public_value(F.col(c), df.schema[c].dataType).alias(c) for c in chosen])
    )


def set_fingerprint(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Digest of the distinct values of a column of any size.

    Each value's own digest is cut into eight numbers, which are summed over
    the values; the digest is that of their count and sums. Sums do not depend
    on any order and are combined on the map side, so nothing is gathered.
    """
    keys = keys or []
    digests = df.select(*keys, F.sha2(F.col(value), 256).alias("__digest")).distinct()
    number = lambda at: F.conv(F.substring("__digest", at, 8), 16, 10).cast("decimal(38,0)")
    sums = {f"__{at}": F.sum(number(at)).cast("decimal(38,0)").cast("string").alias(f"__{at}") for at in range(1, 65, 8)}
    summed = digests.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_values"), *sums.values())
    joined = F.concat_ws(":", F.col("n_values").cast("string"), *sums)
    return summed.select(*keys, "n_values", F.concat(F.lit(_PREFIX), F.sha2(joined, 256)).alias("fingerprint"))
