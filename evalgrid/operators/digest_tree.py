"""Digest trees: what changed between two versions of a bank, found from the top.

A row's digest is that of its public content; a parent's is the digest of how
many children it has and of the sums over its children's names and digests. A tree is kept as a table
with one row per node, in a folder per level, so it is compared without the
rows it was built from: equal tops end the walk, and below an unequal node
only its own children are looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.functions import hashing
from evalgrid.session import cut


#: Where a digest of 64 hex digits is cut into numbers of 28 bits, whose sums as
#: longs hold some 30 billion children.
_CUTS = range(1, 64, 7)


def _summed(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The nodes ``keys`` over ``__line``, the digest of each child.

    Sums depend on no order and are combined on the map side: one shuffle,
    and nothing is gathered. Equal lines count as often as they occur.
    """
    numbers = [F.conv(F.substring("__line", at, 7), 16, 10).cast("bigint").alias(f"__{at}") for at in _CUTS]
    sums = [F.sum(f"__{at}").alias(f"__{at}") for at in _CUTS]
    nodes = lines.select(*keys, *numbers).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_children"), *sums)
    text = F.concat_ws(":", "n_children", *[F.col(f"__{at}").cast("string") for at in _CUTS])
    return nodes.select(*keys, "n_children", F.sha2(text, 256).alias("digest"))


def _level(children: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The parents of ``children``, whose names among their siblings are ``name``."""
    line = F.sha2(F.concat_ws(":", F.to_json(F.struct(name)), "digest"), 256)
    return _summed(children.select(*keys, line.alias("__line")), keys)


def write_tree(rows: DataFrame, levels: list[str], id: str, path: str) -> None:
    """Build the tree of ``rows`` and store it at ``path``.

    ``levels`` names the columns from the top down, ``id`` the row's own name
    below them; the other columns are its content, private ones apart. Rows
    that share all names are one leaf, told apart by content and number. Null
    names are names like others. An empty table is a top without children.
    """
    named = [*levels, id]
    content = [c for c in rows.columns if c not in named]
    text = hashing.canonical_json(rows, *content) if content else F.lit("{}")
    nodes = _summed(rows.select(*named, F.sha2(text, 256).alias("__line")), named)
    for depth in range(len(named), -1, -1):
        nodes.write.mode("overwrite").parquet(f"{path}/level={depth}")
        if depth:
            below = read_level(rows.sparkSession, path, depth)
            nodes = _level(below, named[: depth - 1], named[depth - 1])


def read_level(spark: SparkSession, path: str, depth: int) -> DataFrame:
    """The nodes at ``depth``; 0 is the top."""
    return spark.read.parquet(f"{path}/level={depth}")


def _matched(keys: list[str], left: str, right: str):
    same = [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]
    return reduce(lambda a, b: a & b, same, F.lit(True))


def changed_nodes(spark: SparkSession, old: str, new: str, levels: list[str], id: str) -> list[DataFrame]:
    """The nodes that differ between two stored trees, for each level from the top.

    Every table has the names down to its level and ``change``: ``added``,
    ``removed`` or ``edited``. A node counts as edited if anything below it is.
    """
    named = [*levels, id]
    found: list[DataFrame] = []
    for depth in range(len(named) + 1):
        keys, sides = named[:depth], []
        for path in (old, new):
            nodes = read_level(spark, path, depth)
            if depth > 1:  # only below what differs; the top has no name to join on
                nodes = nodes.alias("n").join(found[-1].alias("p"), _matched(keys[:-1], "n", "p"), "left_semi")
            sides.append(nodes.select(*keys, "digest"))
        both = sides[0].alias("a").join(sides[1].alias("b"), _matched(keys, "a", "b"), "full_outer")
        change = F.when(F.col("a.digest").isNull(), "added").when(F.col("b.digest").isNull(), "removed").otherwise("edited")
        names = [F.when(F.col("b.digest").isNull(), F.col(f"a.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in keys]
        differs = ~F.col("a.digest").eqNullSafe(F.col("b.digest"))
        found.append(cut(both.filter(differs).select(*names, change.alias("change"))))
        if depth == 0 and found[0].isEmpty():
            return [*found, *_nothing(spark, new, named)]
    return found


def _nothing(spark: SparkSession, path: str, named: list[str]) -> list[DataFrame]:
    return [
        read_level(spark, path, depth).limit(0).select(*named[:depth], F.lit("").alias("change"))
        for depth in range(1, len(named) + 1)
    ]


def changed_items(nodes: list[DataFrame], levels: list[str], id: str) -> DataFrame:
    """The changed nodes of the last level above the rows, with how their rows changed."""
    parents, rows = nodes[-2], nodes[-1]
    counts = rows.groupBy(*levels).agg(
        *[F.count_if(F.col("change") == kind).alias(f"n_{kind}") for kind in ("added", "removed", "edited")]
    )
    return parents.alias("p").join(counts.alias("c"), _matched(levels, "p", "c")).select(
        "p.*", "n_added", "n_removed", "n_edited"
    )
