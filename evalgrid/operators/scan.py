"""Running values over a whole table or long segments of it, without one task.

A window over a table, or over one hot key, sorts all its rows in one task.
Here the rows are range-partitioned in the wanted order, each range works out
its own running values, and what a range inherits from those before it is
carried over by a table of one row per range.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalgrid.session import cut


class Running(NamedTuple):
    """An aggregate that can be worked out range by range."""

    fold: Callable[[Column], Column]
    merge: Callable[[Column], Column]
    carry: Callable[[Column, Column], Column]


def _added(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


def _xored(a: Column, b: Column) -> Column:
    return F.coalesce(a.bitwiseXOR(b), a, b)


KINDS = {
    "count": Running(F.count, F.sum, _added),
    "sum": Running(F.sum, F.sum, _added),
    "max": Running(F.max, F.max, F.greatest),
    "min": Running(F.min, F.min, F.least),
    "xor": Running(F.bit_xor, F.bit_xor, _xored),
}


def running(df: DataFrame, order: list[Column], wanted: dict[str, tuple[str, Column]], over: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with a running value for each name of ``wanted``: (kind, column).

    Values run in ``order`` up to and including the row, anew in each segment
    of equal ``over`` columns. The order must be total, or rows that tie get
    their values in an unspecified order. Nulls are skipped as in aggregates;
    null segment keys are one segment. An empty table stays empty.
    """
    spare = [f"__scan_{i}" for i in range(len(wanted))]
    segment = F.struct(*over) if over else F.struct(F.lit(0).alias("all"))
    taken = df.withColumns({new: column for new, (_, column) in zip(spare, wanted.values())})
    ranged = taken.repartitionByRange(*[F.col(c) for c in over], *order).withColumn("__range", F.spark_partition_id())
    ranged = cut(ranged)

    kinds = [KINDS[kind] for kind, _ in wanted.values()]
    parts = ranged.groupBy("__range", segment.alias("__segment")).agg(*[k.fold(F.col(c)).alias(c) for k, c in zip(kinds, spare)])
    edges = parts.groupBy("__range").agg(F.min("__segment").alias("first"), F.max(F.struct("__segment", *spare)).alias("last"))
    same = Window.partitionBy("last.__segment").orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)
    summed = edges.select("__range", "first", F.col("last.__segment").alias("open"), *[k.merge(F.col(f"last.{c}")).over(same).alias(c) for k, c in zip(kinds, spare)])
    before = Window.orderBy("__range")  # one row per range
    carried = summed.select(
        F.col("__range").alias("__at"),
        F.col("first").alias("__first"),
        (F.lag("open").over(before) == F.col("first")).alias("__goes_on"),
        *[F.lag(c).over(before).alias(f"{c}_carry") for c in spare],
    )
    carried = cut(carried.where("__goes_on"))

    inside = Window.partitionBy("__range", *over).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({name: k.fold(F.col(c)).over(inside) for name, k, c in zip(wanted, kinds, spare)})
    joined = local.join(carried, (F.col("__range") == F.col("__at")) & (segment == F.col("__first")), "left")
    return joined.select(*df.columns, *[F.when(F.col("__goes_on"), k.carry(F.col(f"{c}_carry"), F.col(name))).otherwise(F.col(name)).alias(name) for name, k, c in zip(wanted, kinds, spare)])


def numbered(df: DataFrame, order: list[Column], name: str, over: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the row's number in ``order``, from 1, within its segment."""
    return running(df, order, {name: ("count", F.lit(1))}, over)
