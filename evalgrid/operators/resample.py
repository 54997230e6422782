"""Cluster bootstraps and sign-flip tests with seeded draws.

A draw is a digest of its own coordinates, so it is the same under any
partitioning and after any retry. Blocks of draws are dealt over the tasks as
arrays and meet the cluster sums of a group as arrays too, so a resample is an
expression and not a join of its slots. There is one way for every size.

An array holds the items of one group and dimension, 16 bytes each: the size of
a bank, however many answers were graded.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalgrid.session import cut, slices

# The default numbers of resamples and the interval level.
DIMENSION_DRAWS = 10_000
HEADLINE_DRAWS = 5_000
PAIR_DRAWS = 10_000
SIGN_FLIPS = 100_000
ALPHA = 0.05
_TIE = 1e-12
_ZERO = 1e-8

#: Picks that a row holds, unless one resample has more, and flips.
_PICKS, _FLIPS = 4096, 1000
#: Shares into which the blocks of one group size are dealt.
_SALTS = 16
#: Items whose signs are one number, and bundles that are summed at a time.
_BUNDLE, _CHUNK = 8, 64


def _digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))


def _blocks(count: Column, size: int) -> Column:
    """Starts of the blocks that ``count`` numbers make."""
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(count.cast("bigint") - 1, F.lit(0)), F.lit(size).cast("bigint")))


def _sized(clusters: DataFrame, keys: list[str]) -> DataFrame:
    """The sums of each group and dimension as arrays in the order of items, with their number ``k``."""
    listed = F.sort_array(F.collect_list(F.struct("item", F.col("num").cast("double").alias("num"), F.col("den").cast("double").alias("den"))))
    found = clusters.groupBy(*keys, "dimension").agg(listed.alias("__l"))
    return found.select(*keys, "dimension", F.size("__l").cast("bigint").alias("k"), F.col("__l.num").alias("nums"), F.col("__l.den").alias("dens"))


def _draw_blocks(sizes: DataFrame, n: int, seed: int) -> DataFrame:
    """(dimension, k, salt, draw, picks): the places picked by the slots of blocks of resamples.

    ``sizes`` has the numbers of clusters ``k`` of each ``dimension``. Groups
    with the same number share their draws. ``draw`` is the first of a block.
    """
    each = F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(_PICKS) / F.col("k")))
    first = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"), F.col("each")))
    blocks = sizes.withColumn("each", each).withColumn("draw", first).repartition(slices(sizes.sparkSession), "dimension", "k", "draw")
    slots = F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)

    def pick(draw: Column, slot: Column) -> Column:
        digest = _digest(F.lit(seed), draw, F.col("dimension"), slot)
        return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % F.col("k")).cast("int")

    of_block = F.sequence(F.col("draw"), F.least(F.col("draw") + F.col("each"), F.lit(n).cast("bigint")) - 1)
    picks = F.transform(of_block, lambda draw: F.transform(slots, lambda slot: pick(draw, slot)))
    return blocks.select("dimension", "k", (F.col("draw") / F.col("each") % _SALTS).cast("int").alias("salt"), "draw", picks.alias("picks"))


def draws(sizes: DataFrame, n: int, seed: int) -> DataFrame:
    """(draw, dimension, k, idx): the place picked by each slot of each resample."""
    rows = _draw_blocks(sizes, n, seed).select("dimension", "k", "draw", F.posexplode("picks").alias("__at", "__picks"))
    slots = rows.select((F.col("draw") + F.col("__at")).alias("draw"), "dimension", "k", F.explode("__picks").alias("idx"))
    return slots.withColumn("idx", F.col("idx").cast("bigint"))


def replicates(clusters: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """(keys, draw, dimension, ratio): the weighted mean of every resample."""
    sums = cut(_sized(clusters, keys))
    picked = _draw_blocks(sums.select("dimension", "k").distinct(), n, seed)
    salted = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))

    def total(values: str, picks: Column) -> Column:
        return F.aggregate(picks, F.lit(0.0), lambda acc, at: acc + F.get(F.col(values), at))

    ratios = F.transform("picks", lambda p: F.try_divide(total("nums", p), total("dens", p)))
    met = picked.join(salted, ["dimension", "k", "salt"]).select(*keys, "dimension", "draw", F.posexplode(ratios).alias("__at", "ratio"))
    return met.select(*keys, (F.col("draw") + F.col("__at")).alias("draw"), "dimension", "ratio")


def _bounds(value: Column | str, alpha: float) -> Column:
    return F.percentile(value, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))


def dimension_intervals(
    clusters: DataFrame, keys: list[str], n: int = DIMENSION_DRAWS, seed: int = 0, alpha: float = ALPHA
) -> DataFrame:
    """Bootstrap interval of the weighted mean in every dimension.

    ``clusters`` has ``keys``, ``dimension``, ``item`` and the sums ``den`` and
    ``num``.
    """
    bounds = replicates(clusters, keys, n, seed).groupBy(*keys, "dimension").agg(_bounds("ratio", alpha).alias("q"))
    return bounds.select(*keys, "dimension", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def headline_intervals(
    clusters: DataFrame, keys: list[str], n: int = HEADLINE_DRAWS, seed: int = 0, alpha: float = ALPHA
) -> DataFrame:
    """Bootstrap interval of the equal-weight mean over dimensions (0 to 1).

    Items are resampled within each dimension.
    """
    means = replicates(clusters, keys, n, seed).groupBy(*keys, "draw").agg(F.avg("ratio").alias("mean"))
    bounds = means.groupBy(*keys).agg(_bounds("mean", alpha).alias("q"))
    return bounds.select(*keys, F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def all_intervals(
    clusters: DataFrame,
    keys: list[str],
    dimensions: tuple[str, ...],
    n: int = HEADLINE_DRAWS,
    n_dimension: int = DIMENSION_DRAWS,
    seed: int = 0,
    alpha: float = ALPHA,
) -> DataFrame:
    """Intervals of the headline and of every dimension from one set of draws.

    The first ``n`` draws make the headline's, the first ``n_dimension`` those
    of the dimensions.
    """
    wide = (
        replicates(clusters, keys, max(n, n_dimension), seed)
        .groupBy(*keys, "draw")
        .agg(
            F.avg("ratio").alias("score"),
            *[F.max(F.when(F.col("dimension") == d, F.col("ratio"))).alias(d) for d in dimensions],
        )
    )
    counted = {"score": n, **dict.fromkeys(dimensions, n_dimension)}
    bounds = wide.groupBy(*keys).agg(
        *[_bounds(F.when(F.col("draw") < most, F.col(part)), alpha).alias(f"__{part}") for part, most in counted.items()]
    )
    ends = [F.col(f"__{part}")[at].alias(f"{part}_{end}") for part in counted for at, end in ((0, "lo"), (1, "hi"))]
    return bounds.select(*keys, *ends)


def effects(clusters: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, dimension, item, coef): what each item adds to the equal-weight mean over dimensions."""
    dens = clusters.groupBy(*keys, "dimension").agg(F.sum("den").alias("__den"))
    n_dims = dens.groupBy(*keys).agg(F.count(F.lit(1)).alias("__dims"))
    weighed = clusters.join(dens, [*keys, "dimension"]).join(n_dims, keys)
    return weighed.select(*keys, "dimension", "item", (F.col("num") / F.col("__den") / F.col("__dims")).alias("coef"))


def _signs(n: int, seed: int):
    """Blocks of flips with the signs of their bundle's items as one number a flip."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = []
            for row in batch.to_pylist():
                flips = [str(flip) for flip in range(row["flip"], min(row["flip"] + _FLIPS, n))]
                number = np.zeros(len(flips), dtype=np.int32)
                for unit in row["units"]:
                    rest = f":{row['dimension']}:{unit['item']}"
                    # the last bit of the first four bytes of the digest
                    odd = [md5(f"{seed}:{flip}{rest}".encode()).digest()[3] & 1 for flip in flips]
                    number += np.array(odd, dtype=np.int32) * unit["bit"]
                signs.append(number)
            yield pa.RecordBatch.from_arrays([*batch.select(["dimension", "bundle", "flip"]).columns, pa.array(signs, pa.list_(pa.int32()))], ["dimension", "bundle", "flip", "signs"])

    return of_batches


def flip_sums(coefficients: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """(keys, flip, sums): the sum under every choice of signs, in blocks of flips.

    Items stand in bundles, so that a bundle's signs are one number. What a
    group adds in a bundle under each number is a table to look it up in.
    """
    unit = ["dimension", "item"]
    place = F.row_number().over(Window.partitionBy("dimension").orderBy("item")) - 1
    units = coefficients.select(*unit).distinct().withColumn("__place", place)
    units = cut(units.select(*unit, F.floor(F.col("__place") / _BUNDLE).alias("bundle"), F.pow(F.lit(2), F.col("__place") % _BUNDLE).cast("int").alias("bit")))
    bundle = ["dimension", "bundle"]

    first = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"), F.lit(_FLIPS).cast("bigint")))
    bundles = units.groupBy(*bundle).agg(F.collect_list(F.struct("item", "bit")).alias("units"))
    blocks = bundles.withColumn("flip", first).repartition(slices(coefficients.sparkSession), *bundle, "flip")
    chosen = blocks.mapInArrow(_signs(n, seed), "dimension string, bundle bigint, flip bigint, signs array<int>")

    def part(choice: Column) -> Column:
        return F.aggregate("held", F.lit(0.0), lambda acc, h: acc + F.when(choice.bitwiseAND(h["bit"]) != 0, h["coef"]).otherwise(-h["coef"]))

    held = coefficients.join(units, unit).groupBy(*keys, *bundle).agg(F.collect_list(F.struct("bit", "coef")).alias("held"))
    parts = cut(held.select(*keys, *bundle, F.transform(F.sequence(F.lit(0), F.lit(2**_BUNDLE - 1)), part).alias("parts")))

    def summed(values: str) -> Column:
        rows = F.collect_list(values)
        return F.aggregate(F.slice(rows, 2, F.size(rows)), rows[0], lambda acc, row: F.zip_with(acc, row, lambda x, y: x + y)).alias("sums")

    added = chosen.join(parts, bundle).select(*keys, "flip", "dimension", F.floor(F.col("bundle") / _CHUNK).alias("chunk"), F.transform("signs", lambda s: F.get(F.col("parts"), s)).alias("sums"))
    return added.groupBy(*keys, "flip", "dimension", "chunk").agg(summed("sums")).groupBy(*keys, "flip").agg(summed("sums"))


def extreme(sums: Column, observed: Column) -> Column:
    """How many of a block of sums are as far from zero as what was observed."""
    return F.size(F.filter(sums, lambda v: F.abs(v) >= F.abs(observed) - _TIE))


def flip_p(observed: Column, n_extreme: Column, n: int) -> Column:
    """One is added to both counts, so a p-value is never zero; an effect of zero gives one."""
    return F.when(F.abs(observed) <= _ZERO, F.lit(1.0)).otherwise((n_extreme + 1) / F.lit(n + 1))


def sign_flip_p(clusters: DataFrame, keys: list[str], n: int = SIGN_FLIPS, seed: int = 0) -> DataFrame:
    """Two-sided randomisation p-value with one sign per item cluster.

    ``num`` holds weighted differences.
    """
    coefficients = cut(effects(clusters, keys))
    observed = coefficients.groupBy(*keys).agg(F.sum("coef").alias("observed"))
    counted = flip_sums(coefficients, keys, n, seed).join(observed, keys).groupBy(*keys).agg(
        F.sum(extreme(F.col("sums"), F.col("observed"))).alias("extreme"), F.max("observed").alias("observed")
    )
    return counted.select(*keys, flip_p(F.col("observed"), F.col("extreme"), n).alias("p_value"))
