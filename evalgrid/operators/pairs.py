"""Paired comparisons of models on the checks both were graded on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrid.functions import verdicts
from evalgrid.operators import resample, scan
from evalgrid.session import cut

PAIR = ["a", "b"]
#: Fixed value: the family-wise level a decision must reach.
DECISION_LEVEL = 0.05


def _sides(means: DataFrame, order: DataFrame) -> DataFrame:
    return means.join(order.select("model", "pos"), "model")


def shared_checks(means: DataFrame, order: DataFrame) -> DataFrame:
    """Every pair of models on every check both have, better placed model first.

    ``means`` are generation means; ``order`` gives each model its ``pos``.
    """
    placed = _sides(means, order)
    left = placed.select(
        "item", "sub", "dimension", "weight",
        F.col("model").alias("a"), F.col("pos").alias("__pos_a"), F.col("rate").alias("__rate_a"),
    )
    right = placed.select(
        "item", "sub",
        F.col("dimension").alias("__dimension_b"), F.col("weight").alias("__weight_b"),
        F.col("model").alias("b"), F.col("pos").alias("__pos_b"), F.col("rate").alias("__rate_b"),
    )
    return (
        left.join(right, ["item", "sub"])
        .filter("__pos_a < __pos_b")
        .withColumn("delta", F.col("__rate_a") - F.col("__rate_b"))
        .drop("__pos_a", "__pos_b", "__rate_a", "__rate_b")
    )


def pair_clusters(shared: DataFrame) -> DataFrame:
    """Weighted difference sums per pair and item."""
    return shared.groupBy(*PAIR, "dimension", "item").agg(
        F.sum("weight").alias("den"),
        F.sum(F.col("weight") * F.col("delta")).alias("num"),
        F.count(F.lit(1)).alias("n_checks"),
    )


def _profiles(means: DataFrame) -> DataFrame:
    """(model, profile): equal where models have the same checks with the same weights."""
    print_ = F.xxhash64("item", "sub", "dimension", "weight")
    return means.groupBy("model").agg(F.struct(F.count(F.lit(1)), F.bit_xor(print_), F.sum(F.pmod(print_, F.lit(1 << 31)))).alias("profile"))


def _paired(order: DataFrame, means: DataFrame) -> DataFrame:
    """(a, b, alike): all pairs of ``order``, and whether their checks and weights are the same."""
    placed = order.select("model", "pos").join(_profiles(means), "model")
    right = placed.select(F.col("model").alias("b"), F.col("pos").alias("pos_b"), F.col("profile").alias("other"))
    return placed.withColumnRenamed("model", "a").join(right, F.col("pos") < F.col("pos_b")).select(*PAIR, (F.col("profile") == F.col("other")).alias("alike"))


def _own_clusters(means: DataFrame, pairs: DataFrame) -> DataFrame:
    """Weighted sums per item of each model that stands in ``pairs``."""
    named = pairs.select(F.col("a").alias("model")).union(pairs.select("b")).distinct()
    own = means.join(named, "model", "left_semi")
    return own.groupBy("model", "dimension", "item").agg(F.sum("weight").alias("den"), F.sum(F.col("weight") * F.col("rate")).alias("num"))


def _both(pairs: DataFrame, own: DataFrame, on: list[str], *values: str) -> DataFrame:
    """``pairs`` with the ``values`` of both models, as x_a and x_b."""
    sides = [own.select(F.col("model").alias(side), *on, *[F.col(v).alias(f"{v}_{side}") for v in values]) for side in PAIR]
    return pairs.select(*PAIR).join(sides[0], "a").join(sides[1], ["b", *on])


def _quantile(ordered: Column, q: float) -> Column:
    """Between the two nearest values of a sorted array, in proportion."""
    at = (F.size(ordered) - 1) * F.lit(q)
    low, high = (F.get(ordered, f(at).cast("int")) for f in (F.floor, F.ceil))
    return low + (high - low) * (at - F.floor(at))


def pair_intervals(means: DataFrame, order: DataFrame, n: int = resample.PAIR_DRAWS, seed: int = 0, alpha: float = resample.ALPHA) -> DataFrame:
    """(a, b, lo, hi) of every pair of ``order``.

    Where both models have the same checks and weights, a pair's replicate is
    the difference of theirs, so each model is resampled once, not once per
    pair. Other pairs are resampled on the checks that they share.
    """
    pairs = cut(_paired(order, means))
    alike = pairs.where("alike")
    drawn = resample.replicates(_own_clusters(means, alike), ["model"], n, seed).groupBy("model", "draw").agg(F.avg("ratio").alias("mean"))
    listed = drawn.groupBy("model").agg(F.transform(F.sort_array(F.collect_list(F.struct("draw", "mean"))), lambda s: s["mean"]).alias("means"))
    gaps = F.sort_array(F.zip_with("means_a", "means_b", lambda x, y: x - y))
    ends = _both(alike, cut(listed), [], "means").select(*PAIR, gaps.alias("gaps"))
    shared = ends.select(*PAIR, _quantile(F.col("gaps"), alpha / 2).alias("lo"), _quantile(F.col("gaps"), 1 - alpha / 2).alias("hi"))
    if (unlike := pairs.where("not alike")).isEmpty():
        return shared
    apart = pair_clusters(shared_checks(means, order).join(unlike, PAIR, "left_semi"))
    return shared.union(resample.headline_intervals(cut(apart), PAIR, n, seed, alpha))


def pair_tests(means: DataFrame, order: DataFrame, n: int = resample.SIGN_FLIPS, seed: int = 0) -> DataFrame:
    """(a, b, p_value) of every pair of ``order``, flipped once per model where that is the same."""
    pairs = cut(_paired(order, means))
    alike = pairs.where("alike")
    effects = cut(resample.effects(_own_clusters(means, alike), ["model"]))
    sums = resample.flip_sums(effects, ["model"], n, seed)
    gap = F.sum(F.col("coef_a") - F.col("coef_b"))
    observed = _both(alike, effects, ["dimension", "item"], "coef").groupBy(*PAIR).agg(gap.alias("observed"))
    flipped = _both(alike, cut(sums), ["flip"], "sums").join(observed, PAIR)
    far = resample.extreme(F.zip_with("sums_a", "sums_b", lambda x, y: x - y), F.col("observed"))
    counted = flipped.groupBy(*PAIR).agg(F.sum(far).alias("extreme"), F.max("observed").alias("observed"))
    shared = counted.select(*PAIR, resample.flip_p(F.col("observed"), F.col("extreme"), n).alias("p_value"))
    if (unlike := pairs.where("not alike")).isEmpty():
        return shared
    apart = pair_clusters(shared_checks(means, order).join(unlike, PAIR, "left_semi"))
    return shared.union(resample.sign_flip_p(cut(apart), PAIR, n, seed))


def paired_diff(clusters: DataFrame) -> DataFrame:
    """The equal-dimension difference of each pair, with its counts."""
    by_dim = clusters.groupBy(*PAIR, "dimension").agg(
        F.try_divide(F.sum("num"), F.sum("den")).alias("value"),
        F.sum("n_checks").alias("n_checks"),
        F.count(F.lit(1)).alias("n_items"),
    )
    return by_dim.groupBy(*PAIR).agg(
        F.avg("value").alias("diff"),
        F.sum("n_checks").alias("n_pairs"),
        F.sum("n_items").alias("n_items"),
    )


def holm_adjust(df: DataFrame, p: str = "p_value", family: list[str] | None = None) -> DataFrame:
    """Add ``p_adjusted``: step-down adjusted p-values within each family.

    Ranks and the running maximum are worked out range by range, so no task
    holds a whole family, however many pairs its models make.
    """
    family = family or []
    ties = [F.col(c) for c in PAIR if c in df.columns]
    ranked = scan.numbered(cut(df), [F.col(p).asc(), *ties], "__rank", tuple(family))
    if family:
        # null families are one, as in a window
        sizes = ranked.groupBy(*family).agg(F.count(F.lit(1)).alias("__size"))
        same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in family]
        sized = ranked.alias("r").join(sizes.alias("s"), same).select("r.*", "__size")
    else:
        sized = ranked.withColumn("__size", ranked.agg(F.count(F.lit(1))).scalar())
    step = (F.col("__size") - F.col("__rank") + 1) * F.col(p)
    stepped = scan.running(sized, [F.col("__rank").asc()], {"__running": ("max", step)}, tuple(family))
    return stepped.withColumn("p_adjusted", F.least(F.lit(1.0), "__running")).drop("__rank", "__size", "__running")


def compare(
    means: DataFrame,
    order: DataFrame,
    n: int = resample.PAIR_DRAWS,
    permutations: int = resample.SIGN_FLIPS,
    seed: int = 0,
) -> DataFrame:
    """Difference, interval, p-values and winner of every pair of ``order``."""
    means, order = cut(means), cut(order)
    intervals = pair_intervals(means, order, n, seed)
    tested = pair_tests(means, order, permutations, seed)
    joined = paired_diff(pair_clusters(shared_checks(means, order))).join(intervals, PAIR).join(tested, PAIR)
    return decide(holm_adjust(joined))


def decide(records: DataFrame) -> DataFrame:
    """Add ``winner``: set only where the adjusted p-value is low enough."""
    winner = F.when(
        (F.col("p_adjusted") <= DECISION_LEVEL) & (F.col("diff") != 0),
        F.when(F.col("diff") > 0, F.col("a")).otherwise(F.col("b")),
    )
    return records.withColumn("winner", winner)


def published(records: DataFrame, digits: int = 3) -> DataFrame:
    """Pair records in the stored form."""
    return records.select(
        "a", "b",
        F.round("diff", digits).alias("delta"),
        F.round("lo", digits).alias("lo"),
        F.round("hi", digits).alias("hi"),
        F.round("p_adjusted", 4).alias("holm_p"),
        "n_items", "winner",
    )


def excludes_zero(lo: Column, hi: Column) -> Column:
    """Whether an interval lies on one side of zero."""
    return (lo > 0) | (hi < 0)


def both_views(records: DataFrame, delta: str = "diff") -> DataFrame:
    """Each comparison twice, once from each model's side."""
    me = records.select(
        F.col("a").alias("model"), F.col("b").alias("opponent"),
        F.col(delta).alias("delta"), "lo", "hi", "winner",
    )
    other = records.select(
        F.col("b").alias("model"), F.col("a").alias("opponent"),
        (-F.col(delta)).alias("delta"), (-F.col("hi")).alias("lo"), (-F.col("lo")).alias("hi"), "winner",
    )
    return me.unionByName(other)


def wins(records: DataFrame) -> DataFrame:
    """Decisive wins of every model that was compared, zero included."""
    return (
        both_views(records)
        .groupBy("model")
        .agg(F.count_if(F.col("winner") == F.col("model")).alias("wins"), F.count(F.lit(1)).alias("compared"))
    )


def best_record(won: DataFrame) -> DataFrame:
    """The most decisive wins of any model, and how many models have them."""
    return won.agg(
        F.max("wins").alias("best"), F.max_by("compared", "wins").alias("compared"), F.sum("wins").alias("decisive")
    )


def cells(records: DataFrame) -> DataFrame:
    """One cell per ordered pair: how the comparison looks to the row model."""
    views = both_views(records)
    return views.withColumn(
        "state", verdicts.cell_state(F.col("model"), F.col("lo"), F.col("hi"), F.col("winner"))
    )


def head_to_head(records: DataFrame, opponents: list[str]) -> DataFrame:
    """A grid of cell states, one column for each of ``opponents``, and decisive wins.

    The caller names the columns, in the order of the board. They are plain
    aggregates, so their number has no limit and no job looks them up.
    """
    states = cells(records)
    grid = states.groupBy("model").agg(*[F.max(F.when(F.col("opponent") == o, F.col("state"))).alias(o) for o in opponents])
    won = states.groupBy("model").agg(F.count_if(F.col("state") == "wd").alias("decisive_wins"))
    return grid.join(won, "model")
