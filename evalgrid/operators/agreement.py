"""Agreement between two raters, and between dimensions across models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrid import DIMENSIONS


def rater_labels(keys: DataFrame) -> DataFrame:
    """The labels a key implies, as (label_key, label) rows."""
    restraint = keys.filter(F.col("type") == "restraint").select(
        "id", F.explode("labels").alias("k", "v")
    ).select(F.concat_ws(":", "id", "k").alias("label_key"), F.upper("v").alias("label"))

    def joined(values):
        return F.array_join(F.array_sort(F.transform(values, lambda v: F.upper(v))), "|")

    conviction = keys.filter(F.col("type") == "conviction")
    initial = conviction.select(
        F.concat("id", F.lit(":initial")).alias("label_key"),
        joined(F.coalesce("initial_expected", F.array().cast("array<string>"))).alias("label"),
    )
    turns = conviction.select("id", F.explode("turns").alias("t")).select(
        F.concat_ws(":", "id", "t.id").alias("label_key"), joined(F.col("t.pass_if_in")).alias("label")
    )
    honesty = keys.filter(F.col("type") == "honesty")
    marks = [
        honesty.select("id", F.explode(field).alias("c")).select(
            F.concat(F.col("id"), F.lit(f":{kind}:"), F.col("c.id")).alias("label_key"),
            F.lit(label).alias("label"),
        )
        for field, kind, label in (
            ("landmines", "landmine", "FLAG"),
            ("false_alarms", "falsealarm", "PENALIZE"),
        )
    ]
    return restraint.unionByName(initial).unionByName(turns).unionByName(marks[0]).unionByName(marks[1])


def shared_labels(author: DataFrame, reviewer: DataFrame, key: str = "label_key") -> DataFrame:
    """Labels of both raters for the keys both labelled."""
    return author.select(key, F.col("label").alias("rater_a")).join(
        reviewer.select(key, F.col("label").alias("rater_b")), key
    )


def cohen_kappa(rated: DataFrame, a: str = "rater_a", b: str = "rater_b") -> DataFrame:
    """Chance-corrected agreement; one when chance alone would agree.

    Reads the rows once into confusion counts; the rest is arithmetic on one
    row per label. No rows give no result.
    """
    confusion = rated.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    sides = confusion.select(
        "n", F.explode(F.array(
            F.struct(F.col("a").alias("label"), F.lit(1).alias("first"), (F.col("a") == F.col("b")).alias("same")),
            F.struct(F.col("b").alias("label"), F.lit(0).alias("first"), F.lit(False).alias("same")),
        )).alias("s")
    )
    margins = sides.groupBy("s.label").agg(
        F.sum(F.col("n") * F.col("s.first")).alias("row"),
        F.sum(F.col("n") * (1 - F.col("s.first"))).alias("col"),
        F.sum(F.when(F.col("s.same"), F.col("n")).otherwise(0)).alias("agree"),
    )
    totals = margins.agg(
        F.sum("row").alias("n"),
        F.sum("agree").alias("n_agree"),
        F.sum(F.col("row").cast("double") * F.col("col")).alias("__products"),
    ).filter("n > 0")
    observed = F.col("n_agree") / F.col("n")
    chance = F.col("__products") / (F.col("n").cast("double") * F.col("n"))
    scored = totals.withColumn(
        "kappa", F.when(chance == 1.0, F.lit(1.0)).otherwise((observed - chance) / (1 - chance))
    )
    # fixed values: the bands agreement is reported in
    band = F.when(F.col("kappa") >= 0.75, "substantial").when(F.col("kappa") >= 0.6, "moderate").otherwise("low")
    return scored.select("n", "n_agree", "kappa", band.alias("band"))


def _corr(x: str, y: str) -> Column:
    """Pearson correlation; null, not an error, where a column is flat."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def dimension_structure(dimension_values: DataFrame, min_models: int = 5) -> DataFrame:
    """How the dimensions move together across models.

    One row: pairwise correlations, each dimension's correlation with the
    equal-weight mean, and the share of the first principal component. No row
    if there are too few complete models or a column has no spread.

    The largest eigenvalue of a 3x3 correlation matrix has a closed form: it is
    1 + m with m the largest root of m^3 - (r^2 sum) m - 2 (r product) = 0.
    """
    r, h, c = DIMENSIONS
    wide = (
        dimension_values.groupBy("model")
        .pivot("dimension", list(DIMENSIONS))
        .agg(F.first("value"))
        .dropna(subset=list(DIMENSIONS))
        .withColumn("headline", (F.col(r) + F.col(h) + F.col(c)) / 3)
    )
    columns = [*DIMENSIONS, "headline"]
    stats = wide.agg(
        F.count(F.lit(1)).alias("n_models"),
        _corr(r, h).alias("corr_rh"),
        _corr(r, c).alias("corr_rc"),
        _corr(h, c).alias("corr_hc"),
        *[_corr(d, "headline").alias(f"influence_{d}") for d in DIMENSIONS],
        *[F.stddev_pop(name).alias(f"__sd_{name}") for name in columns],
    ).filter(F.col("n_models") >= min_models)
    for name in columns:
        stats = stats.filter(F.col(f"__sd_{name}") > 0).drop(f"__sd_{name}")
    squares = F.col("corr_rh") ** 2 + F.col("corr_rc") ** 2 + F.col("corr_hc") ** 2
    product = F.col("corr_rh") * F.col("corr_rc") * F.col("corr_hc")
    third = squares / 3
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), product / F.pow(third, 1.5)))
    largest = F.when(third > 0, 2 * F.sqrt(third) * F.cos(F.acos(cosine) / 3)).otherwise(0.0)
    return stats.withColumn("pc1_share", (1 + largest) / 3)
