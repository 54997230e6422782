"""Mix documents to target shares by iterative proportional fitting.

Documents fall into cells of (source, language, topic). The token weights of
the cells are raked: scaled to the target shares of one dimension after the
other until all three hold. The raked weight of a cell over its tokens gives
the probability with which each of its documents is drawn, and a hash of the
document decides.

Probabilities end at 1. Their scale is solved for the tokens to draw, so a cell
or a value too small for its target is drawn whole and what it lacks is shared
out over the others; it never decides how much of the rest stays.

Only cells are raked, not documents. Their table is written between sweeps,
so its size is known, and Catalyst broadcasts it to the documents or shuffles
by it as that size asks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from evalgrid.llm.common import fresh, stored

DIMENSIONS = ("source", "lang", "topic")
#: Observed shares are raised to these powers for the default targets: a hot
#: source or language goes down and small ones up, topics keep their shares.
TEMPER = {"source": 0.8, "lang": 0.8, "topic": 1.0}
#: Share of all tokens drawn in expectation when no budget is given.
KEEP = 2 / 3
#: Sweeps stop when no marginal is further off than this share of its target.
TOLERANCE = 1e-6
MAX_SWEEPS = 100
#: Stands for null in a dimension.
NONE = "(none)"


def form(text: str | None) -> str:
    """The form of a text, a plain topic where the documents name none.

    Null and blank texts are ``empty``; then tables by bars, symbol runs,
    shouting, numbers, and prose by its length in characters.
    """
    if text is None or not text.strip():
        return "empty"
    size = len(text)
    for name, characters, least in (("table", "|", 0.03), ("symbols", "#*$%&<>", 0.05), ("shouting", "!", 0.05), ("numbers", "0123456789", 0.1)):
        if sum(map(text.count, characters)) > least * size:
            return name
    return "note" if size < 500 else "article" if size < 5000 else "long read"


@F.pandas_udf(StringType())
def genre(texts: pd.Series) -> pd.Series:
    """Column of the forms of a text column."""
    return pd.Series([form(t) for t in texts], dtype="object")


def tempered(cells: DataFrame, powers: dict[str, float] = TEMPER) -> DataFrame:
    """(dimension, value, share): observed token shares, raised and normalised."""
    parts = [cells.select(F.lit(d).alias("dimension"), F.col(d).alias("value"), "tokens", F.lit(powers[d]).alias("power")) for d in DIMENSIONS]
    sums = parts[0].union(parts[1]).union(parts[2]).groupBy("dimension", "value", "power").agg(F.sum("tokens").alias("tokens"))
    raised = sums.select("dimension", "value", F.pow("tokens", "power").alias("share"))
    whole = raised.groupBy("dimension").agg(F.sum("share").alias("whole"))
    return raised.join(whole, "dimension").select("dimension", "value", F.try_divide("share", "whole").alias("share"))


def rake(cells: DataFrame, targets: DataFrame, tolerance: float = TOLERANCE, sweeps: int = MAX_SWEEPS) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with their raked ``weight``.

    Weights sum to the tokens of all cells. A value without target keeps
    nothing; targets without a cell are left out and the others of their
    dimension normalised. Stops at ``tolerance`` or after ``sweeps``: targets
    that contradict each other are then met as nearly as the last sweep did.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    table = cells
    for d in DIMENSIONS:
        wanted = targets.where(F.col("dimension") == d).select(F.col("value").alias(d), F.col("share").alias(f"{d}_share"))
        present = wanted.join(cells.select(d).distinct(), d, "left_semi")
        whole = present.agg(F.sum(f"{d}_share")).first()[0] or 1.0
        present = present.withColumn(f"{d}_share", F.col(f"{d}_share") / F.lit(whole))
        table = table.join(present, d, "left").fillna(0.0, [f"{d}_share"])
    table = stored(table.withColumn("weight", F.col("tokens").cast("double")), "cells")
    for _ in range(sweeps):
        for d in DIMENSIONS:
            here = F.sum("weight").over(Window.partitionBy(d))
            table = table.withColumn("weight", F.when(here > 0, F.col("weight") * F.col(f"{d}_share") * total / here).otherwise(0.0))
        table = stored(table, "cells")
        off = [
            table.groupBy(d).agg(F.abs(F.sum("weight") / (F.first(f"{d}_share") * total) - 1).alias("off"), F.first(f"{d}_share").alias("share")).where("share > 0").select("off")
            for d in DIMENSIONS
        ]
        worst = off[0].union(off[1]).union(off[2]).agg(F.max("off")).first()[0]
        if worst is None or worst <= tolerance:
            break
    return table.select(*DIMENSIONS, "tokens", "weight")


def calibrated(raked: DataFrame, budget: float | None = None) -> DataFrame:
    """Cells with the ``probability`` that draws them in the raked proportions.

    Probabilities are in proportion to weight over tokens and end at 1. The
    expected draw is the budget in tokens, by default ``KEEP`` of all tokens,
    or less only where every cell with a weight is drawn whole.
    """
    if budget is None:
        budget = KEEP * (raked.agg(F.sum("tokens")).first()[0] or 0)
    parts = raked.select(F.lit("all").alias("dimension"), F.col("tokens").alias("size"), F.col("weight").alias("wanted"))
    scale = filled(parts, budget).get("all", 0.0)
    rate = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    return raked.withColumn("probability", F.least(F.lit(1.0), rate * F.lit(scale)))


def filled(parts: DataFrame, budget: float) -> dict[str, float]:
    """The scale by dimension at which least(size, scale * wanted) sums to the budget.

    ``parts`` are (dimension, size, wanted). The scale of those that do not
    reach their size is raised until no other one does.
    """
    scales: dict[str, float] = {}
    while True:
        known = [x for d, s in scales.items() for x in (F.lit(d), F.lit(s))]
        scaled = F.col("wanted") * F.create_map(*known)[F.col("dimension")] if known else F.lit(0.0)
        full = (F.col("wanted") > 0) & (scaled >= F.col("size"))
        sums = parts.groupBy("dimension").agg(
            F.sum(F.when(full, F.col("size")).otherwise(0)).cast("double").alias("held"), F.sum(F.when(~full, F.col("wanted")).otherwise(0.0)).alias("rest")
        )
        raised = {r["dimension"]: (budget - r["held"]) / r["rest"] if r["rest"] else scales.get(r["dimension"], 0.0) for r in sums.collect()}
        if scales and all(s <= scales[d] * (1 + 1e-12) for d, s in raised.items()):
            return scales
        if not raised:
            return raised
        scales = raised


def reachable(cells: DataFrame, targets: DataFrame, budget: float) -> DataFrame:
    """``targets`` that a draw of ``budget`` tokens can meet.

    A value with fewer tokens than its share of the draw gets all it has; the
    others of its dimension share out what it lacks. Values without a cell go.
    """
    parts = [cells.select(F.lit(d).alias("dimension"), F.col(d).alias("value"), "tokens") for d in DIMENSIONS]
    sizes = parts[0].union(parts[1]).union(parts[2]).groupBy("dimension", "value").agg(F.sum("tokens").alias("size"))
    wanted = stored(targets.join(sizes, ["dimension", "value"]).withColumnRenamed("share", "wanted"), "targets")
    scales = filled(wanted, budget)
    if not scales or not budget:
        return targets
    scale = F.create_map(*[x for d, s in scales.items() for x in (F.lit(d), F.lit(s))])[F.col("dimension")]
    return wanted.select("dimension", "value", (F.least(F.col("size"), F.col("wanted") * scale) / F.lit(float(budget))).alias("share"))


def mixed(
    docs: DataFrame,
    tokens: Column,
    topic: Column,
    targets: DataFrame | None = None,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
    budget: float | None = None,
    seed: int = 17,
) -> tuple[DataFrame, str, str]:
    """All of ``docs`` with two more columns, whose names are returned.

    The first is the probability of the row's cell, the second whether it was
    drawn. Null source, language or topic is a value of its own. Documents of
    cells that hold no tokens are drawn with probability 0 only if empty of
    tokens themselves. Equal rows share their draw.
    """
    keys = {d: F.coalesce(c.cast("string"), F.lit(NONE)) for d, c in zip(DIMENSIONS, (F.col(source), F.col(lang), topic))}
    size = F.greatest(F.coalesce(tokens.cast("bigint"), F.lit(0)), F.lit(0))
    cells = docs.select(*[c.alias(d) for d, c in keys.items()], size.alias("tokens")).groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))
    cells = stored(cells, "cells")
    if budget is None:
        budget = KEEP * (cells.agg(F.sum("tokens")).first()[0] or 0)
    wanted = reachable(cells, tempered(cells) if targets is None else targets, budget)
    chances = stored(calibrated(rake(cells, wanted), budget), "chances")

    names = {d: fresh(docs, f"cell_{d}") for d in DIMENSIONS}
    chance, drawn = fresh(docs, "probability"), fresh(docs, "drawn")
    looked = chances.select(*[F.col(d).alias(n) for d, n in names.items()], F.col("probability").alias(chance))
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id), F.col(text)), 11) / F.lit(float(1 << 53))
    joined = docs.withColumns({names[d]: c for d, c in keys.items()}).join(looked, list(names.values()))
    return joined.withColumn(drawn, uniform < F.col(chance)).drop(*names.values()), chance, drawn


def sample(docs: DataFrame, *args, **options) -> DataFrame:
    """The drawn documents with their own columns."""
    out, _, drawn = mixed(docs, *args, **options)
    return out.where(F.col(drawn)).select(docs.columns)
