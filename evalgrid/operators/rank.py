"""Boards: positions, overlap bands, floors and price spans.

A board has one row per model (and run), so its windows and sorts are small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalgrid.operators import scan, scope


def positions(board: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Add ``pos`` by score, ties broken by name."""
    order = Window.partitionBy(*(keys or [])).orderBy(F.desc("score"), "model")
    return board.withColumn("pos", F.row_number().over(order))


def board_order(board: DataFrame) -> DataFrame:
    """Sort for display: ranked, then provisional, then baselines."""
    provisional = ~F.col("is_baseline") & ~F.col("ranked_eligible")
    return board.orderBy("is_baseline", provisional, F.desc("score"), "model")


def places(board: DataFrame) -> DataFrame:
    """Add ``place`` in display order, from 1, whatever the number of models.

    Numbered range by range, so no task holds the whole board.
    """
    provisional = ~F.col("is_baseline") & ~F.col("ranked_eligible")
    staged = board.withColumn("__group", F.when(F.col("is_baseline"), 2).when(provisional, 1).otherwise(0))
    order = [F.col("__group").asc(), F.col("score").desc(), F.col("model").asc()]
    return scan.numbered(staged, order, "place").drop("__group")


def leader_band(board: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Models whose interval reaches the leader's lower bound."""
    keys = keys or []
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), "model")
    return (
        board.withColumn("leader_lo", F.first("lo").over(best))
        .filter(F.col("hi") >= F.col("leader_lo"))
    )


def overlap_bands(board: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Add ``rank`` (band), ``pos`` and ``tied``.

    Bands open greedily from the top; a model joins while its interval reaches
    the lower bound of the band's leader. Each leader depends on the one
    before, so the ordered board of one run is folded as an array. Provisional
    models come without rank; baselines are left out.
    """
    keys = keys or []
    models = board.filter(~F.col("is_baseline"))
    ranked = models.filter("ranked_eligible")
    lines = F.sort_array(
        F.collect_list(F.struct((-F.col("score")).alias("down"), F.col("model"), F.col("lo"), F.col("hi")))
    )
    row = "struct<model:string,pos:int,rank:int>"
    start = F.struct(
        F.lit(0).alias("band"),
        F.lit(None).cast("double").alias("leader_lo"),
        F.array().cast(f"array<{row}>").alias("rows"),
    )

    def step(state, line):
        opens = state["leader_lo"].isNull() | (line["hi"] < state["leader_lo"])
        band = F.when(opens, state["band"] + 1).otherwise(state["band"])
        entry = F.struct(
            line["model"].alias("model"), (F.size(state["rows"]) + 1).alias("pos"), band.alias("rank")
        )
        return F.struct(
            band.alias("band"),
            F.when(opens, line["lo"]).otherwise(state["leader_lo"]).alias("leader_lo"),
            F.concat(state["rows"], F.array(entry)).cast(f"array<{row}>").alias("rows"),
        )

    placed = (
        ranked.groupBy(*keys)
        .agg(lines.alias("lines"))
        .select(*keys, F.explode(F.aggregate("lines", start, step, lambda s: s["rows"])).alias("r"))
        .select(*keys, "r.model", "r.pos", "r.rank")
        .withColumn("tied", F.count(F.lit(1)).over(Window.partitionBy(*keys, "rank")) > 1)
    )
    return models.join(placed, [*keys, "model"], "left").withColumn(
        "tied", F.coalesce("tied", F.lit(False))
    )


def naive_floor(board: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The score of the first baseline by name."""
    floors = board.filter(scope.is_baseline(F.col("model")))
    return floors.groupBy(*(keys or [])).agg(
        F.round(F.min_by("score", "model"), 1).alias("naive_floor"), F.min("model").alias("baseline")
    )


def price_span(banded: DataFrame) -> DataFrame:
    """Cheapest and dearest priced model of the top band.

    Gives a row only if at least two priced models differ.
    """
    priced = scope.eligible_rows(banded).filter(
        (F.col("rank") == 1) & F.col("price_in").isNotNull() & F.col("price_out").isNotNull()
    )
    blended = F.col("price_in") + F.col("price_out")
    return (
        priced.agg(
            F.min_by("model", F.struct(blended, F.col("pos"))).alias("cheapest"),
            F.max_by("model", F.struct(blended, -F.col("pos"))).alias("dearest"),
            F.min(blended).alias("cheapest_price"),
            F.max(blended).alias("dearest_price"),
            F.count(F.lit(1)).alias("n_priced"),
        )
        .filter((F.col("n_priced") >= 2) & (F.col("cheapest") != F.col("dearest")))
    )


def best_per_run(board: DataFrame) -> DataFrame:
    """The top ranked model of every run and how many models it ranked."""
    ranked = scope.ranked_only(board)
    top = F.struct((-F.col("score")).alias("down"), F.col("model"))
    return ranked.groupBy("run_id").agg(
        F.min_by("model", top).alias("best_model"),
        F.max("score").alias("best_score"),
        F.countDistinct("model").alias("n_models"),
    )
