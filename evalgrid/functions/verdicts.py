"""Words and states for comparisons of two models."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def triple(value: Column, lo: Column, hi: Column) -> Column:
    """A value with its interval, rounded as boards are stored."""
    parts = ((value, "value"), (lo, "lo"), (hi, "hi"))
    return F.struct(*[F.round(column, 4).alias(name) for column, name in parts])


def cell_state(me: Column, lo: Column, hi: Column, winner: Column) -> Column:
    """How a comparison looks from one model's side.

    ``wd``/``ld`` decisive win and loss, ``ws``/``ls`` interval clear of zero
    without a decision, ``nd`` no separation. Bounds are from ``me``'s side.
    """
    return (
        F.when(winner.isNotNull(), F.when(winner == me, "wd").otherwise("ld"))
        .when(lo > 0, "ws")
        .when(hi < 0, "ls")
        .otherwise("nd")
    )


def generation_winner(delta: Column, lo: Column, hi: Column, winner: Column, prev: Column, curr: Column) -> Column:
    """Which side of a succession is ahead: ``curr``, ``prev`` or null."""
    return (
        F.when(winner == curr, "curr")
        .when(winner == prev, "prev")
        .when(lo > 0, "curr")
        .when(hi < 0, "prev")
        .when(delta > 0, "curr")
        .when(delta < 0, "prev")
    )


def verdict_text(delta: Column, side: Column, decisive: Column) -> Column:
    """A plain verdict on one succession."""
    return (
        F.when(delta.isNull(), "not paired")
        .when(side.isNull(), "dead even")
        .otherwise(
            F.concat(
                F.when(decisive, "decisive ").otherwise("slight "),
                F.when(side == "curr", "upgrade").otherwise("downgrade"),
            )
        )
    )


def confidence_text(delta: Column, side: Column, decisive: Column, suggestive: Column) -> Column:
    """How sure a verdict is, in words."""
    return (
        F.when(delta.isNull() | side.isNull(), "")
        .when(decisive, "statistically significant")
        .when(suggestive, "not conclusive after correction")
        .otherwise("not statistically significant")
    )
