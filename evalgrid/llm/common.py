"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.session import scratch_path

#: Space, tab, line feed, vertical tab, form feed, carriage return (fixed values).
BLANKS = " \t\n\x0b\f\r"
_FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths stored in the innermost ``passing`` block.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is ``stored`` in this block is deleted at its end, unless it is ``lasting``."""
    within = _PASSING.set([])
    try:
        yield
    finally:
        for path in _PASSING.get():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _PASSING.reset(within)


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query go when it ends, not when the driver's memory is next collected."""
    before = spark.conf.get(_FILE_CLEANUP, None)
    spark.conf.set(_FILE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FILE_CLEANUP) if before is None else spark.conf.set(_FILE_CLEANUP, before)


def stored(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The lineage ends there, so a lost executor costs a re-read, and Catalyst
    knows the size of what it reads when it picks a join.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if not lasting and (within := _PASSING.get()) is not None:
        within.append(path)
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def blank(text: Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The runs of characters other than ASCII white space."""
    return F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
