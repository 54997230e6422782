"""Private identifiers in published text, found in one walk over each text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrid.operators import scope

#: Characters of tokens that a task holds at a time; its automaton has a state
#: of some 100 bytes for each at most.
PART = 2_000_000


def leak_tokens(items: DataFrame, separator: str = "_") -> DataFrame:
    """Private ids and their part up to the first separator, once each."""
    private = scope.in_scope(items, scope.OFFICIAL, "id")
    head = F.when(
        F.contains("id", F.lit(separator)),
        F.concat(F.substring_index("id", separator, 1), F.lit(separator)),
    ).otherwise(F.col("id"))
    each = private.select(
        F.explode(
            F.array(
                F.struct(F.col("id").alias("token"), F.lit("id").alias("kind")),
                F.struct(head.alias("token"), F.lit("prefix").alias("kind")),
            )
        ).alias("t")
    ).select("t.token", "t.kind")
    return each.filter(F.length("token") > 0).groupBy("token").agg(F.min("kind").alias("kind"))


def _parts(tokens: DataFrame) -> list[list[str]]:
    """The tokens to look for, in parts of about ``PART`` characters."""
    wanted = tokens.select("token").filter(F.col("token").rlike(r"\S")).distinct()
    characters = wanted.agg(F.sum(F.length("token"))).first()[0] or 0
    n = -(-characters // PART)
    part = F.pmod(F.xxhash64("token"), F.lit(n or 1))
    return [[row["token"] for row in wanted.filter(part == i).collect()] for i in range(n)]


def _found(tokens: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Looks for all of ``tokens`` in each text in one walk over its characters."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for token in tokens.value:
            automaton.add_word(token, token)
        automaton.make_automaton()
        for batch in batches:
            found = [sorted({token for _, token in automaton.iter(text)}) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.list_(pa.string()))], ["key", "tokens"])

    return find


def find_tokens(documents: DataFrame, tokens: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, token) for every token that occurs anywhere in a text, once each.

    Each task holds the tokens as one automaton and walks its texts once; no
    text is shuffled, and the work does not depend on how many tokens there are
    or how common. Tokens reach the tasks in parts of bounded size, with a pass
    over the texts for each. Tokens of white space alone are not looked for,
    and rows without a key or text are not searched.
    """
    texts = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).dropna()
    kind = texts.schema["key"].dataType.simpleString()
    context = documents.sparkSession.sparkContext
    passes = [texts.mapInArrow(_found(context.broadcast(part)), f"key {kind}, tokens array<string>") for part in _parts(tokens)]
    none = texts.select("key", F.array().cast("array<string>").alias("tokens")).filter("false")
    return reduce(DataFrame.union, passes or [none]).select(F.col("key").alias(key), F.explode("tokens").alias("token")).distinct()


def leak_counts(documents: DataFrame, tokens: DataFrame, key: str, text: str = "text") -> DataFrame:
    """In how many texts each leaked token occurs."""
    return find_tokens(documents, tokens, key, text).groupBy("token").agg(F.count(F.lit(1)).alias("n_documents"))
