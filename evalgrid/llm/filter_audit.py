"""How filters interact: what every order of five filters removes, and why.

A stream over the documents, all files as available-now micro-batches, keeps
counters of failure masks per part. Four filters look at one text alone; the
fifth (E) fails where a smaller id has the same text anywhere in the table. So
a document counts as passing E until a smaller id arrives, and then its
earlier mask is **retracted**: -1 under the old mask, +1 under the new one.

* Masks are worked out in native expressions where the text is read; from
  there on only its digest travels.
* State is keyed by text digest, ``buckets`` ranges of them: for each text the
  least id so far and the mask, part and labels under which it was counted.
  It lies in RocksDB and is committed to the checkpoint folder.
* Before the shuffle each Arrow batch is reduced: of equal texts only the
  least id can still hold, all others are settled as failing E and travel as
  counts. A text that a third of all rows share sends one row per batch.
* A micro-batch writes the sum of its signed counts to a folder of its own,
  which a retry overwrites. The counters are the sum over those folders, at
  most 128 numbers per part, and all orders follow from them.

Defined cases: null texts count as empty; a null part is the empty string. A
row without an id passes E and makes no other row fail it; rows that share an
id and a text do not fail for each other. A document is good (toxic) if any of
its labels says so. Other columns are not read. An empty table has no parts
and gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evalgrid.llm.common import blank, let, words
from evalgrid.llm.streams import BATCHES, disk_state, files_of
from evalgrid.session import scratch_path

FILTERS = "ABCDE"
#: Limits of the first three filters, and the characters of the fourth (fixed values).
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 200, 50, 3, "[#$%&*|]"
#: Documents of a state bucket, about.
BUCKET = 1024
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_REPEATS = 1 << FILTERS.index("E")
_SALTS = 8
_WHO = ["part", "mask", "good", "toxic"]
_HELD = ["digest", "id", *_WHO]
_ROW = "digest binary, id bigint, part string, mask int, good boolean, toxic boolean, n bigint"
_COUNTED = "part string, mask int, good boolean, toxic boolean, n bigint"


def own_mask(text: Column) -> Column:
    """Bits of the filters that fail on the text alone, A lowest."""

    def judged(w: Column) -> Column:
        n = F.size(w)
        capitals = F.length(text) - F.length(F.translate(text, _CAPITALS, ""))
        failing = [
            n < MIN_WORDS,
            100 * F.size(F.array_distinct(w)) < MIN_DISTINCT * n,
            100 * capitals > MAX_CAPITALS * F.length(text),
            text.rlike(SYMBOLS),
        ]
        return sum((F.when(fails, 1 << bit).otherwise(0) for bit, fails in enumerate(failing)), F.lit(0))

    return let(words(text), judged)


def _reduced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows whose E may still change, with counts of those for which it is settled."""
    for f in frames:
        named = f[f["named"]]
        holds = pd.Series(False, index=f.index)
        holds[named.index] = named["id"] == named.groupby("digest")["id"].transform("min")
        held = f[holds].groupby(_HELD, as_index=False).size().rename(columns={"size": "n"}).assign(settled=False)
        rest = f[~holds]
        rest = rest.assign(mask=rest["mask"] | (rest["named"] * _REPEATS).astype("int32"))
        rest = rest.groupby(_WHO, as_index=False).size().rename(columns={"size": "n"}).assign(digest=b"", id=0, settled=True)
        yield pd.concat([held, rest])[[*_HELD, "n", "settled"]]


def _summed(changes: list[pd.DataFrame]) -> pd.DataFrame:
    total = pd.concat(changes)[[*_WHO, "n"]].groupby(_WHO, as_index=False)["n"].sum()
    return total[total["n"] != 0]


class Holders(StatefulProcessor):
    """The least id of each text of a bucket, and how it was counted."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._held = handle.getValueState("held", "rows binary")

    def _before(self, like: pd.DataFrame) -> pd.DataFrame:
        state = self._held.get()
        if state is None:
            return like.iloc[:0]
        return pa.ipc.open_stream(state[0]).read_pandas()

    def _remember(self, held: pd.DataFrame) -> None:
        rows = pa.Table.from_pandas(held, preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_table(rows)
        self._held.update((sink.getvalue().to_pybytes(),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        settled, new = new[new["settled"]], new.loc[~new["settled"], [*_HELD, "n"]]
        before = self._before(new)
        both = pd.concat([before, new], ignore_index=True)
        counted = both.index < len(before)
        holds = both["id"] == both.groupby("digest")["id"].transform("min")
        fails = both.assign(mask=both["mask"] | _REPEATS)
        yield _summed([
            settled,
            both[~counted & holds],
            fails[~holds],  # new rows and retracted ones
            both[counted & ~holds].assign(n=lambda f: -f["n"]),  # the retraction
        ])
        if len(new):
            self._remember(both[holds].groupby(_HELD, as_index=False)["n"].sum())

    def close(self) -> None:
        pass


def labelled(masked: DataFrame, labels: DataFrame, id: str) -> DataFrame:
    """``masked`` rows with good and toxic by any of their ``labels``.

    An id may be hot, so each label meets its rows under every salt. Catalyst
    takes those rows for as small as the file of labels and would send them to
    the driver to broadcast them; the hint has both sides shuffled instead.
    """
    told = labels.where(F.isnotnull(id)).groupBy(F.col(id).cast("bigint").alias("id"))
    told = told.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"), F.lit(True).alias("named"))
    told = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    known = masked.join(told.hint("merge"), ["id", "named", "salt"], "left")
    return known.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


class FilterAudit:
    """Counters of failure masks of the Parquet files ingested under ``checkpoint``.

    Another run with the same checkpoint takes in only new files; it needs the
    same ``buckets``.
    """

    def __init__(self, spark: SparkSession, checkpoint: str, id: str = "doc_id", text: str = "text", part: str = "lang"):
        self.spark, self.checkpoint, self.id, self.text, self.part = spark, checkpoint, id, text, part

    def ingest(self, path: str, labels: DataFrame, batches: int = BATCHES, buckets: int | None = None) -> None:
        """Take in the files at ``path``; ``labels`` has the id, quality and toxic."""
        table = self.spark.read.parquet(path)
        types = {f.name: f.dataType.simpleString() for f in table.schema}
        schema = ", ".join(f"`{c}` {types[c]}" for c in dict.fromkeys((self.id, self.text, self.part)))
        buckets = buckets or math.ceil((table.count() + 1) / BUCKET)

        text = blank(F.col(self.text))
        masked = files_of(self.spark, path, schema, batches).select(
            F.coalesce(F.col(self.id).cast("bigint"), F.lit(0)).alias("id"),
            F.isnotnull(self.id).alias("named"),
            blank(F.col(self.part)).alias("part"),
            own_mask(text).alias("mask"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
            (F.col("_metadata.row_index") % _SALTS).cast("int").alias("salt"),
        )
        known = labelled(masked, labels, self.id)
        reduced = known.select(*_HELD, "named").mapInPandas(_reduced, f"{_ROW}, settled boolean")
        spread = F.when(F.col("settled"), F.xxhash64(*_WHO, F.spark_partition_id())).otherwise(F.xxhash64("digest"))
        counts = (
            reduced.withColumn("bucket", F.pmod(spread, F.lit(buckets)))
            .groupBy("bucket")
            .transformWithStateInPandas(Holders(), outputStructType=_COUNTED, outputMode="Append", timeMode="None")
        )
        with disk_state(self.spark):
            stream = counts.writeStream.foreachBatch(self._commit).outputMode("append").option("checkpointLocation", f"{self.checkpoint}/stream")
            stream.trigger(availableNow=True).start().awaitTermination()

    def _commit(self, changes: DataFrame, batch: int) -> None:
        total = changes.groupBy(*_WHO).agg(F.sum("n").alias("n"))
        total.coalesce(1).write.mode("overwrite").parquet(f"{self.checkpoint}/changes/batch={batch}")

    def counters(self) -> DataFrame:
        """(part, mask, good, toxic, n): documents by failure mask."""
        changes = self.spark.read.schema(_COUNTED).parquet(f"{self.checkpoint}/changes/*")
        return changes.groupBy(*_WHO).agg(F.sum("n").alias("n")).where("n > 0")


def _steps() -> Column:
    """All steps of all orders: (filter_order, step, bit, earlier bits)."""
    rows = []
    for order in permutations(FILTERS):
        earlier = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            rows.append(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(step).alias("step"), F.lit(bit).alias("bit"), F.lit(earlier).alias("earlier")))
            earlier |= bit
    return F.array(*rows)


def interactions(counters: DataFrame) -> DataFrame:
    """One row per part, order and step, from counters of failure masks.

    Shapley sums over all orders what a filter removes: of the documents that
    fail k filters, each of them is first in 1/k of the orders.
    """
    masks = range(1 << len(FILTERS))
    orders = math.factorial(len(FILTERS))

    def per_mask(condition: Column) -> Column:
        return F.array(*[F.coalesce(F.sum(F.when((F.col("mask") == m) & condition, F.col("n"))), F.lit(0)) for m in masks])

    parts = counters.groupBy("part").agg(per_mask(F.lit(True)).alias("n"), per_mask(F.col("good")).alias("good"), per_mask(F.col("toxic")).alias("toxic"))
    steps = parts.withColumn("s", F.explode(_steps())).select("part", "n", "good", "toxic", "s.*")
    bit, earlier = F.col("bit"), F.col("earlier")

    def total(counts: str, wanted) -> Column:
        kept = F.filter(F.transform(F.col(counts), lambda n, m: F.when(wanted(m), n)), F.isnotnull)
        return F.aggregate(kept, F.lit(0).cast("bigint"), lambda a, n: a + n)

    def hits(m: Column, bits: Column) -> Column:
        return m.bitwiseAND(bits) != 0

    def here(m: Column) -> Column:
        return hits(m, bit) & ~hits(m, earlier)

    shares = F.transform("n", lambda n, m: F.when(hits(m, bit), n * F.lit(orders).cast("bigint") / F.bit_count(m)).otherwise(0.0).cast("bigint"))
    return steps.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda m: ~hits(m, earlier.bitwiseOR(bit))).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: hits(m, bit) & hits(m, earlier)).alias("redundant"),
        F.element_at("n", bit + 1).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        F.aggregate(shares, F.lit(0).cast("bigint"), lambda a, n: a + n).alias("shapley"),
    )


def audit(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The interactions over all files at ``path``, after one run over them."""
    ledger = FilterAudit(spark, scratch_path(spark, "filter-audit"))
    ledger.ingest(path, labels, batches)
    return interactions(ledger.counters())
