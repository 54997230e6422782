"""Exact duplicates by a stream with state on disk.

All files of a table are read as available-now micro-batches. The state is
keyed by the digest of the normalised text and never expires; it lives in
RocksDB and is committed to the checkpoint folder. For a digest it retains

* how many rows had it,
* the row that stays: the most code points before normalising, then the
  smallest id (null ids last), then the place; with its id,
* the place of that row's content: file and row number, not the content.

Map-side combining comes before the shuffle, so a text that a third of all
rows share sends one row per task. Another run with the same checkpoint reads
only new files.

A row whose digest is retained for another row is a hit. Hits are not taken on
trust: both texts are fetched by their places and compared in full. A row that
differs from the retained text (a collision of digests) leaves the group and
is grouped by its whole text instead, so results are exact under any digest.

Defined cases: null texts count as empty; empty and blank texts are one group.
Rows without an id are reported and can stay (then ``keep_id`` is null). Of
several rows with one id and equal texts one stays. Other columns are not read.
An empty table gives no rows. Assess what was ingested: a row of another file is
reported only if its digest is retained, and does not count in its group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.llm.common import BLANKS, blank, stored
from evalgrid.llm.streams import BATCHES, disk_state, files_of
from evalgrid.session import scratch_path


def bare(text: Column) -> Column:
    """The text without ASCII white space."""
    return F.translate(blank(text), BLANKS, "")


def sha256(normalised: Column) -> Column:
    return F.unhex(F.sha2(normalised.cast("binary"), 256))


def _rows(df: DataFrame, id: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    return df.select(
        F.col(id).alias("id"),
        F.length(blank(F.col(text))).alias("n_chars"),
        digest(bare(F.col(text))).alias("digest"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )


def _first() -> Column:
    """The row that stays; the least of these."""
    return F.min(F.struct((-F.col("n_chars")).alias("fewer"), F.isnull("id").alias("anonymous"), "id", "file", "row"))


class ExactDuplicates:
    """Remembers the texts of Parquet files under ``checkpoint``, in the shared folder."""

    def __init__(self, spark: SparkSession, checkpoint: str, id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256):
        self.spark, self.checkpoint, self.id, self.text, self.digest = spark, checkpoint, id, text, digest

    def _schema(self, path: str) -> str:
        types = {f.name: f.dataType.simpleString() for f in self.spark.read.parquet(path).schema}
        return ", ".join(f"`{name}` {types[name]}" for name in dict.fromkeys((self.id, self.text)))

    def ingest(self, path: str, batches: int = BATCHES) -> None:
        """Take in all files at ``path`` that this checkpoint has not seen."""
        rows = _rows(files_of(self.spark, path, self._schema(path), batches), self.id, self.text, self.digest)
        groups = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("size"), _first().alias("keep"))
        with disk_state(self.spark):
            query = groups.writeStream.format("noop").outputMode("update").option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
            query.awaitTermination()

    def memory(self) -> DataFrame:
        """What is retained: digest, size, keep_id, keep_file, keep_row."""
        with disk_state(self.spark):
            state = self.spark.read.format("statestore").load(self.checkpoint)
            size, keep = (f"value.{field}" for field in state.schema["value"].dataType.names)
            found = state.select(
                F.col("key.digest").alias("digest"),
                F.col(size).alias("size"),
                F.col(f"{keep}.id").alias("keep_id"),
                F.col(f"{keep}.file").alias("keep_file"),
                F.col(f"{keep}.row").alias("keep_row"),
            )
            return stored(found, "memory")

    def assess(self, path: str) -> DataFrame:
        """(id, digest, keep_id, group_size, kept) of every row at ``path``."""
        table = self.spark.read.schema(self._schema(path)).parquet(path)
        rows = _rows(table, self.id, self.text, self.digest)
        groups = self.memory()
        itself = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
        met = stored(rows.join(groups, "digest").withColumn("kept", itself), "met")
        wrong = self._collisions(table, met.where(~F.col("kept")))
        fewer = wrong.groupBy("digest").agg(F.count(F.lit(1)).alias("gone"))
        apart = wrong.groupBy("digest", "body").agg(F.count(F.lit(1)).alias("size"), _first().alias("keep"))
        apart = wrong.join(apart, ["digest", "body"]).select(
            "file", "row", F.col("size").alias("own_size"), F.col("keep.id").alias("own_id"),
            ((F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))).alias("own_kept"),
        )
        settled = met.join(fewer, "digest", "left").join(apart, ["file", "row"], "left")
        own = F.col("own_size").isNotNull()
        return settled.select(
            F.col("id").alias(self.id),
            "digest",
            F.when(own, F.col("own_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.when(own, F.col("own_size")).otherwise(F.col("size") - F.coalesce("gone", F.lit(0))).alias("group_size"),
            F.when(own, F.col("own_kept")).otherwise(F.col("kept")).alias("kept"),
        )

    def _collisions(self, table: DataFrame, hits: DataFrame) -> DataFrame:
        """The hits whose full text is not the retained one, with their text."""
        places = hits.select("file", "row").union(hits.select("keep_file", "keep_row")).distinct()
        texts = table.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), bare(F.col(self.text)).alias("body"))
        texts = stored(texts.join(places, ["file", "row"]), "contents")
        retained = texts.select(F.col("file").alias("keep_file"), F.col("row").alias("keep_row"), F.col("body").alias("keep_body"))
        pairs = hits.join(texts, ["file", "row"]).join(retained, ["keep_file", "keep_row"])
        return stored(pairs.where("body <> keep_body").select("file", "row", "id", "n_chars", "digest", "body"), "collisions")


def exact_duplicates(spark: SparkSession, path: str, id: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """All rows at ``path``, assessed after one run over its files."""
    memory = ExactDuplicates(spark, scratch_path(spark, "exact-dedup"), id, text)
    memory.ingest(path, batches)
    return memory.assess(path)
