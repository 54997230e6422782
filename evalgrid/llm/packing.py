"""Best-fit packing of documents into training sequences, with conflicts.

No bin holds two documents of one source or of one duplicate cluster. Bins
that still have room are ordered by their residual and carry two bitmaps, of
the sources and of the clusters they hold. A document goes to the tightest
bin that is compatible: the successor search starts at the least residual
that fits and goes on to the next larger one until the bitmaps allow it.

Documents are dealt by a hash to shards of about ``PER_SHARD`` and packed
longest first within their shard. A task sees a shard as a sorted stream and
packs at most ``WINDOW`` shards' worth of documents at a time, so its memory is
bounded whatever the shards hold, and one source or cluster may make up any
part of the rows.
"""

from __future__ import annotations

from bisect import insort
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Tokens a bin holds.
CAPACITY = 1024
#: Documents a shard has on average.
PER_SHARD = 2048
#: Shards' worth of documents that a task holds at most; only a shard far larger
#: than the others is packed in several windows.
WINDOW = 4


class Bins:
    """Open bins of one shard, ordered by residual."""

    def __init__(self, capacity: int, first: int = 0) -> None:
        self.capacity, self.count = capacity, first
        self.at: dict[int, list[tuple[int, int, int]]] = {}  # residual -> (bin, sources, clusters), by bin
        self.open = 0  # bit r is set while a bin of residual r is open

    def place(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset) of a document; source and cluster are bitmaps of a bit or none."""
        larger = self.open >> length
        residual = length - 1
        while larger:
            step = (larger & -larger).bit_length()
            residual, larger = residual + step, larger >> step
            for place, (number, sources, clusters) in enumerate(self.at[residual]):
                if not (sources & source or clusters & cluster):
                    self._take(residual, place)
                    self._put(residual - length, (number, sources | source, clusters | cluster))
                    return number, self.capacity - residual
        self.count += 1
        self._put(self.capacity - length, (self.count - 1, source, cluster))
        return self.count - 1, 0

    def _take(self, residual: int, place: int) -> None:
        del self.at[residual][place]
        if not self.at[residual]:
            self.open &= ~(1 << residual)

    def _put(self, residual: int, found: tuple[int, int, int]) -> None:
        if residual:  # a full bin is never met again
            insort(self.at.setdefault(residual, []), found)
            self.open |= 1 << residual


def pack(items: Iterable[tuple[int, str | None, int | None]], capacity: int, first: int = 0) -> tuple[list[list[tuple[int, int, int, int]]], int]:
    """Place (length, source, cluster) items in the order given.

    Returns the pieces (piece, length, bin, offset) of each item and the next
    free bin number. An item longer than a bin is cut: full pieces fill bins
    of their own, the rest is packed. Length zero gives no piece. Null sources
    and clusters never conflict.
    """
    items = list(items)
    numbers: dict[str, int] = {}
    repeated = Counter(c for _, _, c in items if c is not None)
    clusters: dict[int, int] = {}
    bins, placed = Bins(capacity, first), []
    for length, source, cluster in items:
        source_bit = 0 if source is None else 1 << numbers.setdefault(source, len(numbers))
        cluster_bit = 1 << clusters.setdefault(cluster, len(clusters)) if repeated.get(cluster, 0) > 1 else 0
        full, rest = divmod(length, capacity)
        pieces = []
        for piece in range(full):
            pieces.append((piece, capacity, bins.count, 0))
            bins.count += 1
        if rest:
            pieces.append((full, rest, *bins.place(rest, source_bit, cluster_bit)))
        placed.append(pieces)
    return placed, bins.count


def _packer(capacity: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        shard, first, kind = None, 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first
            placed, first = pack([(n, source, cluster) for _, n, source, cluster in kept], capacity, first)
            rows = [(i, source, p) for (i, _, source, _), pieces in zip(kept, placed) for p in pieces or [(0, 0, None, None)]]
            kept.clear()
            for at in range(0, len(rows), 10_000):
                part = rows[at : at + 10_000]
                columns = [
                    pa.array([r[0] for r in part], kind),
                    pa.array([r[1] for r in part], pa.string()),
                    pa.array([r[2][0] for r in part], pa.int32()),
                    pa.array([r[2][1] for r in part], pa.int64()),
                    pa.array([None if r[2][2] is None else shard for r in part], pa.int64()),
                    pa.array([r[2][2] for r in part], pa.int64()),
                    pa.array([r[2][3] for r in part], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "source", "piece", "n_tokens", "shard", "bin", "bin_offset"])

        for batch in batches:
            kind = batch.schema.field("id").type
            for own, *item in zip(*(batch.column(c).to_pylist() for c in ("shard", "id", "length", "source", "cluster"))):
                if own != shard or len(kept) >= window:
                    yield from flush()
                if own != shard:
                    shard, first = own, 0
                kept.append(tuple(item))
        yield from flush()

    return run


@F.pandas_udf(LongType())
def text_cluster(texts: pd.Series) -> pd.Series:
    """Duplicate cluster of a text: equal but for A-Z and white space; null has none."""
    digests = (None if t is None else xxhash.xxh64_intdigest(b" ".join(t.encode().lower().split())) - 2**63 for t in texts)
    return pd.Series(list(digests), dtype="Int64")


@F.pandas_udf(LongType())
def word_count(texts: pd.Series) -> pd.Series:
    """Words between ASCII white space, the default measure of length; null has none."""
    return pd.Series([0 if t is None else len(t.encode().split()) for t in texts], dtype="int64")


def best_fit(
    docs: DataFrame,
    length: Column,
    cluster: Column,
    id: str = "doc_id",
    source: str = "source",
    capacity: int = CAPACITY,
    per_shard: int = PER_SHARD,
) -> DataFrame:
    """(``id``, source, piece, n_tokens, bin_id, bin_offset): where each document goes.

    One row for each piece; a document without tokens has one row with piece
    and tokens 0 and no bin. ``bin_id`` is ``shard:bin``. Negative and null
    lengths count as 0. Repeated rows are packed each for itself. Shards are
    dealt by a hash of id, length, source and cluster and ordered by the same,
    so the result does not depend on how the input is partitioned, and neither
    null nor repeated ids fill a shard; only rows equal in all four share one.
    """
    shards = max(1, -(-docs.count() // per_shard))
    items = docs.select(
        F.col(id).alias("id"),
        F.greatest(F.coalesce(length.cast("bigint"), F.lit(0)), F.lit(0)).alias("length"),
        F.col(source).cast("string").alias("source"),
        cluster.cast("bigint").alias("cluster"),
    ).withColumn("shard", F.pmod(F.xxhash64("id", "length", "source", "cluster"), F.lit(shards)))
    dealt = items.repartition("shard").sortWithinPartitions("shard", (F.col("length") % capacity).desc(), "id", "length", "source", "cluster")
    kind = items.schema["id"].dataType.simpleString()
    placed = dealt.mapInArrow(
        _packer(capacity, WINDOW * per_shard),
        f"id {kind}, source string, piece int, n_tokens bigint, shard bigint, bin bigint, bin_offset bigint",
    )
    name = F.when(F.col("bin").isNotNull(), F.concat_ws(":", "shard", "bin"))
    return placed.select(F.col("id").alias(id), F.col("source").alias(source), "piece", "n_tokens", name.alias("bin_id"), "bin_offset")
