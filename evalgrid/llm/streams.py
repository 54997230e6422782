"""What the two streaming operators share: files, batches and state on disk."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Micro-batches that a first run over a table is dealt in.
BATCHES = 4
_STORE = "spark.sql.streaming.stateStore"
#: State in RocksDB, of which a micro-batch commits what it changed. Each store
#: would set aside 4 MB of disk for its manifest, however little it holds.
_ON_DISK = {
    f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{_STORE}.rocksdb.allowFAllocate": "false",
}


@contextmanager
def disk_state(spark: SparkSession) -> Iterator[None]:
    """Streams started and states read inside keep their state on disk."""
    before = {key: spark.conf.get(key, None) for key in _ON_DISK}
    for key, value in _ON_DISK.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def files_of(spark: SparkSession, path: str, schema: str, batches: int) -> DataFrame:
    """The Parquet files at ``path`` as a stream of about ``batches`` micro-batches.

    The number of micro-batches is fixed, not their size: a batch is a Spark
    job that spills, and each has a start-up cost. ``path`` may be a folder or
    one file; a stream takes a single file only by a pattern.
    """
    count = len(spark.read.schema(schema).parquet(path).inputFiles())
    pattern = path if any(c in path for c in "*?[{") else f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, -(-count // batches))).parquet(pattern)
