"""Files that arrive under a folder, taken in as a stream of incremental scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quarrymill.operators import ingest
from quarrymill.store import Store

_FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, root: str) -> DataFrame:
    """Binary files as they appear below ``root``."""
    return spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", True).load(root)


def scan_stream(store: Store, root: str, checkpoint: str, once: bool = True, on_counts: Callable[[DataFrame], None] | None = None, **options) -> StreamingQuery:
    """Run ``ingest.scan`` whenever files arrive; it compares the whole listing, so files that go are collected too."""

    def batch(files: DataFrame, _: int) -> None:
        if files.select("path").limit(1).count():
            counts = ingest.scan(store, root, **options)
            if on_counts:
                on_counts(counts)

    writer = arriving(store.spark, root).writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer).start()
