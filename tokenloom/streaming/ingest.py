"""Streaming ingest: new files of a folder go into the sentences table in micro-batches, each of them once.

The file source's checkpoint says which files were taken, the table's ledger which batches were committed; a micro-batch that
ran twice is known by its hash, so a restart at any moment ends in the same table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.annotated import GLOB
from ..sources.store import IngestStats, Store

FILES_PER_TRIGGER = 10_000


def documents(spark: SparkSession, folder: str, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """A stream of path, value: whole files."""
    reader = spark.readStream.format("text").schema("value string").option("wholetext", True).option("recursiveFileLookup", True)
    return reader.option("pathGlobFilter", GLOB).option("maxFilesPerTrigger", files_per_trigger).load(folder).select(F.col("_metadata.file_path").alias("path"), "value")


def start(store: Store, source: str | DataFrame, checkpoint: str, policy: str = "skip", files_per_trigger: int = FILES_PER_TRIGGER, once: bool = True, seen: Callable[[IngestStats], None] | None = None) -> StreamingQuery:
    """Start ingest of a folder, or of any stream of path and value. once: take what is there in bounded batches, then end; else go on until stopped."""
    store.ensure()

    def take(batch: DataFrame, _: int) -> None:
        stats = Store(batch.sparkSession, store.path).add_documents(batch, policy)
        if seen is not None:
            seen(stats)

    stream = documents(store.spark, source, files_per_trigger) if isinstance(source, str) else source
    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def stop(query: StreamingQuery) -> None:
    """End a query between batches: what has begun is finished first."""
    query.processAllAvailable()
    query.stop()
