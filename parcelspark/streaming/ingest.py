"""Incremental ingest as a stream.

New document files arriving in a directory are chunked and embedded (one
narrow stage, no state), and every micro-batch is upserted into the store.
The store commits a batch together with its epoch and source offsets, so a micro-batch that is
replayed after a crash between the write and the stream's own commit is skipped. Rows of equal
ids in one batch are ordered by arrival: the file's time, its path and the row's place in it.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import HASH_BUCKETS
from ..sources.store import upsert

ARRIVAL = "arrival"


def with_arrival(files: DataFrame) -> DataFrame:
    """A file source's rows (Parquet, batch or stream) with ``arrival``: (file time, path, row in the file)."""
    return files.withColumn(ARRIVAL, F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.row_index"))


def _stream_of(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the stream when the checkpoint was made."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()["value"])["id"]


def ingest_stream(spark: SparkSession, stream: DataFrame, to_chunks: Callable[[DataFrame], DataFrame],
                  root: str, name: str, checkpoint: str, dimension: int = HASH_BUCKETS,
                  available_now: bool = True, order_by: str | None = None):
    """Start the stream; with ``available_now`` it processes what exists and
    stops. ``order_by`` names a column of the chunks (``ARRIVAL``) by which the last of equal ids in a
    batch wins. Returns the query handle."""
    chunks = to_chunks(stream)

    def write(batch: DataFrame, epoch_id: int) -> None:
        own = batch.sparkSession
        if not batch.isEmpty():  # by a first row; kept rows would fill the executors' memory
            offsets = own.read.text(f"{checkpoint}/offsets/{epoch_id}", wholetext=True).first()["value"]
            upsert(own, root, name, batch, dimension, order_by=order_by,
                   stream=_stream_of(own, checkpoint), epoch=epoch_id, offsets=offsets)

    writer = chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
