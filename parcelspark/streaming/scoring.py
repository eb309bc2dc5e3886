"""The request-scoring plan over a stream of requests.

The plan has no aggregate or window on the request side, so it needs no state
and no watermark: location resolution is an array expression, the modal-area
lookup is a stream-static join with a table bounded by the vocabulary, and
the model is applied per row. Output is append-only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.scoring import ScoringContext, score_requests


def score_stream(requests: DataFrame, ctx: ScoringContext, predict: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``predict`` adds a ``prediction`` column, as for ``score_requests``."""
    if not requests.isStreaming:
        raise ValueError("expected a streaming DataFrame")
    return score_requests(requests, ctx, predict)


def start_parquet_sink(scored: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    writer = (scored.writeStream.format("parquet").outputMode("append")
              .option("path", path).option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
