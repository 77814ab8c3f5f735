"""Chunking as a stream: documents are independent, so each micro-batch takes the batch plan and appends its chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from loomgrain.plans import api


def stream_chunks(documents: DataFrame, to_blocks: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, strategy: str = "structure", settings: dict | None = None) -> StreamingQuery:
    """documents is a streaming DataFrame of whole documents; chunks are appended to path as Parquet.

    A batch is named by its number in the path, so one that is run again after a failure
    replaces its own output.
    """
    config = settings or {}
    api.config_of(strategy, config)

    def work(batch: DataFrame, number: int) -> None:
        api.chunk(to_blocks(batch), strategy, config).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return documents.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
