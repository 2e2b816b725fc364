"""Answering a stream of queries against a static index, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def answer_stream(queries: DataFrame, method, k: int, path: str, checkpoint: str) -> StreamingQuery:
    """Write the answers of each micro-batch of queries under path/batch=N; a batch that is run again overwrites its own."""

    def answer(batch: DataFrame, number: int) -> None:
        method.search(batch, k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
