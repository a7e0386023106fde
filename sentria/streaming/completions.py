"""Completions of a stream of queries against a stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sentria.operators.complete import LIMIT, complete_batch
from sentria.operators.index import SentenceIndex
from sentria.shared import passing


def stream_completions(queries: DataFrame, index: SentenceIndex, out: str, checkpoint: str, k: int = LIMIT, available_now: bool = False) -> StreamingQuery:
    """Answer a streaming table (query_id, prefix) micro-batch by micro-batch.

    Each batch is a folder ``out/batch=<n>``; a batch that runs twice replaces its
    own folder, so every query is answered once. No state is kept: a line that is
    submitted is the whole query. A batch leaves no working table behind.
    """

    def answer(batch: DataFrame, number: int) -> None:
        with passing(batch.sparkSession):
            complete_batch(index.sentences, index.postings, batch, SentenceIndex.KEY, k=k, sizes=index.sizes).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
