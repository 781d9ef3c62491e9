"""New queries as a stream against static postings: no state, each micro-batch is a batch join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kinmatch.operators.similarity import Channel, topk_join


def stream_topk(queries: DataFrame, corpus: DataFrame, channel: Channel, depth: int, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """sink gets (country, q, c, score, rank0) of each micro-batch of queries (country, id, name, address), and its number."""
    return queries.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, number: sink(topk_join(batch, corpus, channel, depth), number)).start()
