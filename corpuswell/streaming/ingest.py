"""Incremental ingestion: documents that arrive are chunked and committed to the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from corpuswell.operators.chunkers import index_chunks
from corpuswell.sources.versions import VersionedIndex


def ingest_stream(docs: DataFrame, strategy: str, path: str, checkpoint: str, buckets: int = 16, most: int = 8) -> StreamingQuery:
    """Starts a query that takes what is there of a stream of documents and ends.

    Each batch is a commit to the versioned index under path: it writes its own chunks and nothing else of the index. A batch that runs again after a
    failure finds itself in the log. Buckets of more than `most` folders are compacted now and then, so that readers merge few.
    """

    def batch(rows: DataFrame, number: int) -> None:
        index = VersionedIndex(rows.sparkSession, path, buckets)
        if not rows.isEmpty():
            index.upsert(index_chunks(rows, strategy), batch=f"{checkpoint}-{number}")
        if number % most == most - 1:
            index.compact(most)

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
