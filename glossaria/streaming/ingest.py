"""Incremental collection: new documents are merged into a store as they come.

Merging is idempotent, so a batch that runs again changes nothing and no watermark is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from glossaria.operators.words import extract_entries
from glossaria.sources.store import VocabularyStore


def ingest(docs: DataFrame, store: VocabularyStore, checkpoint: str, text: str = "text", trigger: dict | None = None) -> StreamingQuery:
    """Starts merging the vocabulary of a stream of documents into the store; by default what is there now, then stops."""
    merge = lambda batch, _: store.merge_collected(extract_entries(batch, text=text))
    return docs.select(text).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def document_stream(spark: SparkSession, path: str, schema: str, files_a_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(path)
