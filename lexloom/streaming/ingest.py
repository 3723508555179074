"""Incremental indexing of a stream of documents.

Each micro-batch is indexed by itself and appended as a segment; a segment's folder is named after its batch number and
replaced when a batch is run again, so the index holds every batch once. Reading merges the segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.operators.index import DOCS, POSTINGS, InvertedIndex, build_index
from lexloom.options import IndexOptions


def append_segment(batch: DataFrame, number: int, path: str, options: IndexOptions) -> None:
    """batch: doc_idx, docno, content; doc_idx is unique over the whole stream."""
    batch = batch.persist()  # both tables come from one read of the source
    index = build_index(batch, options)
    for name, table in (("docs", index.docs), ("postings", index.postings)):
        table.write.mode("overwrite").parquet(f"{path}/{name}/segment={number}")
    batch.unpersist()


def index_stream(docs: DataFrame, path: str, checkpoint: str, options: IndexOptions, **trigger) -> StreamingQuery:
    """docs: a streaming DataFrame of doc_idx, docno, content. trigger: as for DataStreamWriter.trigger."""
    writer = docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: append_segment(batch, number, path, options))
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_segments(spark: SparkSession, path: str, options: IndexOptions) -> InvertedIndex:
    """The index over all segments written so far."""
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}").select(*[F.col(c.split()[0]) for c in schema.split(", ")])
    return InvertedIndex(read("docs", DOCS), read("postings", POSTINGS), options)
