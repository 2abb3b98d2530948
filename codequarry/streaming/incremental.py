"""Incremental indexing as a stream: changed and removed files in, a new version of the index out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codequarry.operators import indexing
from codequarry.operators.retrieval import Embedder
from codequarry.schema import keep_last

_NAMES = {"files": "file_state", "endpoints": "api_endpoints"}


def watch(spark: SparkSession, source: str, target: str, checkpoint: str, embedder: Embedder | None = None) -> StreamingQuery:
    """Parquet batches of (file_path, content, version) under `source` become versions of the index under
    `target`. A file whose newest content is null is removed.

    A batch is written under its number, over the newest version below it, so a batch that is run
    again replaces itself. Calls are resolved against the symbols of the whole index.
    """
    stream = spark.readStream.schema("file_path string, content string, version bigint").parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        newest = keep_last(batch.filter("file_path is not null"), ["file_path"], [F.col("version").desc_nulls_last()])
        removed = newest.filter("content is null").select(F.col("file_path").alias("path"))
        changed = newest.filter("content is not null").select(
            F.col("file_path").alias("path"), "content", F.lit(None).cast("timestamp").alias("mod_time"),
            F.octet_length("content").cast("bigint").alias("size"), F.sha1(F.col("content").cast("binary")).alias("hash"),
        )
        indexing.update(batch.sparkSession, target, changed, removed, embedder, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, name: str) -> DataFrame:
    """A table of the newest version: files, nodes, edges, endpoints, vectors, imports, calls or parsed."""
    return indexing.table(spark, target, _NAMES.get(name, name))
