"""Point lookups, plain filters, projections and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_id(nodes: DataFrame, id_: str) -> DataFrame:
    """the node, or no row."""
    return nodes.filter(F.col("id") == id_)


def scan(table: DataFrame) -> DataFrame:
    """all nodes or all edges."""
    return table


def by_file(nodes: DataFrame, file: str) -> DataFrame:
    """equality, no pattern."""
    return nodes.filter(F.col("file_path") == file)


def by_type(nodes: DataFrame, type_: str) -> DataFrame:
    """F4."""
    return nodes.filter(F.col("type") == type_)


def hit_rows(hits: DataFrame, vectors: DataFrame) -> DataFrame:
    """search hits as they are handed out: (query_id, rank, entity_id, content, score, type)."""
    return hits.join(vectors.select("id", "content", "type"), "id").select("query_id", "rank", F.col("id").alias("entity_id"), "content", "score", "type")


def node_rows(nodes: DataFrame) -> DataFrame:
    """nodes as they are handed out."""
    return nodes.select("id", "name", "type", "file_path", "start_line", "end_line", "signature")


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """U1."""
    return a.unionByName(b).distinct()


def difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a without a row of b of the same keys; repeats stay."""
    return a.join(b.select(*keys).distinct(), list(keys), "left_anti").select(*a.columns)


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """U4: one row for each key, the first by `order`, with the ordinal of keys kept by that order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
