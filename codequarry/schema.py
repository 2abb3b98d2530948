"""Schemas of the logical tables and helpers for rows that satisfy them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "file_state": "path string, mod_time timestamp, hash string, size bigint",
    "parsed": "name string, type string, qualified_name string, file_path string, start_line int, end_line int, start_col int, end_col int, signature string, doc_comment string, language string, parent string",
    "nodes": "id string, name string, type string, file_path string, start_line int, end_line int, signature string, language string",
    "edges": "source string, target string, type string, source_file string, line int, confidence double",
    "imports": "file_path string, alias string, module string",
    "symbols": "name string, qualified_name string, file_path string",
    "calls": "caller string, callee_text string, file_path string, line int, col int",
    "api_endpoints": "method string, path string, handler string, framework string, file string, line int",
    "vectors": "id string, content string, embedding array<float>, name string, type string, file_path string, language string, signature string, start_line int, end_line int",
    "commits": "hash string, short_hash string, author string, email string, message string, commit_ts timestamp",
    "file_changes": "hash string, path string, old_path string, status string, additions int, deletions int",
    "blame": "path string, line_number int, hash string, author string, email string, commit_ts timestamp, content string",
    "repos": "repo_id string, repo_path string, repo_url string, branch string, indexed_at timestamp",
}
NODE_TYPES = ("function", "class", "method", "module")
EDGE_TYPES = ("calls", "called_by", "inherits", "imports", "contains")


def empty(spark: SparkSession, name: str) -> DataFrame:
    """The table without rows."""
    return spark.createDataFrame([], SCHEMAS[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """The columns of the schema in order, cast; missing ones are null, extra ones dropped."""
    want = T._parse_datatype_string(SCHEMAS[name])
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])


def path_key(c: Column) -> Column:
    """One spelling for paths: forward slashes, none repeated, no leading ./"""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"/+", "/"), r"^(?:\./)+", "")


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in `order` (newest first); nulls in keys are one key.

    The filter on the rank becomes a limit of each task before the shuffle (WindowGroupLimit), so
    of a hot key only one row leaves a task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def nodes_of(entities: DataFrame) -> DataFrame:
    """Nodes from graph rows: last row of an id wins, paths in one spelling, no nulls in text."""
    e = entities.filter("id is not null").withColumn("file_path", F.coalesce(path_key(F.col("file_path")), F.lit("")))
    e = e.select("id", "name", "type", "file_path", "start_line", "end_line", F.coalesce("signature", F.lit("")).alias("signature"), F.coalesce("language", F.lit("")).alias("language"), "created_at")
    order = [F.col("created_at").desc_nulls_last(), *(F.col(c).asc_nulls_last() for c in ("file_path", "start_line", "end_line", "signature", "language"))]
    return keep_last(e, ["id"], order).drop("created_at")


def edge_rows(relationships: DataFrame) -> DataFrame:
    """Edges from reference rows, as often as they were delivered: cleaned ids, defaults for nulls.

    Enough, and cheaper than `edges_of`, for operators that look at distinct pairs anyway.
    """
    from codequarry.functions.ids import clean_id

    return relationships.select(
        clean_id(F.col("source_id")).alias("source"), clean_id(F.col("target_id")).alias("target"), "type",
        F.coalesce("source_file", F.lit("")).alias("source_file"), F.coalesce("line", F.lit(0)).alias("line"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.col("id").alias("_seq"),
    ).filter("source is not null and target is not null")


def edges_of(relationships: DataFrame) -> DataFrame:
    """Edges of `edge_rows` of which the first of the unique key wins."""
    from codequarry.operators.graph import insert_ignore

    return insert_ignore(edge_rows(relationships), [F.col("_seq").asc(), F.col("confidence").asc()]).drop("_seq")
