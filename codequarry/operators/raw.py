"""Operators on raw source: search, line ranges, trees."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Directories that search and tree leave out.
SKIP_SEARCH = (".git", "node_modules", "vendor")
SKIP_TREE = ("node_modules", "vendor", "__pycache__")


def lines(files: DataFrame) -> DataFrame:
    """(file_path, line_number, content) of files(file_path, content)."""
    return files.select("file_path", F.posexplode(F.split("content", "\n")).alias("_i", "content")).select("file_path", (F.col("_i") + 1).alias("line_number"), "content")


def glob_regex(pattern: str) -> str:
    """A file-name glob as a regular expression for the last part of a path."""
    out = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c) if c not in "[]" else c) for c in pattern)
    return f"(?:^|/){out}$"


def grep(files: DataFrame, pattern: str, file_pattern: str | None = None, limit: int | None = 50, per_file: int | None = None) -> DataFrame:
    """T1g, T2g: lines that match a regular expression, by path and line; hidden stores and vendored folders are left out."""
    x = files.filter(~F.col("file_path").rlike("(?:^|/)(?:" + "|".join(map(re.escape, SKIP_SEARCH)) + ")/"))
    if file_pattern:
        x = x.filter(F.col("file_path").rlike(glob_regex(file_pattern)))
    x = lines(x).filter(F.col("content").rlike(pattern))
    if per_file:
        x = x.withColumn("_k", F.row_number().over(Window.partitionBy("file_path").orderBy("line_number"))).filter(F.col("_k") <= per_file).drop("_k")
    x = x.orderBy("file_path", "line_number")
    return x.limit(limit) if limit else x


def read_lines(files: DataFrame, start: int = 1, end: int = 0) -> DataFrame:
    """T3g: the lines start to end of each file; end 0 means to the last."""
    x = lines(files).filter(F.col("line_number") >= start)
    return x.filter(F.col("line_number") <= end) if end else x


def numbered(files: DataFrame, start: int = 1, end: int = 0) -> DataFrame:
    """T4g: (file_path, text) with right-aligned line numbers."""
    x = read_lines(files, start, end)
    row = F.format_string("%4d: %s", "line_number", "content")
    return x.groupBy("file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", row.alias("t")))), lambda r: r.t), "\n").alias("text"))


def tree(paths: DataFrame) -> DataFrame:
    """T5g, O4: (path, parent, name, depth, is_dir) of every file and folder; hidden and skipped folders are left out."""
    parts = F.filter(F.split("file_path", "/"), lambda p: p != "")
    hidden = F.exists("_p", lambda p: p.startswith(".") | p.isin(*SKIP_TREE))
    x = paths.select("file_path").distinct().withColumn("_p", parts).filter(~hidden & (F.size("_p") > 0))
    x = x.select("_p", F.explode(F.sequence(F.lit(1), F.size("_p"))).alias("depth"))
    join = lambda n: F.array_join(F.slice("_p", F.lit(1), n), "/")
    return x.select(join(F.col("depth")).alias("path"), join(F.col("depth") - 1).alias("parent"), F.get("_p", F.col("depth") - 1).alias("name"), "depth", (F.col("depth") < F.size("_p")).alias("is_dir")).groupBy("path", "parent", "name", "depth").agg(F.max("is_dir").alias("is_dir"))


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"(\.[^./]+)$", 1))


def tree_order(rows: DataFrame) -> DataFrame:
    """The tree by folder, folders before files, then by name."""
    return ranked(rows).orderBy("parent", "ord")


def ranked(rows: DataFrame) -> DataFrame:
    """With `ord`, the place of each entry in its folder, folders before files, then by name."""
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("is_dir"), "name")))
