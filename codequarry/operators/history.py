"""Commit history over commits(hash, author, email, message, commit_ts) and file_changes(hash, path, old_path, status, additions, deletions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_date(c: Column) -> Column:
    """H2: RFC 3339, else YYYY-MM-DD, else null."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))


def commit_row(commits: DataFrame) -> DataFrame:
    """H8: with short_hash of eight characters and a trimmed message."""
    return commits.withColumn("short_hash", F.left("hash", F.lit(8))).withColumn("message", F.regexp_replace("message", r"^\s+|\s+$", ""))


def _time(x: object) -> Column:
    """A time, or a text of one; null for other texts, which then bound nothing."""
    return parse_date(F.lit(x)) if isinstance(x, str) else F.lit(x)


def log(commits: DataFrame, changes: DataFrame | None = None, author: str | None = None, keyword: str | None = None, file: str | None = None, since: object = None, until: object = None, limit: int | None = 100) -> DataFrame:
    """H1: newest first, ties by hash; author and keyword are parts of the text in any case.

    since and until are times or texts of the forms of `parse_date`; other texts are ignored. Commits
    without a time are kept.
    """
    x = commits
    if author:
        x = x.filter(F.contains(F.lower("author"), F.lit(author.lower())) | F.contains(F.lower("email"), F.lit(author.lower())))
    if keyword:
        x = x.filter(F.contains(F.lower("message"), F.lit(keyword.lower())))
    if since is not None:
        x = x.filter(F.coalesce(F.col("commit_ts") >= _time(since), F.lit(True)))
    if until is not None:
        x = x.filter(F.coalesce(F.col("commit_ts") <= _time(until), F.lit(True)))
    if file:
        x = x.join(changes.filter((F.col("path") == file) | (F.col("old_path") == file)).select("hash").distinct(), "hash", "left_semi")
    x = commit_row(x).orderBy(F.desc("commit_ts"), "hash")
    return x.limit(limit) if limit else x


def detail(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """H3, A3: each commit with files, additions and deletions; a hash prefix may be filtered afterwards."""
    s = changes.groupBy("hash").agg(F.count("*").alias("files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
    return commit_row(commits).join(s, "hash", "left").fillna(0, ["files", "additions", "deletions"])


def diff(changes: DataFrame, hash_: str) -> DataFrame:
    """H4, O3: the changes of one commit, given by its hash or the begin of it, by path."""
    return changes.filter(F.col("hash").startswith(hash_.lower())).orderBy("path")


def count_lines(c: Column) -> Column:
    """H4: lines of a text; one that lacks its line end counts."""
    return F.when(c == "", 0).otherwise(F.size(F.split(c, "\n")) - F.when(c.endswith("\n"), 1).otherwise(0))


def file_history(commits: DataFrame, changes: DataFrame, files: DataFrame, limit: int = 50) -> DataFrame:
    """(file, rank, hash, ...) the newest changes of each of files(file), under its path or old path."""
    from pyspark.sql import Window

    c = changes.withColumn("old_path", F.coalesce("old_path", F.lit(""))) if "old_path" in changes.columns else changes.withColumn("old_path", F.lit(""))
    both = c.withColumn("file", F.explode(F.array_distinct(F.array("path", "old_path")))).filter("file <> ''").join(files.select("file").distinct(), "file", "left_semi")
    x = both.join(commit_row(commits), "hash")
    w = Window.partitionBy("file").orderBy(F.desc("commit_ts"), "hash", "path")
    return x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def entity_history(nodes: DataFrame, commits: DataFrame, changes: DataFrame, limit: int = 10) -> DataFrame:
    """H7: the history of each node's file; line ranges play no part."""
    n = nodes.select("id", F.col("file_path").alias("file"))
    return n.join(file_history(commits, changes, n.select("file"), limit), "file")
