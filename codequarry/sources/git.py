"""Git as a source: a Python data source over `git log`, blame, and driver-side helpers."""

from __future__ import annotations

import datetime as dt
import os
import re
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codequarry.schema import SCHEMAS


def _git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, "-c", "safe.directory=*", "-c", "core.quotepath=off", *args], check=True, capture_output=True, timeout=600).stdout.decode("utf-8", "replace")


def clone(url: str, target: str, branch: str | None = None, depth: int = 1) -> str:
    """A shallow clone of one branch; returns the hash of its head."""
    args = ["git", "clone", "--single-branch", *(["--depth", str(depth)] if depth > 0 else []), *(["--branch", branch] if branch else []), "--", url, target]
    subprocess.run(args, check=True, capture_output=True, timeout=3600)
    return head(target)


def checkout(repo: str, branch: str) -> str:
    """S7."""
    _git(repo, "checkout", "--quiet", branch)
    return head(repo)


def head(repo: str) -> str:
    return _git(repo, "rev-parse", "HEAD").strip()


def is_repository(path: str) -> bool:
    """Whether the folder is the top of a repository with a commit."""
    try:
        return os.path.samefile(_git(path, "rev-parse", "--show-toplevel").strip(), path) and bool(head(path))
    except (subprocess.CalledProcessError, OSError):
        return False


def tracked(spark: SparkSession, repo: str) -> DataFrame:
    """(path): files in the index, by name; a walk of the folder where there is no repository."""
    try:
        names = [x for x in _git(repo, "ls-files", "-z").split("\0") if x]
    except (subprocess.CalledProcessError, FileNotFoundError):
        names = [os.path.relpath(os.path.join(d, f), repo) for d, _, fs in os.walk(repo) for f in fs if "/." not in d]
    return spark.createDataFrame([(x,) for x in sorted(set(names))], "path string")


class _Revisions(InputPartition):
    def __init__(self, hashes: list[str]):
        self.hashes = hashes


class _Reader(DataSourceReader):
    def __init__(self, repo: str, table: str, slices: int):
        self.repo, self.table, self.slices = repo, table, slices

    def partitions(self) -> list[InputPartition]:
        """Commits are dealt out, so their diffs are read by many tasks."""
        hashes = _git(self.repo, "rev-list", "HEAD").split()
        n = max(1, min(self.slices, len(hashes)))
        return [_Revisions(hashes[i::n]) for i in range(n)]

    def read(self, partition: _Revisions) -> Iterator[tuple]:
        """One git process for each slice, which is handed its commits on its input."""
        if not partition.hashes:
            return
        if self.table == "commits":
            fields = self._log(partition, "--no-patch", "--format=%H%x00%an%x00%ae%x00%ct%x00%B")
            for full, author, email, stamp, message in zip(*[iter(fields)] * 5, strict=False):
                full = full.strip()
                yield full, full[:8], author, email, message.strip(), dt.datetime.fromtimestamp(int(stamp), dt.timezone.utc)
        else:
            fields = self._log(partition, "--diff-merges=first-parent", "--root", "-M", "--raw", "--numstat", "--no-abbrev", "--format=%x01%H%x01%P")
            yield from _change_rows(fields)

    def _log(self, partition: _Revisions, *args: str) -> list[str]:
        run = subprocess.run(
            ["git", "-C", self.repo, "-c", "safe.directory=*", "-c", "core.quotepath=off", "log", "--no-walk=unsorted", "--stdin", "-z", *args],
            check=True, capture_output=True, input="\n".join(partition.hashes).encode(), timeout=3600,
        )
        return run.stdout.decode("utf-8", "replace").split("\0")


#: Status letters.
_STATUS = {"A": "added", "D": "deleted", "R": "renamed"}


def _change_rows(fields: list[str]) -> Iterator[tuple]:
    """(hash, path, old_path, status, additions, deletions) from the fields of a log with raw and numeric changes.

    Files of a commit without parents count no lines, as its tree is compared with nothing.
    """
    commit, root = "", False
    order: list[tuple[str, str, str]] = []
    counts: dict[str, tuple[int, int]] = {}

    def rows() -> Iterator[tuple]:
        for p, old, status in sorted(order):
            yield commit, p, old, status, *((0, 0) if root else counts.get(p, (0, 0)))

    it = iter(fields)
    for x in it:
        x = x.lstrip("\n")
        if x.startswith("\x01"):
            yield from rows()
            order, counts = [], {}
            _, commit, parents = x.split("\x01")
            root = not parents.strip()
        elif x.startswith(":"):
            letter = x.rsplit(" ", 1)[1][0]
            old = next(it) if letter in "RC" else ""
            order.append((next(it), old, _STATUS.get(letter, "modified")))
        elif "\t" in x:
            a, d, p = x.split("\t", 2)
            if not p:
                next(it)
                p = next(it)
            counts[p] = (int(a) if a.isdigit() else 0, int(d) if d.isdigit() else 0)
    yield from rows()


class GitSource(DataSource):
    """spark.read.format("git").option("path", repo).option("table", "commits" or "file_changes")."""

    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "commits")]

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("table", "commits"), int(self.options.get("slices", "8")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitSource)


def commits(spark: SparkSession, repo: str) -> DataFrame:
    register(spark)
    return spark.read.format("git").option("path", repo).option("table", "commits").load()


def file_changes(spark: SparkSession, repo: str) -> DataFrame:
    register(spark)
    return spark.read.format("git").option("path", repo).option("table", "file_changes").load()


def blame(spark: SparkSession, repo: str, paths: DataFrame) -> DataFrame:
    """H6: blame rows of paths(path); a file that git does not know gives none."""

    def run(it):  # noqa: ANN001, ANN202
        import pandas as pd

        for pdf in it:
            rows = []
            for path in pdf["path"]:
                try:
                    out = _git(repo, "blame", "--line-porcelain", "HEAD", "--", path)
                except subprocess.CalledProcessError:
                    continue
                at: dict[str, str] = {}
                for line in out.split("\n"):
                    m = re.match(r"([0-9a-f]{40}) \d+ (\d+)", line)
                    if m:
                        at = {"hash": m[1][:8], "n": m[2]}
                    elif line.startswith("\t"):
                        rows.append((path, int(at["n"]), at["hash"], at.get("author", ""), at.get("author-mail", "").strip("<>"), pd.Timestamp(int(at.get("author-time", "0")), unit="s", tz="UTC"), line[1:]))
                    elif " " in line:
                        k, v = line.split(" ", 1)
                        at[k] = v
            yield pd.DataFrame(rows, columns=["path", "line_number", "hash", "author", "email", "commit_ts", "content"])

    return paths.select("path").mapInPandas(run, SCHEMAS["blame"])
