"""Facade: one method for each entry point, returning DataFrames."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators import graph, history, indexing, ingest, lookups, raw, retrieval, summary
from codequarry.schema import empty
from codequarry.sources import git

_FILE_LIKE = re.compile(r"/|\.(?:py|go|java|js|ts|c|cpp|cc|h|hpp)$")
_HASH_LIKE = re.compile(r"^[0-9a-fA-F]{7,40}$")


def _scope(scope: str) -> list[str] | None:
    """The repositories of a scope: a list with commas; None for all."""
    return None if scope == "all" else [x.strip() for x in scope.split(",") if x.strip()]


@dataclass(frozen=True)
class Engine:
    """The tables of one index; `repo_key` restricts those that have such a column."""

    spark: SparkSession
    nodes: DataFrame
    edges: DataFrame
    vectors: DataFrame | None = None
    commit_rows: DataFrame | None = None
    changes: DataFrame | None = None
    files: DataFrame | None = None
    repo_rows: DataFrame | None = None
    endpoints: DataFrame | None = None
    embedder: retrieval.Embedder = retrieval.HashEmbedder()
    blame_rows: DataFrame | None = None

    def with_repo(self, key: str) -> Engine:
        one = lambda df: df.filter(F.col("repo_key") == key) if df is not None and "repo_key" in df.columns else df
        return replace(self, nodes=one(self.nodes), edges=one(self.edges), vectors=one(self.vectors), commit_rows=one(self.commit_rows), changes=one(self.changes), files=one(self.files))

    @classmethod
    def open(cls, spark: SparkSession, target: str, **more: object) -> Engine:
        """The newest version of an index; `more` gives the other tables."""
        t = lambda name: indexing.table(spark, target, name)
        return cls(spark, t("nodes"), t("edges"), t("vectors"), endpoints=t("api_endpoints"), **more)

    @classmethod
    def index(cls, spark: SparkSession, path: str, target: str, embedder: retrieval.Embedder | None = None, **more: object) -> Engine:
        """Index the source files under path, or bring their index under target up to date, and open it.

        A path within a git repository also brings its history, blame and branch.
        """
        embedder = embedder or cls.embedder
        indexing.index(spark, path, target, embedder)
        files = ingest.scan_files(spark, path).select(F.col("path").alias("file_path"), "content")
        if git.is_repository(path):
            more = {"commit_rows": git.commits(spark, path), "changes": git.file_changes(spark, path), "blame_rows": git.blame(spark, path, git.tracked(spark, path)), **more}
        return cls.open(spark, target, embedder=embedder, files=files, **more)

    def _start(self, id_: str) -> DataFrame:
        return self.spark.createDataFrame([(id_,)], "start string")

    def _query(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(1, self.embedder([text])[0], text)], "query_id int, embedding array<float>, text string")

    # Points and lists
    def entity(self, id_: str) -> DataFrame:
        return lookups.by_id(self.nodes, id_)

    def graph_data(self) -> tuple[DataFrame, DataFrame]:
        return self.nodes, self.edges

    def stats(self) -> DataFrame:
        return graph.stats(self.nodes, self.edges, self.vectors if self.vectors is not None else empty(self.spark, "vectors"))

    def repos(self) -> DataFrame:
        return retrieval.repos_by_age(self.repo_rows)

    def api_endpoints(self) -> DataFrame:
        return self.endpoints if self.endpoints is not None else empty(self.spark, "api_endpoints")

    # Graph
    def callers(self, id_: str, depth: int = 1) -> DataFrame:
        return graph.callers(self.nodes, self.edges, self._start(id_), depth)

    def callees(self, id_: str, depth: int = 1) -> DataFrame:
        return graph.callees(self.nodes, self.edges, self._start(id_), depth)

    def call_map(self, id_: str, depth: int = 1) -> DataFrame:
        return graph.call_map(self.nodes, self.edges, self._start(id_), depth)

    def call_chain(self, id_: str, depth: int = 1) -> DataFrame:
        f = summary.call_chain if depth <= 1 else lambda n, e, s: summary.call_tree(n, e, s, depth)
        return f(self.nodes, self.edges, self._start(id_))

    def graph_summary(self, file: str | None = None) -> DataFrame:
        return summary.graph_summary(self.nodes, self.edges, file)

    def function_graph(self, file: str | None = None, type: str | None = None) -> tuple[DataFrame, DataFrame]:  # noqa: A002
        return graph.function_graph(self.nodes, self.edges, file, type)

    def subgraph(self, id_: str, depth: int = 2) -> tuple[DataFrame, DataFrame]:
        return graph.subgraph(self.nodes, self.edges, self._start(id_), depth)

    def shortest_path(self, source: str, target: str) -> DataFrame:
        return graph.shortest_paths(self.edges, self._start(source), self.spark.createDataFrame([(target,)], "target string"))

    def cycles(self, max_len: int | None = None) -> DataFrame:
        return graph.cycles(self.edges, max_len) if max_len else graph.cycles_dfs(self.edges)

    def topo_sort(self) -> DataFrame:
        return graph.topo_layers(self.edges).orderBy("layer", "node")

    # Retrieval
    def semantic_search(self, query: str, top_k: int = 10, min_score: float = 0.5, filters: dict | None = None) -> DataFrame:
        return retrieval.topk(self.vectors, self._query(query), top_k, min_score, filters)

    def hybrid_search(self, query: str, top_k: int = 10) -> DataFrame:
        return retrieval.hybrid_search(self.vectors, self._query(query), top_k)

    def context_search(self, query: str, top_k: int = 10) -> DataFrame:
        return retrieval.context_search(self.vectors, self._query(query), self.nodes, self.edges, top_k)

    def multi_search(self, query: str, top_k: int = 5, min_score: float = 0.5, repo_keys: Sequence[str] | None = None) -> DataFrame:
        return retrieval.multi_search(self.vectors, self._query(query), "repo_key", top_k, min_score, repo_keys)

    def rag(self, query: str, top_k: int = 10, min_score: float = 0.3, rerank: bool = False, expand_files: bool = False, call_graph: bool = False, max_context_length: int = 16000) -> DataFrame:
        q = self._query(query)
        sources = retrieval.rag_sources(self.vectors, q, self.nodes, top_k, min_score, rerank, expand_files)
        return retrieval.rag_text(sources, q, *((self.nodes, self.edges) if call_graph else (None, None)), max_context_length)

    def multi_rag(self, query: str, top_k: int = 5, min_score: float = 0.3, max_context_length: int = 16000, repo_keys: Sequence[str] | None = None, rerank: bool = False, expand_files: bool = False) -> DataFrame:
        return retrieval.multi_rag(self.vectors, self._query(query), self.nodes, "repo_key", top_k, min_score, max_context_length, repo_keys, rerank, expand_files)

    def multi_rag_text(self, query: str, call_graph: bool = False, max_context_length: int = 16000, **options: object) -> DataFrame:
        return retrieval.multi_rag_text(self.vectors, self._query(query), self.nodes, self.edges if call_graph else None, "repo_key", budget=max_context_length, **options)

    # History
    def commits(self, limit: int = 20, author: str | None = None, keyword: str | None = None, file: str | None = None, since: object = None, until: object = None) -> DataFrame:
        return history.log(self.commit_rows, self.changes, author, keyword, file, since, until, limit)

    def commit_detail(self, hash_: str) -> DataFrame:
        return history.detail(self.commit_rows.filter(F.col("hash").startswith(hash_.lower())), self.changes)

    def diff(self, hash_: str) -> DataFrame:
        return history.diff(self.changes, hash_)

    def file_history(self, path: str, limit: int = 20) -> DataFrame:
        return history.file_history(self.commit_rows, self.changes, self.spark.createDataFrame([(path,)], "file string"), limit)

    def entity_history(self, id_: str, limit: int = 10) -> DataFrame:
        return history.entity_history(self.entity(id_), self.commit_rows, self.changes, limit)

    def blame(self, path: str) -> DataFrame:
        rows = self.blame_rows if self.blame_rows is not None else empty(self.spark, "blame")
        return rows.filter(F.col("path") == path).orderBy("line_number")

    # Raw source
    def grep(self, pattern: str, file_pattern: str | None = None, max_results: int = 50) -> DataFrame:
        return raw.grep(self.files, pattern, file_pattern, max_results)

    def read_lines(self, path: str, start: int = 1, end: int = 0) -> DataFrame:
        return raw.read_lines(self.files.filter(F.col("file_path") == path), start, end)

    def file_tree(self) -> DataFrame:
        return raw.tree(self.files)

    # Tools: the form of the query decides on the operator
    def tool_search(self, query: str, scope: str = "current") -> DataFrame:
        if not self.entity(query).isEmpty():
            return self.call_chain(query, 2)
        return self.multi_search(query, repo_keys=_scope(scope)) if scope != "current" else self.semantic_search(query, 5)

    def tool_callgraph(self, query: str, depth: int = 2) -> DataFrame:
        if not self.entity(query).isEmpty():
            return self.call_chain(query, depth)
        return self.graph_summary(query if _FILE_LIKE.search(query or "") else None)

    def tool_history(self, query: str) -> DataFrame:
        if ":" in query and _FILE_LIKE.search(query.rsplit(":", 1)[0]):
            path, _, spec = query.rpartition(":")
            a, _, b = spec.partition("-")
            rows = self.blame(path)
            return rows.filter(F.col("line_number").between(int(a), int(b or a))) if a.isdigit() else rows
        if _HASH_LIKE.match(query):
            return self.commit_detail(query)
        if "/" in query or "." in query:
            return self.file_history(query, 10)
        return self.commits(10, keyword=query)

    def tool_read(self, path: str | None = None, pattern: str | None = None) -> DataFrame:
        if pattern:
            return raw.grep(self.files, pattern, None, 30, 30)
        m = re.match(r"^(.*):(\d+)(?:-(\d+))?$", path or "")
        name, a, b = (m[1], int(m[2]), int(m[3] or m[2])) if m else (path, 1, 0)
        return raw.numbered(self.files.filter(F.col("file_path") == name), a, b)

    def tool_context(self, query: str, scope: str = "current") -> DataFrame:
        return self.multi_rag_text(query, repo_keys=_scope(scope), rerank=True) if scope != "current" else self.rag(query, 5, rerank=True)

    def tool_repo(self) -> DataFrame:
        return self.repos()

    def call(self, tool: str, **args: object) -> DataFrame:
        """Tools by name: search, callgraph, read_code, history, context, switch_repo."""
        name = {"read_code": "read", "switch_repo": "repo"}.get(tool, tool)
        f = getattr(self, f"tool_{name}", None)
        if f is None:
            raise ValueError(f"unknown tool {tool!r}")
        return f(**args)
