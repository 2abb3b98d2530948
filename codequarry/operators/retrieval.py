"""Vector and lexical retrieval, fusion and budgeted context assembly."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from codequarry.functions.text import contains_any, tokenize
from codequarry.operators import summary
from codequarry.session import checkpoint

#: Bytes of query vectors that are broadcast at once; more queries are worked off in blocks.
QUERY_BLOCK_BYTES = 32 << 20
K1, B = 1.5, 0.75
#: Begin and end of the context's title.
TITLE, TITLE_END = "# 代码上下文 (查询: ", ")\n\n"
#: Words of a query that prefer functions and methods, or classes.
FUNCTION_WORDS = ["函数", "function", "func", "方法", "method"]
CLASS_WORDS = ["类", "class", "struct", "结构"]


_BLANKS = re.compile(r"[ \t\n\v\f\r]+")


class Embedder(Protocol):
    """Plug-in: texts to vectors of one length."""

    def __call__(self, texts: Sequence[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Feature hashing of words into signed buckets, unit length; deterministic and offline.

    Words are cut at white space of ASCII. The first 15 digits of a word's MD5 sum, as a number,
    give the bucket, whether the 16th is below 8 the sign; so SQL can make the same vectors.
    """

    def __init__(self, dim: int = 384):
        self.dim = dim

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dim)
            for w, n in Counter(_BLANKS.split((t or "").lower())).items():
                if w:
                    h = hashlib.md5(w.encode(), usedforsecurity=False).hexdigest()
                    v[int(h[:15], 16) % self.dim] += n if h[15] < "8" else -n
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


def embed(texts: DataFrame, column: str, embedder: Embedder, batch: int = 32, tries: int = 3) -> DataFrame:
    """With `embedding`; batches of 32, three tries each, then one by one; a text that
    still fails has a null embedding."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(s: pd.Series) -> pd.Series:
        out: list = []
        for i in range(0, len(s), batch):
            part = s.iloc[i : i + batch].fillna("").tolist()
            for n in range(tries):
                try:
                    out += embedder(part)
                    break
                except Exception:  # noqa: BLE001 - any failure of a plug-in counts
                    if n == tries - 1:
                        for t in part:
                            try:
                                out += embedder([t])
                            except Exception:  # noqa: BLE001
                                out.append(None)
        return pd.Series(out)

    return texts.withColumn("embedding", run(column))


def mean_pool(vectors: DataFrame, keys: Sequence[str], column: str = "embedding") -> DataFrame:
    """(keys, embedding): element-wise mean of the vectors of a group, by position."""
    x = vectors.select(*keys, F.posexplode(column).alias("_p", "_v")).groupBy(*keys, "_p").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    return x.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_m"))), lambda e: e["_m"]).alias("embedding"))


def _best(s: np.ndarray, k: int, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k greatest of each row of scores, ties by id."""
    n = s.shape[1]
    if n <= k:
        return np.repeat(np.arange(len(s)), n), np.tile(np.arange(n), len(s))
    least = np.partition(s, n - k, axis=1)[:, n - k]
    row, col = np.nonzero(s >= least[:, None])
    many = np.flatnonzero(np.bincount(row, minlength=len(s)) > k)
    if len(many):
        # Ties at the last place, as exact copies make them, are cut by id.
        place = np.empty(n, dtype=np.int64)
        place[np.asarray(pc.sort_indices(ids))] = np.arange(n)
        keep = ~np.isin(row, many)
        rows, cols = [row[keep]], [col[keep]]
        for i in many:
            c = col[row == i]
            c = c[np.lexsort((place[c], -s[i, c]))][:k]
            rows.append(np.full(len(c), i))
            cols.append(c)
        row, col = np.concatenate(rows), np.concatenate(cols)
    return row, col


def topk(vectors: DataFrame, queries: DataFrame, k: int = 10, min_score: float | None = None, filters: dict[str, object] | None = None, by: str | None = None) -> DataFrame:
    """V2, V3: (query_id, id, score, rank [, by]): exact cosine top k of vectors(id, embedding) for each
    of queries(query_id, embedding), ties by id. Equality filters apply before the top k. With `by`
    the k best of each value of that column are kept.

    The queries are broadcast in blocks of bounded size, one at a time where there are several; each task keeps its k best of every
    query, so only those are shuffled. Vectors that are null, of another length or zero never match.
    """
    for c, v in (filters or {}).items():
        vectors = vectors.filter(F.col(c) == F.lit(v))
    spark = vectors.sparkSession
    size = queries.agg(F.coalesce(F.sum(F.size("embedding") * 8), F.lit(0))).first()[0]
    blocks = max(1, -(-size // QUERY_BLOCK_BYTES))
    id_type, q_type = dict(vectors.dtypes)["id"], dict(queries.dtypes)["query_id"]
    q_arrow = to_arrow_type(queries.schema["query_id"].dataType)
    out = None
    for b in range(blocks):
        part = queries.filter("embedding is not null").select("query_id", "embedding")
        part = part if blocks == 1 else part.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        rows = list(part.toLocalIterator())
        shared = spark.sparkContext.broadcast(([r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64)))

        def search(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            if not len(names):
                return
            qn = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
            for batch in it:
                ok = pc.fill_null(pc.equal(pc.list_value_length(batch.column("embedding")), q.shape[1]), False)
                part = batch.filter(ok)
                if not part.num_rows:
                    continue
                x = np.asarray(pc.list_flatten(part.column("embedding")), dtype=np.float64).reshape(-1, q.shape[1])
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                s = qn @ np.divide(x, norm, out=np.zeros_like(x), where=norm > 0).T
                ranks = np.round(s, 9)
                group = np.asarray(part.column("by").dictionary_encode().indices.fill_null(-1)) if by else np.zeros(len(x), dtype=np.int64)
                qi, vi = [], []
                for g in np.unique(group):
                    a, b = _best(ranks[:, group == g], k, part.column("id").filter(pa.array(group == g)))
                    qi.append(a)
                    vi.append(np.flatnonzero(group == g)[b])
                qi, vi = np.concatenate(qi), np.concatenate(vi)
                if min_score is not None:
                    keep = s[qi, vi] >= min_score
                    qi, vi = qi[keep], vi[keep]
                cols = [pa.array(names, q_arrow).take(pa.array(qi)), part.column("id").take(pa.array(vi)), pa.array(s[qi, vi], pa.float64())]
                if by:
                    cols.append(part.column("by").take(pa.array(vi)))
                if len(qi):
                    yield pa.RecordBatch.from_arrays(cols, names=["query_id", "id", "score", "by"][: len(cols)])

        found = vectors.select("id", "embedding", *([F.col(by).cast("string").alias("by")] if by else [])).mapInArrow(
            search, f"query_id {q_type}, id {id_type}, score double" + (", by string" if by else "")
        )
        w = Window.partitionBy("query_id", *(["by"] if by else [])).orderBy(F.round("score", 9).desc(), "id")
        found = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        if blocks > 1:
            # A block's queries leave the driver and the executors before the next are drawn.
            found = checkpoint(found)
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("by", by) if by else out


def bm25(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """K1: candidates(query_id, id, content, signature, score) with `bm25` and `final`.

    Statistics are those of the candidates of each query; document frequency counts substring
    hits, term frequency exact tokens, repeated query terms count again; each term adds 2.0
    where the id has it and 1.5 where the signature does. A query without terms leaves the score.
    """
    terms = queries.select("query_id", F.explode(tokenize(F.col("text"))).alias("term"))
    c = candidates.withColumn("_tokens", tokenize(F.coalesce("content", F.lit("")))).withColumn("_low", F.lower(F.coalesce("content", F.lit(""))))
    per = Window.partitionBy("query_id")
    c = c.withColumn("_dl", F.size("_tokens")).withColumn("_n", F.count("*").over(per)).withColumn("_avg", F.avg("_dl").over(per))
    hits = terms.groupBy("query_id", "term").agg(F.count("*").alias("times")).join(c, "query_id")
    has = F.contains(F.col("_low"), F.col("term"))
    hits = hits.withColumn("_df", F.sum(has.cast("int")).over(Window.partitionBy("query_id", "term")))
    tf = F.size(F.filter("_tokens", lambda t: t == F.col("term")))
    idf = F.ln((F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5) + 1)
    part = F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_dl") / F.col("_avg")))).otherwise(0.0)
    part = part + F.when(F.contains(F.lower("id"), F.col("term")), 2.0).otherwise(0.0) + F.when(F.contains(F.lower(F.coalesce("signature", F.lit(""))), F.col("term")), 1.5).otherwise(0.0)
    scored = hits.groupBy("query_id", "id").agg(F.sum(F.col("times") * part).alias("bm25"))
    x = candidates.join(scored, ["query_id", "id"], "left")
    return x.withColumn("final", F.when(F.col("bm25").isNull(), F.col("score")).otherwise(0.6 * F.col("score") + 0.4 * F.least(F.col("bm25") / 10, F.lit(1.0))))


def code_boost(reranked: DataFrame, queries: DataFrame, doc_column: str | None = None) -> DataFrame:
    """K3: adds 0.05 for wanted types and 0.02 for each query term in the documentation to `final`."""
    x = reranked.join(queries.select("query_id", F.lower("text").alias("_q"), tokenize(F.col("text")).alias("_terms")), "query_id", "left")
    up = F.when(contains_any(F.col("_q"), FUNCTION_WORDS) & F.col("type").isin("function", "method"), 0.05).otherwise(0.0)
    up = up + F.when(contains_any(F.col("_q"), CLASS_WORDS) & (F.col("type") == "class"), 0.05).otherwise(0.0)
    if doc_column:
        low = F.lower(F.coalesce(doc_column, F.lit("")))
        up = up + F.lit(0.02) * F.size(F.filter("_terms", lambda t: F.contains(low, t)))
    return x.withColumn("final", F.col("final") + up).drop("_q", "_terms")


def fuse(results: DataFrame, k: int = 60) -> DataFrame:
    """K2: (query_id, id, rrf) of results(query_id, set_no, id, rank) with ranks from 1."""
    return results.groupBy("query_id", "id").agg(F.sum(1.0 / (F.col("rank") - 1 + k)).alias("rrf"))


def semantic_search(vectors: DataFrame, queries: DataFrame, k: int = 10, min_score: float = 0.5) -> DataFrame:
    """R1."""
    return topk(vectors, queries, k, min_score)


def hybrid_search(vectors: DataFrame, queries: DataFrame, k: int = 10, min_score: float = 0.3, over: int = 2) -> DataFrame:
    """R2: the k best by code-aware rerank of the over * k nearest; queries(query_id, embedding, text)."""
    near = topk(vectors, queries, over * k, min_score).drop("rank").join(vectors.drop("embedding"), "id")
    x = code_boost(bm25(near, queries), queries)
    w = Window.partitionBy("query_id").orderBy(F.round("final", 9).desc(), "id")
    return x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def context_search(vectors: DataFrame, queries: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 10, min_score: float = 0.3) -> DataFrame:
    """Hybrid hits with lines and signature of their node and the names around them."""
    # At most k rows for each query, used several times.
    hits = checkpoint(hybrid_search(vectors, queries, k, min_score).select("query_id", "id", "final", "rank", "type"))
    n = nodes.select("id", "name", F.col("signature").alias("node_signature"), F.col("start_line").alias("from_line"), F.col("end_line").alias("to_line"))
    names = summary.caller_callee_names(nodes, edges, hits)
    return hits.join(n, "id", "left").join(names, "id", "left").fillna("", ["callees", "callers"])


def rag_sources(vectors: DataFrame, queries: DataFrame, nodes: DataFrame, k: int = 10, min_score: float = 0.3, rerank: bool = True, expand_files: bool = False) -> DataFrame:
    """(query_id, id, score, reason, name, type, file_path, start_line, end_line, content): the k best,
    with expand_files also the other nodes of their files at score 0.1."""
    if rerank:
        hits = hybrid_search(vectors, queries, k, min_score, over=3).select("query_id", "id", F.col("final").alias("score"), "content")
    else:
        hits = topk(vectors, queries, k, min_score).drop("rank").join(vectors.select("id", "content"), "id").select("query_id", "id", "score", "content")
    meta = nodes.select("id", "name", "type", "file_path", "start_line", "end_line", "signature")
    x = hits.join(meta, "id", "left").withColumn("reason", F.lit("semantic"))
    if expand_files:
        files = x.select("query_id", "file_path").filter("file_path is not null").distinct()
        more = files.join(meta, "file_path").join(x.select("query_id", "id"), ["query_id", "id"], "left_anti")
        more = more.select("query_id", "id", F.lit(0.1).alias("score"), F.lit(None).cast("string").alias("content"), "name", "type", "file_path", "start_line", "end_line", "signature", F.lit("same file").alias("reason"))
        x = x.unionByName(more)
    return x


def rag_budget(sources: DataFrame, queries: DataFrame, budget: int = 16000, keys: Sequence[str] = ("query_id",), lines: bool = True) -> DataFrame:
    """Sources with (ord, entry, used): entries by score whose running bytes fit the budget.

    The ordinal is given before entries without content are dropped; the first entry that
    does not fit ends the context, which the running sum expresses for it only grows.
    """
    w = Window.partitionBy(*keys).orderBy(F.round("score", 9).desc(), "id")
    x = sources.withColumn("ord", F.row_number().over(w))
    body = F.when(F.coalesce("content", F.lit("")) != "", F.col("content")).otherwise(F.coalesce("signature", F.lit("")))
    x = x.withColumn("_body", body).filter("_body <> ''")
    no = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string") if lines else F.lit("0")
    entry = F.concat(
        F.lit("## "), F.col("ord").cast("string"), F.lit(". ["), F.coalesce("type", F.lit("")), F.lit("] "), F.coalesce("name", F.lit("")), F.lit("\nFile: "), F.coalesce("file_path", F.lit("")),
        F.lit(" (L"), no("start_line"), F.lit("-L"), no("end_line"), F.lit(") | Score: "), F.format_string("%.3f", F.round("score", 3)), F.lit(" | "), F.col("reason"), F.lit("\n\n```\n"), F.col("_body"), F.lit("\n```\n\n"),
    )
    head = F.octet_length(header(F.col("_q")))
    x = x.join(queries.select("query_id", F.coalesce("text", F.lit("")).alias("_q")), "query_id").withColumn("entry", entry)
    run = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("used", F.sum(F.octet_length("entry")).over(run) + head).filter(F.col("used") <= budget).drop("_body", "_q")


def header(text: Column) -> Column:
    return F.concat(F.lit(TITLE), text, F.lit(TITLE_END))


def rag_text(sources: DataFrame, queries: DataFrame, nodes: DataFrame | None = None, edges: DataFrame | None = None, budget: int = 16000) -> DataFrame:
    """(query_id, text): the assembled context, bounded by the budget; with nodes and edges the
    call lines of its sources follow where they fit."""
    return assemble(rag_budget(sources, queries, budget), queries, nodes, edges, budget)


def assemble(kept: DataFrame, queries: DataFrame, nodes: DataFrame | None, edges: DataFrame | None, budget: int) -> DataFrame:
    """(query_id, text) of the entries that `rag_budget` kept."""
    if nodes is not None and edges is not None:
        kept = checkpoint(kept)
    body = kept.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "entry"))), lambda r: r.entry), "").alias("body"), F.max("used").alias("used"))
    x = queries.select("query_id", "text").join(body, "query_id", "left")
    text = F.concat(header(F.coalesce("text", F.lit(""))), F.coalesce("body", F.lit("")))
    if nodes is None or edges is None:
        return x.select("query_id", text.alias("text"))
    names = summary.caller_callee_names(nodes, edges, kept).join(nodes.select("id", "name"), "id")
    ids = kept.select("query_id", "ord", "id").join(names, "id")
    both = ids.select("query_id", F.inline(F.array(
        F.struct("ord", F.lit(0).alias("side"), F.when(F.col("callees") != "", F.concat("name", F.lit(f" {summary.CALLS_MARK} "), "callees")).alias("line")),
        F.struct("ord", F.lit(1).alias("side"), F.when(F.col("callers") != "", F.concat("name", F.lit(f" {summary.CALLED_MARK} "), "callers")).alias("line")),
    ))).filter("line is not null").groupBy("query_id", "line").agg(F.min(F.struct("ord", "side")).alias("p"))
    section = both.groupBy("query_id").agg(F.concat(F.lit("\n" + summary.SECTION_TITLE), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "line"))), lambda r: r.line), "\n"), F.lit("\n")).alias("section"))
    x = x.join(section, "query_id", "left")
    fits = F.coalesce("used", F.lit(0)) + F.octet_length("section") <= budget + 1
    return x.select("query_id", F.concat(text, F.when(F.col("section").isNotNull() & fits, F.col("section")).otherwise("")).alias("text"))


def of_repos(df: DataFrame, repo: str, repo_keys: Sequence[str] | None) -> DataFrame:
    """The rows of the chosen repositories; none or an empty list means all."""
    return df.filter(F.col(repo).isin(*repo_keys)) if repo_keys else df


def multi_search(vectors: DataFrame, queries: DataFrame, repo: str = "repo_id", k: int = 5, min_score: float = 0.5, repo_keys: Sequence[str] | None = None) -> DataFrame:
    """The k best of each of the chosen repositories for each query, with the repository's best score to order by."""
    vectors = of_repos(vectors, repo, repo_keys)
    x = topk(vectors, queries, k, min_score, by=repo)
    return x.withColumn("repo_best", F.max("score").over(Window.partitionBy("query_id", repo)))


def multi_rag(vectors: DataFrame, queries: DataFrame, nodes: DataFrame, repo: str = "repo_id", k: int = 5, min_score: float = 0.3, budget: int = 16000,
              repo_keys: Sequence[str] | None = None, rerank: bool = False, expand_files: bool = False) -> DataFrame:
    """The k best of each of the chosen repositories, one global budget; entries name their repository.

    With rerank the k best of the 3 * k nearest of each repository by the code-aware rerank, whose
    statistics are those of all candidates of a query; with expand_files also the other nodes of
    their files at score 0.1.
    """
    vectors = of_repos(vectors, repo, repo_keys)
    hits = topk(vectors, queries, 3 * k if rerank else k, min_score, by=repo).drop("rank").join(vectors.drop("embedding", repo), "id")
    if rerank:
        w = Window.partitionBy("query_id", repo).orderBy(F.round("final", 9).desc(), "id")
        hits = code_boost(bm25(hits, queries), queries).withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k).withColumn("score", F.col("final"))
    hits = hits.select("query_id", "id", "score", "content", repo)
    meta = nodes.select("id", "name", "type", "file_path", "start_line", "end_line", "signature")
    x = hits.join(meta, "id", "left").withColumn("reason", F.concat(F.lit("semantic @ "), F.col(repo)))
    if expand_files:
        files = x.select("query_id", repo, "file_path").filter("file_path is not null").distinct()
        more = files.join(meta, "file_path").join(x.select("query_id", "id"), ["query_id", "id"], "left_anti")
        more = more.withColumns({"score": F.lit(0.1), "content": F.lit(None).cast("string"), "reason": F.concat(F.lit("same file @ "), F.col(repo))})
        x = x.unionByName(more.groupBy(*[c for c in more.columns if c not in (repo, "reason")]).agg(F.min(repo).alias(repo), F.min("reason").alias("reason")).select(*x.columns))
    return rag_budget(x, queries, budget)


def multi_rag_text(vectors: DataFrame, queries: DataFrame, nodes: DataFrame, edges: DataFrame | None = None, repo: str = "repo_id", **options: object) -> DataFrame:
    """(query_id, text) of `multi_rag`; with edges the call lines of the sources follow where they fit."""
    kept = multi_rag(vectors, queries, nodes, repo, **options)
    return assemble(kept, queries, nodes if edges is not None else None, edges, options.get("budget", 16000))


def repos_by_age(repos: DataFrame) -> DataFrame:
    """Repositories, the one indexed last first."""
    return repos.orderBy(F.col("indexed_at").desc_nulls_last(), "repo_id")


def latest_repo(repos: DataFrame) -> DataFrame:
    """(repo_id): the one indexed last, ties by the least id."""
    return repos.filter("indexed_at is not null").groupBy("indexed_at").agg(F.min("repo_id").alias("repo_id")).agg(F.max_by("repo_id", "indexed_at").alias("repo_id"))


Reranker = Callable[[DataFrame, DataFrame], DataFrame]
