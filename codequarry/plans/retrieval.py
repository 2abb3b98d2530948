"""Queries of the retrieval operators: every vector whose number divides by 20 is a query against all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import text as tx
from codequarry.operators import lookups
from codequarry.operators import retrieval as r
from codequarry.plans.fixtures import view, with_views
from codequarry.session import read_table as T


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "vec_docs")


def _queries(s: SparkSession, d: str) -> DataFrame:
    """The query texts are the first three words of the document, after a word that prefers functions or classes."""
    v = _vectors(s, d).filter("vec_id % 20 = 0")
    words = F.array_join(F.slice(tx.tokenize(F.col("content")), 1, 3), " ")
    prefix = F.when(F.col("vec_id") % 40 == 0, "function ").otherwise("class ")
    return v.select(F.col("vec_id").alias("query_id"), "embedding", F.concat(prefix, words).alias("text"))


def _hits(s: SparkSession, d: str, k: int = 10, least: float | None = 0.1) -> DataFrame:
    return r.topk(_vectors(s, d), _queries(s, d), k, least)


def _cand(s: SparkSession, d: str) -> DataFrame:
    return _hits(s, d, 20, None).drop("rank").join(_vectors(s, d).drop("embedding"), "id")


def _bm25(s: SparkSession, d: str) -> DataFrame:
    x = r.bm25(_cand(s, d), _queries(s, d))
    return x.select("query_id", "id", F.round("bm25", 5).alias("bm25"), F.round("final", 5).alias("final"))


def _boost(s: SparkSession, d: str) -> DataFrame:
    x = r.code_boost(r.bm25(_cand(s, d), _queries(s, d)), _queries(s, d), "content")
    return x.select("query_id", "id", F.round("final", 5).alias("final"))


def _sets(s: SparkSession, d: str) -> DataFrame:
    """Two rankings of each query: by cosine, and by label distance of the ids' text."""
    a = _hits(s, d, 10, None).select("query_id", F.lit(1).alias("set_no"), "id", "rank")
    b = r.topk(_vectors(s, d), _queries(s, d), 10, None, {"type": "class"}).select("query_id", F.lit(2).alias("set_no"), "id", "rank")
    return a.unionByName(b)


def _kg(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return view(s, d, "kg_nodes"), view(s, d, "kg_edges")


def _sources(s: SparkSession, d: str, **kw: object) -> DataFrame:
    return r.rag_sources(_vectors(s, d), _queries(s, d), _kg(s, d)[0], 10, 0.1, **kw)


def _context(s: SparkSession, d: str) -> DataFrame:
    n, e = _kg(s, d)
    x = r.context_search(_vectors(s, d), _queries(s, d), n, e, 10, 0.1)
    return x.select("query_id", "id", "rank", F.round("final", 5).alias("final"), "node_signature", "from_line", "to_line", F.length("callees").alias("callees"), F.length("callers").alias("callers"))


def _budget(s: SparkSession, d: str) -> DataFrame:
    x = r.rag_budget(_sources(s, d, rerank=False), _queries(s, d), 3000)
    return x.select("query_id", "ord", "id", F.octet_length("entry").alias("bytes"), "used")


def _embedded(s: SparkSession, d: str) -> DataFrame:
    x = r.embed(_vectors(s, d).select("id", "content"), "content", r.HashEmbedder(64))
    return x.select("id", F.posexplode("embedding").alias("pos", "v")).filter("v <> 0").select("id", "pos", F.round(F.col("v").cast("double"), 5).alias("v"))


QUERIES = {
    "tokenize_counts": lambda s, d: T(s, d, "documents").select("doc_id", F.size(tx.tokenize(F.coalesce("text", F.lit("")))).alias("tokens")),
    "vector_count": lambda s, d: T(s, d, "embeddings").agg(F.count("*").alias("vectors")),
    "vector_topk": lambda s, d: _hits(s, d).select("query_id", "id", "rank", F.round("score", 6).alias("score")),
    "search_hits": lambda s, d: lookups.hit_rows(_hits(s, d, 5), _vectors(s, d)).withColumn("score", F.round("score", 6)),
    "vector_topk_filtered": lambda s, d: r.topk(_vectors(s, d), _queries(s, d), 5, None, {"type": "class"}).select("query_id", "id", "rank", F.round("score", 6).alias("score")),
    "mean_pool_by_label": lambda s, d: r.mean_pool(T(s, d, "embeddings"), ["label"]).select("label", F.posexplode("embedding").alias("pos", "v")).select("label", "pos", F.round("v", 6).alias("v")),
    "embed_hashing": _embedded,
    "bm25_rerank": _bm25, "code_boost": _boost,
    "rrf_fuse": lambda s, d: r.fuse(_sets(s, d)).select("query_id", "id", F.round("rrf", 8).alias("rrf")),
    "semantic_search": lambda s, d: r.semantic_search(_vectors(s, d), _queries(s, d), 10, 0.5).select("query_id", "id", "rank"),
    "hybrid_search": lambda s, d: r.hybrid_search(_vectors(s, d), _queries(s, d), 10, 0.1).select("query_id", "id", "rank", F.round("final", 5).alias("final")),
    "context_search": _context,
    "rag_sources": lambda s, d: _sources(s, d).select("query_id", "id", F.round("score", 5).alias("score"), "file_path", "start_line"),
    "rag_sources_expanded": lambda s, d: _sources(s, d, rerank=False, expand_files=True).groupBy("query_id", "reason").agg(F.count("*").alias("n")),
    "rag_budget": _budget,
    "rag_context_text": lambda s, d: r.rag_text(_sources(s, d, rerank=False), _queries(s, d), *_kg(s, d), 6000),
    "multi_repo_topk": lambda s, d: r.multi_search(_vectors(s, d), _queries(s, d), "repo_id", 3, 0.0).select("query_id", "repo_id", "id", "rank", F.round("score", 6).alias("score"), F.round("repo_best", 6).alias("repo_best")),
    "multi_repo_rag": lambda s, d: r.multi_rag(_vectors(s, d), _queries(s, d), _kg(s, d)[0], "repo_id", 3, 0.0, 4000).select("query_id", "ord", "id", "used"),
    "multi_repo_chosen": lambda s, d: r.multi_search(_vectors(s, d), _queries(s, d), "repo_id", 3, 0.0, ["readmes", "api_docs"]).select("query_id", "repo_id", "id", "rank", F.round("score", 6).alias("score")),
    "repo_list": lambda s, d: r.repos_by_age(T(s, d, "repos")).select("repo_id", tx.repo_key(tx.repo_id(F.col("repo_path")), F.col("branch")).alias("repo_key")),
    "repo_latest": lambda s, d: r.latest_repo(T(s, d, "repos")),
}
_TOK = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{Nd}}_]+'), lambda x: strlen(x) >= 2)"
_BASE = f"""WITH {with_views('vec_docs', 'kg_nodes')}, queries AS (SELECT vec_id AS query_id, embedding, concat(CASE WHEN vec_id % 40 = 0 THEN 'function ' ELSE 'class ' END, array_to_string({_TOK.format('content')}[1:3], ' ')) AS text FROM vec_docs WHERE vec_id % 20 = 0),
  pairs AS (SELECT q.query_id, v.*, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) AS score FROM queries q CROSS JOIN vec_docs v),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM pairs)"""
_BM = """, cand AS (SELECT * FROM {src}),
  terms AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({tok}) AS term FROM queries) z GROUP BY 1, 2),
  stat AS (SELECT query_id, count(*) AS n, avg(len({ctok})) AS avgdl FROM cand GROUP BY 1),
  hit AS (SELECT c.query_id, c.id, c.content, c.signature, t.term, t.times, s.n, s.avgdl, len({ctok2}) AS dl, len(list_filter({ctok2}, lambda x: x = t.term)) AS tf,
    sum(contains(lower(c.content), t.term)::int) OVER (PARTITION BY c.query_id, t.term) AS df FROM cand c JOIN terms t USING (query_id) JOIN stat s USING (query_id)),
  bm AS (SELECT query_id, id, sum(times * (CASE WHEN tf > 0 THEN ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END
    + CASE WHEN contains(lower(id), term) THEN 2.0 ELSE 0 END + CASE WHEN contains(lower(signature), term) THEN 1.5 ELSE 0 END)) AS bm25 FROM hit GROUP BY 1, 2),
  scored AS (SELECT c.*, b.bm25, CASE WHEN b.bm25 IS NULL THEN c.score ELSE 0.6 * c.score + 0.4 * least(b.bm25 / 10, 1.0) END AS plain FROM cand c LEFT JOIN bm b USING (query_id, id)),
  boosted AS (SELECT s.*, q.text, plain + CASE WHEN regexp_matches(lower(q.text), '函数|function|func|方法|method') AND type IN ('function', 'method') THEN 0.05 ELSE 0 END
    + CASE WHEN regexp_matches(lower(q.text), '类|class|struct|结构') AND type = 'class' THEN 0.05 ELSE 0 END AS final FROM scored s JOIN queries q USING (query_id))"""


def _bm(src: str) -> str:
    return _BASE + _BM.format(src=src, tok=_TOK.format("text"), ctok=_TOK.format("content"), ctok2=_TOK.format("c.content"))


def _hybrid(n: int) -> str:
    return _bm(f"ranked WHERE rank <= {n} AND score >= 0.1").replace(" AS final FROM scored", " AS final FROM scored") + ", hyb AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY round(final, 9) DESC, id) AS rank) FROM boosted)"


_ENTRY = """, src AS (SELECT r.query_id, r.id, r.score, r.content, n.name, n.type AS ntype, n.file_path, n.start_line, n.end_line, n.signature AS nsig, {reason} AS reason FROM {hits} r LEFT JOIN kg_nodes n ON n.id = r.id),
  o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS ord, CASE WHEN coalesce(content, '') <> '' THEN content ELSE coalesce(nsig, '') END AS body FROM src),
  e AS (SELECT *, concat('## ', ord, '. [', coalesce(ntype, ''), '] ', coalesce(name, ''), chr(10), 'File: ', coalesce(file_path, ''), ' (L', coalesce(start_line, 0), '-L', coalesce(end_line, 0), ') | Score: ',
    printf('%.3f', round(score, 3)), ' | ', reason, chr(10), chr(10), '```', chr(10), body, chr(10), '```', chr(10), chr(10)) AS entry FROM o WHERE body <> ''),
  u AS (SELECT *, strlen(entry) AS bytes, sum(strlen(entry)) OVER (PARTITION BY query_id ORDER BY ord ROWS UNBOUNDED PRECEDING) + strlen(concat('# 代码上下文 (查询: ', (SELECT text FROM queries q WHERE q.query_id = e.query_id), ')', chr(10), chr(10))) AS used FROM e)"""
_REPOS = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, repo_id ORDER BY round(score, 9) DESC, id) AS rr FROM pairs WHERE score >= 0.0) z WHERE rr <= 3)"

SQL = {
    "tokenize_counts": f"SELECT doc_id, len({_TOK.format('coalesce(text, chr(32))')}) AS tokens FROM documents",
    "vector_count": "SELECT count(*) AS vectors FROM embeddings",
    "vector_topk": _BASE + " SELECT query_id, id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 10 AND score >= 0.1",
    "search_hits": _BASE + " SELECT query_id, rank, id AS entity_id, content, round(score, 6) AS score, type FROM ranked WHERE rank <= 5 AND score >= 0.1",
    "vector_topk_filtered": _BASE + ", f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS fr FROM pairs WHERE type = 'class') SELECT query_id, id, fr AS rank, round(score, 6) AS score FROM f WHERE fr <= 5",
    "mean_pool_by_label": "SELECT label, pos, round(avg(v), 6) AS v FROM (SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding)::double AS v FROM embeddings) z GROUP BY 1, 2",
    "embed_hashing": f"""WITH {with_views('vec_docs')}, w AS (SELECT id, md5(unnest(regexp_split_to_array(lower(content), '[ \\t\\n\\v\\f\\r]+'))) AS h, unnest(regexp_split_to_array(lower(content), '[ \\t\\n\\v\\f\\r]+')) AS word FROM vec_docs),
      b AS (SELECT id, (('0x' || h[1:15])::ubigint % 64)::int AS pos, sum(CASE WHEN h[16] < '8' THEN 1 ELSE -1 END) AS n FROM w WHERE word <> '' GROUP BY 1, 2),
      l AS (SELECT id, sqrt(sum(n * n)) AS len FROM b GROUP BY 1)
      SELECT id, pos, round((n / len)::float::double, 5) AS v FROM b JOIN l USING (id) WHERE n <> 0""",
    "bm25_rerank": _bm("ranked WHERE rank <= 20") + " SELECT query_id, id, round(bm25, 5) AS bm25, round(plain, 5) AS final FROM scored",
    "code_boost": _bm("ranked WHERE rank <= 20") + f" SELECT query_id, id, round(final + 0.02 * len(list_filter({_TOK.format('text')}, lambda t: contains(lower(content), t))), 5) AS final FROM boosted",
    "rrf_fuse": _BASE + """, f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS fr FROM pairs WHERE type = 'class'),
      s AS (SELECT query_id, id, rank FROM ranked WHERE rank <= 10 UNION ALL SELECT query_id, id, fr FROM f WHERE fr <= 10)
      SELECT query_id, id, round(sum(1.0::double / (rank - 1 + 60)), 8) AS rrf FROM s GROUP BY 1, 2""",
    "semantic_search": _BASE + " SELECT query_id, id, rank FROM ranked WHERE rank <= 10 AND score >= 0.5",
    "hybrid_search": _hybrid(20) + " SELECT query_id, id, rank, round(final, 5) AS final FROM hyb WHERE rank <= 10",
    "context_search": _hybrid(20).replace("WITH ", f"WITH {with_views('kg_edges')}, ", 1) + """, ce AS (SELECT DISTINCT source, target FROM kg_edges),
      out_n AS (SELECT source AS id, length(string_agg(DISTINCT coalesce(name, target), ', ')) AS callees FROM ce LEFT JOIN kg_nodes n ON n.id = target GROUP BY 1),
      in_n AS (SELECT target AS id, length(string_agg(DISTINCT coalesce(name, source), ', ')) AS callers FROM ce LEFT JOIN kg_nodes n ON n.id = source GROUP BY 1)
      SELECT h.query_id, h.id, h.rank, round(h.final, 5) AS final, n.signature AS node_signature, n.start_line AS from_line, n.end_line AS to_line, coalesce(callees, 0) AS callees, coalesce(callers, 0) AS callers
      FROM hyb h LEFT JOIN kg_nodes n ON n.id = h.id LEFT JOIN out_n o ON o.id = h.id LEFT JOIN in_n i ON i.id = h.id WHERE rank <= 10""",
    "rag_sources": _hybrid(30) + " SELECT h.query_id, h.id, round(final, 5) AS score, n.file_path, n.start_line FROM hyb h LEFT JOIN kg_nodes n ON n.id = h.id WHERE rank <= 10",
    "rag_sources_expanded": _BASE + """, hits AS (SELECT r.query_id, r.id, n.file_path FROM ranked r LEFT JOIN kg_nodes n ON n.id = r.id WHERE rank <= 10 AND score >= 0.1),
      more AS (SELECT DISTINCT h.query_id, n.id FROM hits h JOIN kg_nodes n ON n.file_path = h.file_path WHERE (h.query_id, n.id) NOT IN (SELECT (query_id, id) FROM hits))
      SELECT query_id, 'semantic' AS reason, count(*) AS n FROM hits GROUP BY 1 UNION ALL SELECT query_id, 'same file', count(*) FROM more GROUP BY 1""",
    "rag_budget": _BASE + _ENTRY.format(reason="'semantic'", hits="(SELECT * FROM ranked WHERE rank <= 10 AND score >= 0.1)") + " SELECT query_id, ord, id, bytes, used::bigint AS used FROM u WHERE used <= 3000",
    "rag_context_text": (_BASE + _ENTRY.format(reason="'semantic'", hits="(SELECT * FROM ranked WHERE rank <= 10 AND score >= 0.1)")).replace("WITH ", f"WITH {with_views('kg_edges')}, ", 1) + """,
      kept AS (SELECT query_id, ord, id, entry, used FROM u WHERE used <= 6000), ce AS (SELECT DISTINCT source, target FROM kg_edges),
      around AS (SELECT source AS id, 0 AS side, string_agg(DISTINCT coalesce(name, target), ', ' ORDER BY coalesce(name, target)) AS names FROM ce LEFT JOIN kg_nodes n ON n.id = target GROUP BY 1
        UNION ALL SELECT target, 1, string_agg(DISTINCT coalesce(name, source), ', ' ORDER BY coalesce(name, source)) FROM ce LEFT JOIN kg_nodes n ON n.id = source GROUP BY 1),
      lines AS (SELECT k.query_id, concat(n.name, CASE side WHEN 0 THEN ' → ' ELSE ' ← ' END, names) AS line, min((ord, side)) AS p FROM kept k JOIN kg_nodes n ON n.id = k.id JOIN around a ON a.id = k.id GROUP BY 1, 2),
      section AS (SELECT query_id, concat(chr(10), '---', chr(10), '## 调用关系', chr(10), string_agg(line, chr(10) ORDER BY p), chr(10)) AS section FROM lines GROUP BY 1),
      body AS (SELECT query_id, string_agg(entry, '' ORDER BY ord) AS body, max(used) AS used FROM kept GROUP BY 1)
      SELECT q.query_id, concat('# 代码上下文 (查询: ', text, ')', chr(10), chr(10), coalesce(body, ''), CASE WHEN section IS NOT NULL AND coalesce(used, 0) + strlen(section) <= 6001 THEN section ELSE '' END) AS text
      FROM queries q LEFT JOIN body USING (query_id) LEFT JOIN section USING (query_id)""",
    "multi_repo_topk": _BASE + f" SELECT query_id, repo_id, id, rr AS rank, round(score, 6) AS score, round(max(score) OVER (PARTITION BY query_id, repo_id), 6) AS repo_best FROM {_REPOS}",
    "multi_repo_rag": _BASE + _ENTRY.format(reason="concat('semantic @ ', r.repo_id)", hits=_REPOS) + " SELECT query_id, ord, id, used::bigint AS used FROM u WHERE used <= 4000",
    "multi_repo_chosen": _BASE + f" SELECT query_id, repo_id, id, rr AS rank, round(score, 6) AS score FROM {_REPOS} WHERE repo_id IN ('readmes', 'api_docs')",
    "repo_list": "SELECT repo_id, concat(CASE WHEN r IN ('', '.', '..') THEN 'default' ELSE r END, '@', CASE WHEN coalesce(branch, '') = '' THEN 'main' ELSE branch END) AS repo_key FROM (SELECT *, regexp_replace(regexp_replace(regexp_extract(regexp_replace(repo_path, '/+$', ''), '([^/]*)$', 1), '\\.git$', ''), '[^a-zA-Z0-9_\\-.]', '_', 'g') AS r FROM repos) z",
    "repo_latest": "SELECT repo_id FROM repos ORDER BY indexed_at DESC NULLS LAST, repo_id LIMIT 1",
}
