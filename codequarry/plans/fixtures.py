"""Views that map the benchmark tables to the logical tables; the text runs in Spark and in DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codequarry.schema import edge_rows, edges_of, nodes_of
from codequarry.session import read_table

VIEWS = {
    "kg_nodes": """SELECT concat('part.', cast(p_partkey AS varchar(20))) AS id, p_name AS name,
      CASE p_size % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'class' ELSE 'method' END AS type,
      concat('src/', lower(p_type), '/', replace(p_brand, '#', '_'), '.go') AS file_path,
      cast(p_partkey * 10 + 1 AS bigint) AS start_line, cast(p_partkey * 10 + p_size AS bigint) AS end_line,
      CASE WHEN p_size % 5 = 0 THEN '' ELSE concat('func ', replace(p_name, ' ', '_'), '()') END AS signature, 'go' AS language FROM part""",
    "kg_edges_raw": """SELECT concat('part.', cast(a.l_partkey AS varchar(20))) AS source, concat('part.', cast(b.l_partkey AS varchar(20))) AS target, 'calls' AS type,
      o_orderpriority AS source_file, cast(a.rn AS bigint) AS line, a.conf AS confidence, a.l_orderkey AS seq
      FROM (SELECT l_orderkey, l_partkey, round(1 - l_discount * 5, 2) + 0.0 AS conf, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS rn FROM lineitem) a
      JOIN (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS rn FROM lineitem) b
      ON a.l_orderkey = b.l_orderkey AND b.rn = a.rn + 1 JOIN orders ON o_orderkey = a.l_orderkey""",
    "kg_edges": """SELECT source, target, type, source_file, line, confidence FROM (
      SELECT *, row_number() OVER (PARTITION BY source, target, type, source_file, line ORDER BY seq) AS k FROM kg_edges_raw) z WHERE k = 1""",
    "trade_edges": """SELECT source, target, 'calls' AS type FROM (SELECT c_nationkey AS source, s_nationkey AS target,
      row_number() OVER (PARTITION BY c_nationkey ORDER BY round(sum(l_extendedprice), 2) DESC, s_nationkey) AS r
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
      GROUP BY c_nationkey, s_nationkey) z WHERE r <= 3""",
    "vec_docs": """SELECT e.vec_id, concat('part.', cast(e.vec_id AS varchar(20))) AS id, coalesce(d.text, '') AS content, e.embedding,
      CASE e.label % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'class' ELSE 'method' END AS type, coalesce(nullif(lower(trim(d.source)), ''), 'none') AS repo_id,
      concat('func f', cast(e.label AS varchar(20)), '()') AS signature FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id""",
    "commits": """SELECT sha1(cast(event_id AS varchar(20))) AS hash, concat('user', cast(user_id AS varchar(20))) AS author,
      concat('user', cast(user_id AS varchar(20)), '@example.com') AS email, concat(' ', event_type, ' change ', cast(event_id AS varchar(20))) AS message, ts AS commit_ts FROM events""",
    "file_changes": """SELECT sha1(cast(event_id AS varchar(20))) AS hash, concat('src/', event_type, '/f', cast(event_id % 20 AS varchar(20)), '.go') AS path,
      CASE WHEN event_id % 9 = 0 THEN concat('old/', event_type, '/f', cast(event_id % 20 AS varchar(20)), '.go') ELSE '' END AS old_path,
      CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS status, cast(floor(value) AS bigint) AS additions, event_id % 7 AS deletions FROM events""",
    "file_state_old": """SELECT concat('d/', cast(doc_id AS varchar(20)), '.txt') AS path, sha1(CASE WHEN doc_id % 10 = 2 THEN concat(text, '#') ELSE text END) AS hash, n_chars AS size,
      CASE WHEN doc_id % 10 IN (2, 3) THEN 1 ELSE 2 END AS mod_time FROM documents WHERE doc_id % 10 <> 0""",
    "file_state_new": """SELECT concat('d/', cast(doc_id AS varchar(20)), '.txt') AS path, sha1(text) AS hash, n_chars AS size, 2 AS mod_time FROM documents WHERE doc_id % 10 <> 1""",
}
_NEEDS = {
    "kg_nodes": ["part"], "kg_edges_raw": ["lineitem", "orders"], "kg_edges": ["kg_edges_raw"], "trade_edges": ["lineitem", "orders", "customer", "supplier"],
    "vec_docs": ["embeddings", "documents"], "commits": ["events"], "file_changes": ["events"], "file_state_old": ["documents"], "file_state_new": ["documents"],
}


def view(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A derived view; its tables are registered under their names."""
    for n in _NEEDS[name]:
        (view(spark, d, n) if n in VIEWS else read_table(spark, d, n)).createOrReplaceTempView(n)
    return spark.sql(VIEWS[name])


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return nodes_of(read_table(spark, d, "entities"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return edges_of(read_table(spark, d, "relationships"))


def with_views(*names: str) -> str:
    """WITH clause of the views and of those they need."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, []):
            if m in VIEWS:
                add(m)
        if n in VIEWS and n not in order:
            order.append(n)

    for n in names:
        add(n)
    return ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)


def steps(spark: SparkSession, d: str) -> DataFrame:
    """The edges for operators that look at distinct pairs; repeats stay."""
    return edge_rows(read_table(spark, d, "relationships")).drop("_seq")


_CLEAN = "nullif(nfc_normalize(regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), '')"
_PATH = "regexp_replace(regexp_replace(regexp_replace({0}, '\\\\', '/', 'g'), '/+', '/', 'g'), '^(?:\\./)+', '')"
#: The graph of entities and relationships for DuckDB.
GRAPH = f"""nodes AS (SELECT id, name, type, file_path, start_line, end_line, signature, language FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, file_path NULLS LAST, start_line NULLS LAST, end_line NULLS LAST, signature NULLS LAST, language NULLS LAST) AS k
  FROM (SELECT id, name, type, coalesce({_PATH.format('file_path')}, '') AS file_path, start_line, end_line, coalesce(signature, '') AS signature, coalesce(language, '') AS language, created_at FROM entities WHERE id IS NOT NULL) y) z WHERE k = 1),
edges AS (SELECT source, target, type, source_file, line, confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY source, target, type, source_file, line ORDER BY seq, confidence) AS k FROM (
  SELECT {_CLEAN.format('source_id')} AS source, {_CLEAN.format('target_id')} AS target, type, coalesce(source_file, '') AS source_file, coalesce(line, 0) AS line, coalesce(confidence, 0.0) AS confidence, id AS seq FROM relationships) y
  WHERE source IS NOT NULL AND target IS NOT NULL) z WHERE k = 1),
calls AS (SELECT DISTINCT source, target FROM edges WHERE type = 'calls')"""
PATH_SQL = _PATH
