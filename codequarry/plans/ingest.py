"""Queries of ingestion, history and raw-source operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import text as tx
from codequarry.operators import history as h
from codequarry.operators import ingest as ing
from codequarry.operators import raw, summary
from codequarry.plans.fixtures import GRAPH, PATH_SQL, nodes, steps, view, with_views
from codequarry.schema import path_key
from codequarry.session import read_table as T
from codequarry.sources import parsers


def _files(s: SparkSession, d: str) -> DataFrame:
    """One row for each file: (file_path, content), paths in one spelling and prefixed by repository."""
    p = T(s, d, "parse_results").filter("file_path is not null").select("file_id", F.concat_ws("/", "repo_id", path_key(F.col("file_path"))).alias("file_path"), F.coalesce("content", F.lit("")).alias("content"))
    return p.groupBy("file_id").agg(F.min(F.struct("file_path", "content")).alias("x")).select("x.*").groupBy("file_path").agg(F.max("content").alias("content"))


_FILES = f"""files AS (SELECT file_path, max(content) AS content FROM (SELECT file_id, min({{'file_path': file_path, 'content': content}}) AS x FROM (
  SELECT file_id, concat_ws('/', repo_id, {PATH_SQL.format('file_path')}) AS file_path, coalesce(content, '') AS content FROM parse_results WHERE file_path IS NOT NULL) z GROUP BY file_id) y, LATERAL (SELECT x.file_path AS file_path, x.content AS content) GROUP BY file_path)"""
_FILES = _FILES.replace(" y, LATERAL (SELECT x.file_path AS file_path, x.content AS content) GROUP BY file_path", " y GROUP BY file_path").replace("SELECT file_path, max(content) AS content FROM (SELECT file_id, min", "SELECT x.file_path AS file_path, max(x.content) AS content FROM (SELECT file_id, min").replace(" y GROUP BY file_path", " y GROUP BY x.file_path")


def _parsed(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "parsed_entities").filter("qualified_name is not null")


def _calls(s: SparkSession, d: str) -> DataFrame:
    """Call texts out of graph edges: the last two parts of the target id, called from the source's file."""
    e = steps(s, d).filter("type = 'calls' and source_file <> ''").select("target", path_key(F.col("source_file")).alias("file_path"), "line").distinct()
    text = F.substring_index("target", ".", -2)
    return e.select(F.concat_ws("|", "target", "file_path", "line").alias("call_id"), text.alias("callee_text"), "file_path")


def _table(s: SparkSession, d: str) -> DataFrame:
    return ing.symbols(_parsed(s, d).withColumn("file_path", path_key(F.col("file_path"))))


def _imports(s: SparkSession, d: str) -> DataFrame:
    """Alias = name of an imported entity's parent folder, out of edges of type imports."""
    e = steps(s, d).filter("type = 'imports' and source_file <> ''")
    module = F.regexp_replace("target", r"\.[^.]*$", "")
    return e.select(path_key(F.col("source_file")).alias("file_path"), F.regexp_extract(module, r"([^./]*)$", 1).alias("alias"), module.alias("module")).filter("alias <> ''").distinct()


def _items(s: SparkSession, d: str) -> DataFrame:
    p = T(s, d, "parsed_entities").filter("start_line is not null and end_line >= start_line").select("file_id", "qualified_name", "start_line", "end_line").distinct()
    f = T(s, d, "parse_results").groupBy("file_id").agg(F.min("file_path").alias("file_path"), F.min("content").alias("text"))
    return p.join(f, "file_id").select("file_path", "qualified_name", "text", "start_line", "end_line", "file_id")


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return ing.chunks(_items(s, d), 400).groupBy("qualified_name", "file_path", "total_chunks").agg(F.count("*").alias("n"), F.sum("line_count").alias("lines"), F.sum(F.octet_length("content")).alias("bytes"), F.count_if("is_truncated").alias("cut"))


def _repomap(s: SparkSession, d: str) -> DataFrame:
    n = nodes(s, d)
    x = n.join(summary.caller_callee_names(n, steps(s, d)), "id")
    return x.select("id", ing.repomap_text(F.col("type"), F.col("id"), F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("signature"), F.lit(None).cast("string"), F.col("callees"), F.col("callers")).alias("text"))


def _routes(s: SparkSession, d: str) -> DataFrame:
    m = F.explode(F.expr(r"""regexp_extract_all(content, '"(/[^"\n]*)"', 1)""")).alias("route")
    return _files(s, d).select("file_path", m).filter(tx.is_route(F.col("route"))).groupBy("route").agg(F.count("*").alias("n"))


def _parse(kind):
    def q(s: SparkSession, d: str) -> DataFrame:
        rows = parsers.parse_files(_files(s, d))
        return {"entity": parsers.parsed_entities, "import": parsers.parsed_imports, "call": parsers.parsed_calls, "endpoint": parsers.parsed_endpoints}[kind](rows)

    return q


def _repo_spec(s: SparkSession, d: str) -> DataFrame:
    key = tx.repo_key(tx.repo_id(F.coalesce("repo_url", F.lit(""))), F.col("branch"))
    a, b = tx.parse_key(key)
    return T(s, d, "repos").select("repo_id", key.alias("repo_key"), a.alias("name"), b.alias("key_branch"))


def _spec(s: SparkSession, d: str) -> DataFrame:
    spec = F.concat("file_path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    p, a, b = tx.path_spec(spec)
    return nodes(s, d).select("id", p.alias("path"), a.alias("a"), b.alias("b"))


def _history(s: SparkSession, d: str) -> DataFrame:
    c = view(s, d, "file_changes")
    return h.file_history(view(s, d, "commits"), c, c.select(F.col("path").alias("file")), 5).select("file", "rank", "hash", "status", "additions")


def _entity_history(s: SparkSession, d: str) -> DataFrame:
    c = view(s, d, "file_changes")
    n = nodes(s, d).select("id", F.concat(F.lit("src/click/f"), F.pmod(F.length("id"), F.lit(20)).cast("string"), F.lit(".go")).alias("file_path"))
    return h.entity_history(n, view(s, d, "commits"), c, 3).select("id", "file", "rank", "hash")


QUERIES = {
    "file_hash": lambda s, d: T(s, d, "documents").select("doc_id", F.sha1("text").alias("hash")),
    "file_diff_status": lambda s, d: ing.file_diff(view(s, d, "file_state_old"), view(s, d, "file_state_new")),
    "work_list": lambda s, d: ing.work_list(ing.file_diff(view(s, d, "file_state_old"), view(s, d, "file_state_new"))),
    "language_of": lambda s, d: T(s, d, "parse_results").select("file_id", tx.language_of(F.col("file_path")).alias("lang")),
    "short_path": lambda s, d: nodes(s, d).select("id", tx.short_path(F.col("file_path")).alias("short")),
    "stable_uuid": lambda s, d: nodes(s, d).select("id", tx.stable_uuid(F.col("id")).alias("uuid")),
    "repo_key_parse": _repo_spec, "path_spec": _spec,
    "symbol_table": lambda s, d: _table(s, d),
    "resolve_symbols": lambda s, d: ing.resolve(_calls(s, d), _table(s, d), _imports(s, d)),
    "route_paths": _routes,
    "http_methods": lambda s, d: T(s, d, "parsed_entities").select(F.col("name"), tx.http_method(F.col("name")).alias("method")).distinct(),
    "chunk_lines": _chunks,
    "line_range": lambda s, d: _items(s, d).select("file_id", "qualified_name", "start_line", "end_line", F.md5(ing.line_range(F.col("text"), F.col("start_line"), F.col("end_line"))).alias("md5")),
    "file_context": lambda s, d: _files(s, d).select("file_path", ing.file_context(F.col("content")).alias("context")),
    "repomap_text": _repomap,
    "vector_document": lambda s, d: nodes(s, d).select("id", ing.vector_document(F.col("type"), F.col("id"), F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("signature")).alias("text")),
    "embedding_text": lambda s, d: nodes(s, d).select("id", ing.chunk_text(F.lit(""), F.col("type"), F.col("id"), F.lit(0), F.lit(2), F.col("file_path"), F.col("signature"), F.lit('"""Doc."""'), F.lit("body")).alias("text")),
    "commit_log": lambda s, d: h.log(view(s, d, "commits"), keyword="CLICK", limit=100).select("hash", "short_hash", "author", "message"),
    "commit_log_file": lambda s, d: h.log(view(s, d, "commits"), view(s, d, "file_changes"), author="USER1", file="src/view/f3.go", limit=None).select("hash", "author"),
    "commit_stats": lambda s, d: h.detail(view(s, d, "commits"), view(s, d, "file_changes")).select("hash", "short_hash", "files", "additions", "deletions"),
    "line_counts": lambda s, d: _files(s, d).select("file_path", h.count_lines(F.col("content")).alias("lines")),
    "file_history": _history, "entity_history": _entity_history,
    "grep_lines": lambda s, d: raw.grep(_files(s, d), r"return\s+[0-9]+", "*.go", None),
    "grep_per_file": lambda s, d: raw.grep(_files(s, d), r"TODO", None, None, 2),
    "read_lines": lambda s, d: raw.read_lines(_files(s, d), 2, 5),
    "numbered_lines": lambda s, d: raw.numbered(_files(s, d), 1, 3),
    "file_tree": lambda s, d: raw.tree(_files(s, d)),
    "parse_entities": _parse("entity"), "parse_imports": _parse("import"), "parse_calls": _parse("call"), "parse_endpoints": _parse("endpoint"),
}

_P = PATH_SQL.format
_SHORT = "CASE WHEN len(string_split({0}, '/')) <= 2 THEN {0} ELSE array_to_string(string_split({0}, '/')[-2:], '/') END"
_STATE = f"WITH {with_views('file_state_old', 'file_state_new')}, diff AS (SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN (n.mod_time = o.mod_time AND n.size = o.size) OR n.hash = o.hash THEN 'unchanged' ELSE 'modified' END AS status FROM file_state_new n FULL OUTER JOIN file_state_old o ON o.path = n.path)"
_ITEMS = """items AS (SELECT f.file_path, p.qualified_name, f.text, p.start_line, p.end_line, f.file_id, string_split(f.text, chr(10)) AS ls FROM
  (SELECT DISTINCT file_id, qualified_name, start_line, end_line FROM parsed_entities WHERE start_line IS NOT NULL AND end_line >= start_line) p
  JOIN (SELECT file_id, min(file_path) AS file_path, min(content) AS text FROM parse_results GROUP BY file_id) f ON f.file_id = p.file_id)"""
_BODY = "CASE WHEN greatest({a}, 1) > len(ls) OR least({b}, len(ls)) < greatest({a}, 1) THEN '' ELSE array_to_string(ls[greatest({a}, 1):least({b}, len(ls))], chr(10)) END"
_SYM = f"sym AS (SELECT DISTINCT name, qualified_name, {_P('file_path')} AS file_path, coalesce(start_line, 0) AS start_line FROM parsed_entities WHERE qualified_name IS NOT NULL AND file_path IS NOT NULL)"
_CM = f"WITH {with_views('commits', 'file_changes')} "
_TRIM = "regexp_replace(message, '^\\s+|\\s+$', '', 'g')"
_LINES = "lines AS (SELECT file_path, unnest(range(1, len(ls) + 1)) AS line_number, unnest(ls) AS content FROM (SELECT file_path, string_split(content, chr(10)) AS ls FROM files) z)"
_NOSKIP = "NOT regexp_matches(file_path, '(?:^|/)(?:\\.git|node_modules|vendor)/')"

_T = "trim(replace(replace(b.line, chr(9), ' '), chr(13), ' '), ' ')"
_HEAD = "(" + " OR ".join(f"starts_with({_T}, '{x}')" for x in ("package ", "# ", "from ", "import ")) + ")"
_QUIET = f"({_T} = '' OR " + " OR ".join(f"starts_with({_T}, '{x}')" for x in ("//", "#", "/*", "*")) + ")"

SQL = {
    "file_hash": "SELECT doc_id, sha1(text) AS hash FROM documents",
    "file_diff_status": _STATE + " SELECT path, status FROM diff",
    "work_list": _STATE + " SELECT path FROM diff WHERE status IN ('new', 'modified')",
    "language_of": "SELECT file_id, coalesce(map {'.py':'python','.go':'go','.java':'java','.js':'javascript','.ts':'typescript','.c':'c','.cpp':'cpp','.cc':'cpp','.h':'c','.hpp':'cpp'}[lower(regexp_extract(file_path, '(\\.[^./\\\\]+)$', 1))], '') AS lang FROM parse_results",
    "short_path": f"WITH {GRAPH} SELECT id, {_SHORT.format('file_path')} AS short FROM nodes",
    "stable_uuid": f"WITH {GRAPH} SELECT id, concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) AS uuid FROM (SELECT id, sha256(id) AS h FROM nodes) z",
    "repo_key_parse": """SELECT repo_id, concat(n, '@', b) AS repo_key, n AS name, b AS key_branch FROM (SELECT repo_id, CASE WHEN r IN ('', '.', '..') THEN 'default' ELSE r END AS n, CASE WHEN coalesce(branch, '') = '' THEN 'main' ELSE branch END AS b
      FROM (SELECT *, regexp_replace(regexp_replace(regexp_extract(regexp_replace(coalesce(repo_url, ''), '/+$', ''), '([^/]*)$', 1), '\\.git$', ''), '[^a-zA-Z0-9_\\-.]', '_', 'g') AS r FROM repos) y) z""",
    "path_spec": f"WITH {GRAPH} SELECT id, CASE WHEN start_line IS NOT NULL AND end_line IS NOT NULL THEN file_path END AS path, CASE WHEN end_line IS NOT NULL THEN start_line END AS a, CASE WHEN start_line IS NOT NULL THEN end_line END AS b FROM nodes",
    "symbol_table": f"WITH {_SYM} SELECT name, qualified_name, file_path, start_line FROM sym",
    "resolve_symbols": f"""WITH {GRAPH}, {_SYM}, c AS (SELECT *, concat_ws('|', target, file_path, line) AS call_id, CASE WHEN len(string_split(target, '.')) <= 2 THEN target ELSE array_to_string(string_split(target, '.')[-2:], '.') END AS callee_text
        FROM (SELECT DISTINCT target, {_P('source_file')} AS file_path, line FROM edges WHERE type = 'calls' AND source_file <> '') z),
      imp AS (SELECT file_path, alias, max(module) AS module FROM (SELECT {_P('source_file')} AS file_path, regexp_replace(target, '\\.[^.]*$', '') AS module, regexp_extract(regexp_replace(target, '\\.[^.]*$', ''), '([^./]*)$', 1) AS alias FROM edges WHERE type = 'imports' AND source_file <> '') z WHERE alias <> '' GROUP BY 1, 2),
      q AS (SELECT DISTINCT qualified_name AS k FROM sym),
      ord AS (SELECT *, regexp_replace(file_path, '/?[^/]*$', '') AS dir FROM sym),
      own AS (SELECT file_path, key, arg_min(qualified_name, (file_path, start_line, qualified_name)) AS v FROM (SELECT *, name AS key FROM sym UNION ALL SELECT *, qualified_name FROM sym) z GROUP BY 1, 2),
      bare AS (SELECT name, arg_min(qualified_name, (file_path, start_line, qualified_name)) AS v FROM sym GROUP BY 1),
      near AS (SELECT dir, name, arg_min(qualified_name, (file_path, start_line, qualified_name)) AS v FROM ord GROUP BY 1, 2),
      x AS (SELECT c.*, CASE WHEN contains(callee_text, '.') THEN split_part(callee_text, '.', 1) END AS p, CASE WHEN contains(callee_text, '.') THEN substr(callee_text, strpos(callee_text, '.') + 1) END AS sfx, regexp_replace(file_path, '/?[^/]*$', '') AS dir FROM c),
      y AS (SELECT x.*, o.v AS own_v, q1.k AS q1, i.module, concat(i.module, '.', sfx) AS full_n, concat(regexp_extract(i.module, '([^/]*)$', 1), '.', sfx) AS base_n, pb.v AS pv, n.v AS nv, b.v AS bv, q2.k AS q2
        FROM x LEFT JOIN own o ON o.file_path = x.file_path AND o.key = x.callee_text LEFT JOIN q q1 ON q1.k = x.callee_text LEFT JOIN imp i ON i.file_path = x.file_path AND i.alias = x.p
        LEFT JOIN bare pb ON pb.name = x.p LEFT JOIN q q2 ON q2.k = x.p LEFT JOIN near n ON n.dir = x.dir AND n.name = x.callee_text LEFT JOIN bare b ON b.name = x.callee_text),
      z AS (SELECT y.*, q3.k AS q3, q4.k AS q4 FROM y LEFT JOIN q q3 ON q3.k = y.full_n LEFT JOIN q q4 ON q4.k = y.base_n)
      SELECT call_id, callee_text, file_path,
        CASE WHEN own_v IS NOT NULL THEN own_v WHEN q1 IS NOT NULL THEN callee_text WHEN module IS NOT NULL AND q3 IS NOT NULL THEN full_n WHEN module IS NOT NULL THEN base_n WHEN pv IS NOT NULL THEN concat(pv, '.', sfx) WHEN q2 IS NOT NULL THEN callee_text WHEN nv IS NOT NULL THEN nv WHEN bv IS NOT NULL THEN bv ELSE callee_text END AS resolved,
        CASE WHEN own_v IS NOT NULL THEN 1.0 WHEN q1 IS NOT NULL THEN 0.9 WHEN module IS NOT NULL AND q3 IS NOT NULL THEN 0.85 WHEN module IS NOT NULL AND q4 IS NOT NULL THEN 0.8 WHEN module IS NOT NULL THEN 0.6 WHEN pv IS NOT NULL THEN 0.7 WHEN q2 IS NOT NULL THEN 0.7 WHEN nv IS NOT NULL THEN 0.5 WHEN bv IS NOT NULL THEN 0.3 ELSE 0.1 END::double AS confidence FROM z""",
    "route_paths": f"WITH {_FILES} SELECT route, count(*) AS n FROM (SELECT unnest(regexp_extract_all(content, '\"(/[^\"\\n]*)\"', 1)) AS route FROM files) z WHERE starts_with(route, '/') AND NOT contains(route, chr(92)) AND strlen(route) <= 200 GROUP BY route",
    "http_methods": "SELECT DISTINCT name, CASE WHEN name IN ('GET','POST','PUT','DELETE','PATCH','HEAD','OPTIONS','ANY','get','post','put','delete','patch','head','options') THEN upper(name) WHEN name IN ('HandleFunc','Handle','route','api_route','add_api_route') THEN 'ANY' ELSE '' END AS method FROM parsed_entities",
    "chunk_lines": f"""WITH {_ITEMS}, b AS (SELECT *, {_BODY.format(a='start_line', b='end_line')} AS body, end_line - start_line + 1 AS total FROM items),
      w AS (SELECT *, CASE WHEN strlen(body) <= 400 THEN total ELSE greatest(10, floor(400 / greatest(strlen(body) // total, 1))::int) END AS n FROM b WHERE body <> ''),
      s AS (SELECT *, CASE WHEN n >= total THEN [start_line] ELSE list_filter(range(start_line, end_line + 1, n - 5), lambda q: q = start_line OR q + 5 <= end_line) END AS begins FROM w),
      c AS (SELECT *, unnest(begins) AS f, len(begins) AS total_chunks FROM s), d AS (SELECT *, least(f + n - 1, end_line) AS t FROM c)
      SELECT qualified_name, file_path, total_chunks, count(*) AS n, sum(t - f + 1)::bigint AS lines, sum(strlen({_BODY.format(a='f', b='t')}))::bigint AS bytes, count(*) FILTER (t < end_line) AS cut FROM d GROUP BY 1, 2, 3""",
    "line_range": f"WITH {_ITEMS} SELECT file_id, qualified_name, start_line, end_line, md5({_BODY.format(a='start_line', b='end_line')}) AS md5 FROM items",
    "file_context": f"""WITH {_FILES}, x AS (SELECT file_path, list_reduce(list_transform(string_split(content, chr(10)), lambda l: {{'line': l, 'done': false, 'block': false, 'acc': []::varchar[]}}),
        lambda a, b: {{'line': '', 'done': a.done OR (NOT {_HEAD} AND NOT a.block AND NOT {_QUIET}), 'block': NOT a.done AND CASE WHEN {_HEAD} THEN starts_with({_T}, 'import (') OR a.block ELSE a.block AND {_T} <> ')' END,
          'acc': CASE WHEN NOT a.done AND ({_HEAD} OR a.block) THEN list_append(a.acc, b.line) ELSE a.acc END}},
        {{'line': '', 'done': false, 'block': false, 'acc': []::varchar[]}}) AS r FROM files)
      SELECT file_path, array_to_string(r.acc, chr(10)) AS context FROM x""",
    "repomap_text": f"""WITH {GRAPH}, named AS (SELECT c.source AS start, string_agg(DISTINCT coalesce(n.name, c.target), ', ' ORDER BY coalesce(n.name, c.target)) AS callees FROM calls c LEFT JOIN nodes n ON n.id = c.target GROUP BY 1),
      back AS (SELECT c.target AS start, string_agg(DISTINCT coalesce(n.name, c.source), ', ' ORDER BY coalesce(n.name, c.source)) AS callers FROM calls c LEFT JOIN nodes n ON n.id = c.source GROUP BY 1)
      SELECT id, concat_ws(chr(10), '[' || type || '] ' || id, 'File: ' || file_path || ':' || start_line || '-' || end_line, nullif(signature, ''), '调用→ ' || callees, '被调用← ' || callers) AS text FROM nodes LEFT JOIN named a ON a.start = id LEFT JOIN back b ON b.start = id""",
    "vector_document": f"WITH {GRAPH} SELECT id, concat_ws(chr(10), '[' || type || '] ' || id, 'File: ' || file_path || ':' || start_line || '-' || end_line, nullif(signature, '')) AS text FROM nodes",
    "embedding_text": f"WITH {GRAPH} SELECT id, concat_ws(chr(10) || chr(10), '[' || type || '] ' || id || ' (part 1/2)', 'File: ' || file_path, nullif(signature, ''), 'Doc.', 'body') AS text FROM nodes",
    "commit_log": _CM + f"SELECT hash, hash[1:8] AS short_hash, author, {_TRIM} AS message FROM commits WHERE contains(lower(message), 'click') ORDER BY commit_ts DESC, hash LIMIT 100",
    "commit_log_file": _CM + "SELECT hash, author FROM commits WHERE (contains(lower(author), 'user1') OR contains(lower(email), 'user1')) AND hash IN (SELECT hash FROM file_changes WHERE path = 'src/view/f3.go' OR old_path = 'src/view/f3.go')",
    "commit_stats": _CM + "SELECT c.hash, c.hash[1:8] AS short_hash, count(f.hash) AS files, coalesce(sum(additions), 0)::bigint AS additions, coalesce(sum(deletions), 0)::bigint AS deletions FROM commits c LEFT JOIN file_changes f ON f.hash = c.hash GROUP BY 1, 2",
    "line_counts": f"WITH {_FILES} SELECT file_path, CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) - CASE WHEN suffix(content, chr(10)) THEN 1 ELSE 0 END END AS lines FROM files",
    "file_history": _CM + """, b AS (SELECT path AS file, * FROM file_changes UNION SELECT old_path, * FROM file_changes WHERE old_path <> ''),
      r AS (SELECT b.*, row_number() OVER (PARTITION BY file ORDER BY commit_ts DESC, b.hash, path) AS rank FROM b JOIN commits c ON c.hash = b.hash WHERE file IN (SELECT path FROM file_changes))
      SELECT file, rank, hash, status, additions FROM r WHERE rank <= 5""",
    "entity_history": f"WITH {with_views('commits', 'file_changes')}, {GRAPH}" + """, b AS (SELECT path AS file, * FROM file_changes UNION SELECT old_path, * FROM file_changes WHERE old_path <> ''),
      r AS (SELECT b.file, b.hash, row_number() OVER (PARTITION BY file ORDER BY commit_ts DESC, b.hash, path) AS rank FROM b JOIN commits c ON c.hash = b.hash)
      SELECT n.id, file, rank, hash FROM (SELECT id, concat('src/click/f', length(id) % 20, '.go') AS f FROM nodes) n JOIN r ON r.file = n.f WHERE rank <= 3""",
    "grep_lines": f"WITH {_FILES}, {_LINES} SELECT file_path, line_number, content FROM lines WHERE {_NOSKIP} AND regexp_matches(file_path, '(?:^|/)[^/]*\\.go$') AND regexp_matches(content, 'return\\s+[0-9]+')",
    "grep_per_file": f"WITH {_FILES}, {_LINES}, m AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY line_number) AS k FROM lines WHERE {_NOSKIP} AND regexp_matches(content, 'TODO')) SELECT file_path, line_number, content FROM m WHERE k <= 2",
    "read_lines": f"WITH {_FILES}, {_LINES} SELECT file_path, line_number, content FROM lines WHERE line_number BETWEEN 2 AND 5",
    "numbered_lines": f"WITH {_FILES}, {_LINES} SELECT file_path, string_agg(printf('%4d: %s', line_number, content), chr(10) ORDER BY line_number) AS text FROM lines WHERE line_number <= 3 GROUP BY file_path",
    "file_tree": f"""WITH {_FILES}, p AS (SELECT list_filter(string_split(file_path, '/'), lambda x: x <> '') AS ps FROM files),
      k AS (SELECT ps, unnest(range(1, len(ps) + 1)) AS depth FROM p WHERE len(list_filter(ps, lambda x: starts_with(x, '.') OR x IN ('node_modules', 'vendor', '__pycache__'))) = 0)
      SELECT array_to_string(ps[1:depth], '/') AS path, array_to_string(ps[1:depth - 1], '/') AS parent, ps[depth] AS name, depth, bool_or(depth < len(ps)) AS is_dir FROM k GROUP BY 1, 2, 3, 4""",
}
