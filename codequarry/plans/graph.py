"""Queries of the graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators import graph, lookups, summary
from codequarry.plans.fixtures import GRAPH, edges, nodes, steps, view, with_views
from codequarry.schema import SCHEMAS
from codequarry.session import read_table as T

_COLS = ["id", "name", "type", "file_path", "start_line", "end_line"]
_C = ", ".join(_COLS)


def _all(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return nodes(s, d), edges(s, d)


def _walk(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return nodes(s, d), steps(s, d)


def _searched(n: DataFrame) -> DataFrame:
    """The starts of deep searches: every node whose hashed id divides by 20."""
    return n.filter("conv(substr(md5(id), 1, 8), 16, 10) % 20 = 0").select(F.col("id").alias("start"))


def _starts(n: DataFrame) -> DataFrame:
    return n.select(F.col("id").alias("start"))


def _khop(f, depth: int, starts=_starts):
    def q(s: SparkSession, d: str) -> DataFrame:
        n, e = _walk(s, d)
        return f(n, e, starts(n), depth).select("start", "id", "depth", "name")

    return q


def _hub(e: DataFrame) -> DataFrame:
    """The caller with most calls, ties by id: one start for operators that answer about one node."""
    top = e.filter("type = 'calls'").groupBy("source").agg(F.count("*").alias("n"))
    return top.orderBy(F.desc("n"), "source").limit(1).select(F.col("source").alias("start"))


_HUB = "hub AS (SELECT source AS start FROM edges WHERE type = 'calls' GROUP BY source ORDER BY count(*) DESC, source LIMIT 1)"


def _reach_sql(a: str, b: str, depth: int, only: str = "") -> str:
    return f"""WITH RECURSIVE {GRAPH}, walk AS (
      SELECT id AS start, id AS node, 0 AS depth FROM nodes {only}
      UNION SELECT w.start, c.{b}, w.depth + 1 FROM walk w JOIN calls c ON c.{a} = w.node WHERE w.depth < {depth}),
    best AS (SELECT start, node AS id, min(depth) AS depth FROM walk WHERE depth > 0 GROUP BY 1, 2)
    SELECT start, b.id, b.depth, n.name FROM best b JOIN nodes n ON n.id = b.id"""


def _subgraph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n, e = _all(s, d)
    return graph.subgraph(n, e, _hub(e), 2)


_SUB = f"""WITH RECURSIVE {GRAPH}, {_HUB}, both_ways AS (SELECT source, target FROM edges UNION SELECT target, source FROM edges),
  walk AS (SELECT start AS node, 0 AS depth FROM hub UNION SELECT b.target, w.depth + 1 FROM walk w JOIN both_ways b ON b.source = w.node WHERE w.depth < 2),
  found AS (SELECT DISTINCT n.* FROM nodes n JOIN walk w ON w.node = n.id)"""


def _neighbors(direction: str):
    def q(s: SparkSession, d: str) -> DataFrame:
        n, e = _walk(s, d)
        return graph.neighbors(n, e, _starts(n), direction).select("start", "id", "name")

    return q


def _neighbors_sql(direction: str) -> str:
    out, back = "SELECT source AS start, target AS id FROM edges", "SELECT target AS start, source AS id FROM edges"
    pairs = {"out": out, "in": back, "both": f"{out} UNION {back}"}[direction]
    return f"WITH {GRAPH} SELECT DISTINCT p.start, p.id, n.name FROM ({pairs}) p JOIN nodes n ON n.id = p.id JOIN nodes m ON m.id = p.start"


def _dag(s: SparkSession, d: str) -> DataFrame:
    return steps(s, d).filter("type = 'calls' AND source < target")


def _trade(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "trade_edges")


_TRADE = with_views("trade_edges")
_REACH_TRADE = f"""WITH RECURSIVE {_TRADE}, w AS (SELECT source AS start, target AS node, 1 AS hops FROM trade_edges WHERE source <> target
  UNION SELECT w.start, t.target, w.hops + 1 FROM w JOIN trade_edges t ON t.source = w.node WHERE t.source <> t.target AND w.hops < 25)"""


def _file(n: DataFrame) -> DataFrame:
    """The file with most nodes, ties by path."""
    return n.groupBy("file_path").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "file_path").limit(1).select("file_path")


_FILE = "one_file AS (SELECT file_path FROM nodes GROUP BY file_path ORDER BY count(*) DESC, file_path LIMIT 1)"


def _in_file(n: DataFrame) -> DataFrame:
    return n.join(_file(n), "file_path", "left_semi").select(*n.columns)


def _file_graph(s: SparkSession, d: str) -> DataFrame:
    n, e = _all(s, d)
    return graph.induced(_in_file(n), e).select("source", "target", "type", "line")


def _type_graph(s: SparkSession, d: str) -> DataFrame:
    n, e = _all(s, d)
    return graph.function_graph(n, e, type="method")[1].select("source", "target", "type", "line")


def _file_slice(s: SparkSession, d: str) -> DataFrame:
    n, e = _all(s, d)
    return graph.focus_slice(n, e, _in_file(n))[0].select(*_COLS)


def _node_slice(s: SparkSession, d: str) -> DataFrame:
    n, e = _all(s, d)
    return graph.focus_slice(n, e, _hub(e).withColumnRenamed("start", "id"))[1].select("source", "target", "type", "source_file", "line", "confidence")


def _delete(s: SparkSession, d: str) -> DataFrame:
    n, e = _all(s, d)
    gone = T(s, d, "entity_removals").select(F.col("entity_id").alias("id"))
    n2, e2 = graph.delete_nodes(n, e, gone)
    return n2.select(F.col("id").alias("key"), F.lit("node").alias("kind")).unionByName(e2.select(F.concat_ws("|", "source", "target", "type", "source_file", "line").alias("key"), F.lit("edge").alias("kind")))


def _json(s: SparkSession, d: str) -> DataFrame:
    n, e = _all(s, d)
    rows = graph.export_json(n, e)
    return graph.import_json(rows, "edge", SCHEMAS["edges"]).select("source", "target", "type", "line")


def _upsert(s: SparkSession, d: str) -> DataFrame:
    """The graph's nodes of before 2024 with all later rows upserted."""
    from codequarry.schema import nodes_of

    e = T(s, d, "entities")
    old = nodes_of(e.filter("created_at < timestamp'2024-01-01'"))
    fresh = e.filter("created_at >= timestamp'2024-01-01'").withColumn("file_path", F.coalesce(F.col("file_path"), F.lit("")))
    from codequarry.schema import path_key

    fresh = fresh.withColumns({"file_path": path_key(F.col("file_path")), "signature": F.coalesce("signature", F.lit("")), "language": F.coalesce("language", F.lit(""))})
    order = [F.col("created_at").desc_nulls_last(), *(F.col(c).asc_nulls_last() for c in ("file_path", "start_line", "end_line", "signature", "language"))]
    return graph.upsert_nodes(old, fresh, order).select(*_COLS)


def _order(s: SparkSession, d: str) -> DataFrame:
    n, e = _walk(s, d)
    ids = _in_file(n).select("start_line", "id").distinct().withColumnRenamed("start_line", "ord")
    return summary.relation_lines(n, e, ids)


QUERIES = {
    "node_upsert_last_wins": _upsert,
    "node_rows": lambda s, d: nodes(s, d).select(*_COLS, "signature", "language"),
    "edge_dedup_first_wins": lambda s, d: edges(s, d),
    "edge_append": lambda s, d: graph.append_edges(edges(s, d), edges(s, d)).groupBy("type").agg(F.count("*").alias("n")),
    "node_delete_cascade": _delete,
    "graph_json_round_trip": _json,
    "node_by_id": lambda s, d: nodes(s, d).join(_hub(edges(s, d)).withColumnRenamed("start", "id"), "id", "left_semi").select(*_COLS),
    "callees_khop_memory": lambda s, d: graph.callees(*_walk(s, d), _starts(nodes(s, d)), 2, include_start=False).select("start", "id", "depth"),
    "subgraph_edges_unresolved": lambda s, d: graph.subgraph(*_all(s, d), _hub(edges(s, d)), 2, include_unresolved=True)[1].select("source", "target", "type", "source_file", "line"),
    "nodes_by_type": lambda s, d: lookups.by_type(nodes(s, d), "class").select(*_COLS),
    "node_dto": lambda s, d: lookups.node_rows(lookups.scan(nodes(s, d))),
    "edge_ends": lambda s, d: lookups.union_distinct(edges(s, d).select(F.col("source").alias("id")), edges(s, d).select(F.col("target").alias("id"))),
    "unresolved_targets": lambda s, d: lookups.difference(edges(s, d).select(F.col("target").alias("id")), nodes(s, d), ["id"]).distinct(),
    "first_call_of_source": lambda s, d: lookups.first_seen(edges(s, d).filter("type = 'calls'"), ["source"], [F.col("line"), F.col("target"), F.col("source_file")]).select("source", "target", "line"),
    "nodes_by_file": lambda s, d: _in_file(nodes(s, d)).select(*_COLS),
    "neighbors_in": _neighbors("in"), "neighbors_out": _neighbors("out"), "neighbors_both": _neighbors("both"),
    "callers_1hop": _khop(graph.callers, 1), "callees_1hop": _khop(graph.callees, 1),
    "callers_khop": _khop(graph.callers, 3, _searched), "callees_khop": _khop(graph.callees, 3, _searched),
    "callees_recursive_cte": lambda s, d: graph.callees_recursive(*_all(s, d), _hub(edges(s, d)), 3).select("start", "id", "depth", "name"),
    "call_map": lambda s, d: graph.call_map(*_walk(s, d), _starts(nodes(s, d)), 1).select("start", "relation", "id", "name"),
    "subgraph_nodes": lambda s, d: _subgraph(s, d)[0].select(*_COLS),
    "subgraph_edges": lambda s, d: _subgraph(s, d)[1].select("source", "target", "type", "source_file", "line"),
    "shortest_path": lambda s, d: graph.shortest_paths(_trade(s, d), s.createDataFrame([(0,)], "start int")).select("node", "hops", F.array_join(F.transform("path", lambda x: x.cast("string")), "|").alias("path")),
    "hop_distance": lambda s, d: graph.shortest_paths(steps(s, d), _hub(edges(s, d))).select("node", "hops"),
    "path_edges": lambda s, d: graph.path_edges(graph.shortest_paths(_trade(s, d), s.createDataFrame([(0,)], "start int")), _trade(s, d)).select("node", "step", "source", "target"),
    "cycle_nodes": lambda s, d: graph.cycle_nodes(_trade(s, d)),
    "cycles_len3": lambda s, d: graph.cycles(_trade(s, d), 3).select("length", F.array_join(F.transform("cycle", lambda x: x.cast("string")), "|").alias("cycle")),
    "cycles_dfs": lambda s, d: graph.cycles_dfs(_trade(s, d)).select(F.array_join(F.transform("cycle", lambda x: x.cast("string")), "|").alias("cycle")),
    "topo_layers": lambda s, d: graph.topo_layers(_dag(s, d)),
    "workspace_stats": lambda s, d: graph.stats(*_all(s, d), T(s, d, "embeddings")),
    "type_histogram": lambda s, d: graph.type_histogram(nodes(s, d)),
    "entity_type_counts": lambda s, d: graph.type_counts(nodes(s, d)),
    "top_callers": lambda s, d: graph.top_callers(*_all(s, d), 10),
    "degree": lambda s, d: graph.degree(edges(s, d)),
    "file_count": lambda s, d: nodes(s, d).agg(F.count_distinct("file_path").alias("files")),
    "function_graph_by_file": _file_graph, "function_graph_by_type": _type_graph,
    "confidence_slice": lambda s, d: graph.confidence_slice(*_all(s, d), 0.3)[0].select(*_COLS),
    "file_slice": _file_slice, "node_slice": _node_slice,
    "cross_file_split": lambda s, d: graph.same_file_split(*_walk(s, d), _starts(nodes(s, d)), 2).groupBy("start", "relation", "same_file").agg(F.count("*").alias("n")),
    "call_chain_depth1": lambda s, d: summary.call_chain(*_walk(s, d), _starts(nodes(s, d))),
    "call_chain_tree": lambda s, d: summary.call_tree(*_walk(s, d), _starts(nodes(s, d)), 2),
    "call_graph_summary": lambda s, d: summary.graph_summary(*_walk(s, d)),
    "call_graph_summary_header": lambda s, d: summary.summary_header(*_walk(s, d)),
    "call_relation_lines": _order,
    "caller_callee_names": lambda s, d: summary.caller_callee_names(*_walk(s, d)),
}

_SEARCHED = "WHERE ('0x' || md5(id)[1:8])::ubigint % 20 = 0"
_G = f"WITH {GRAPH} "
_NAMES = """named AS (SELECT c.source AS start, string_agg(DISTINCT coalesce(n.name, c.target), ', ' ORDER BY coalesce(n.name, c.target)) AS callees FROM calls c {j} JOIN nodes n ON n.id = c.target GROUP BY 1),
  back AS (SELECT c.target AS start, string_agg(DISTINCT coalesce(n.name, c.source), ', ' ORDER BY coalesce(n.name, c.source)) AS callers FROM calls c {j} JOIN nodes n ON n.id = c.source GROUP BY 1)"""
_SHORT = "CASE WHEN len(string_split({0}, '/')) <= 2 THEN {0} ELSE array_to_string(string_split({0}, '/')[-2:], '/') END"

_PLACE = f"concat(n.name, ' (', {_SHORT.format('n.file_path')}, ':', coalesce(n.start_line, 0), ')')"
#: A visit in pre-order, each id once: b is the next direct neighbour, a what was seen and written so far.
_NEW_KIDS = "list_filter(b.kids, lambda q: NOT list_contains(a.seen, q.t) AND q.t <> b.t)"


def _tree_side(mark: str, title: str, source: str, target: str, name: str) -> str:
    blank = "{'t': '', 'name': '', 'kids': []::STRUCT(t VARCHAR, name VARCHAR)[], 'seen': []::VARCHAR[], 'lines': []::VARCHAR[]}"
    visit = f"""CASE WHEN list_contains(a.seen, b.t) THEN a ELSE {{'t': '', 'name': '', 'kids': a.kids, 'seen': list_concat(a.seen, [b.t], list_transform({_NEW_KIDS}, lambda q: q.t)),
        'lines': list_concat(a.lines, [concat('    {mark} ', b.name)], list_transform({_NEW_KIDS}, lambda q: concat('      {mark} ', q.name)))}} END"""
    return f"""{name}_kids AS (SELECT {source} AS t, list({{'t': {target}, 'name': {_PLACE}}} ORDER BY {target}) AS kids FROM calls JOIN nodes n ON n.id = {target} GROUP BY 1),
      {name} AS (SELECT start, concat('  {title}:', chr(10), array_to_string(list_reduce(l, lambda a, b: {visit}, {blank}).lines, chr(10)), chr(10)) AS part FROM (
        SELECT {source} AS start, list({{'t': {target}, 'name': {_PLACE}, 'kids': coalesce(k.kids, []), 'seen': []::VARCHAR[], 'lines': []::VARCHAR[]}} ORDER BY {target}) AS l
        FROM calls JOIN nodes n ON n.id = {target} LEFT JOIN {name}_kids k ON k.t = {target} GROUP BY 1) z)"""


SQL = {
    "node_upsert_last_wins": _G + f"SELECT {_C} FROM nodes WHERE id IN (SELECT id FROM entities WHERE created_at IS NOT NULL)",
    "node_rows": _G + f"SELECT {_C}, signature, language FROM nodes",
    "edge_dedup_first_wins": _G + "SELECT source, target, type, source_file, line, confidence FROM edges",
    "edge_append": _G + "SELECT type, 2 * count(*) AS n FROM edges GROUP BY type",
    "node_delete_cascade": _G + """, gone AS (SELECT DISTINCT entity_id AS id FROM entity_removals)
      SELECT id AS key, 'node' AS kind FROM nodes WHERE id NOT IN (SELECT id FROM gone WHERE id IS NOT NULL)
      UNION ALL SELECT concat_ws('|', source, target, type, source_file, line), 'edge' FROM edges WHERE source NOT IN (SELECT id FROM gone WHERE id IS NOT NULL) AND target NOT IN (SELECT id FROM gone WHERE id IS NOT NULL)""",
    "graph_json_round_trip": _G + "SELECT source, target, type, line FROM edges",
    "node_by_id": _G + f", {_HUB} SELECT {_C} FROM nodes WHERE id IN (SELECT start FROM hub)",
    "callees_khop_memory": _reach_sql("source", "target", 2).replace("SELECT start, b.id, b.depth, n.name", "SELECT start, b.id, b.depth") + " WHERE start <> b.id",
    "subgraph_edges_unresolved": _SUB + " SELECT source, target, type, source_file, line FROM edges WHERE source IN (SELECT node FROM walk) AND target IN (SELECT node FROM walk)",
    "node_dto": _G + f"SELECT {_C}, signature FROM nodes",
    "edge_ends": _G + "SELECT source AS id FROM edges UNION SELECT target FROM edges",
    "unresolved_targets": _G + "SELECT DISTINCT target AS id FROM edges WHERE target NOT IN (SELECT id FROM nodes)",
    "first_call_of_source": _G + "SELECT source, target, line FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY line, target, source_file) AS k FROM edges WHERE type = 'calls') z WHERE k = 1",
    "nodes_by_type": _G + f"SELECT {_C} FROM nodes WHERE type = 'class'",
    "nodes_by_file": _G + f", {_FILE} SELECT {_C} FROM nodes WHERE file_path IN (SELECT file_path FROM one_file)",
    "neighbors_in": _neighbors_sql("in"), "neighbors_out": _neighbors_sql("out"), "neighbors_both": _neighbors_sql("both"),
    "callers_1hop": _reach_sql("target", "source", 1), "callees_1hop": _reach_sql("source", "target", 1),
    "callers_khop": _reach_sql("target", "source", 3, _SEARCHED), "callees_khop": _reach_sql("source", "target", 3, _SEARCHED),
    "callees_recursive_cte": f"""WITH RECURSIVE {GRAPH}, {_HUB}, walk AS (SELECT start, start AS node, 0 AS depth FROM hub
      UNION SELECT w.start, c.target, w.depth + 1 FROM walk w JOIN calls c ON c.source = w.node WHERE w.depth < 3)
      SELECT start, id, min(depth) AS depth, name FROM walk JOIN nodes ON id = node WHERE depth > 0 GROUP BY start, id, name""",
    "call_map": _G + """SELECT m.id AS start, 'callee' AS relation, n.id, n.name FROM nodes m JOIN calls c ON c.source = m.id JOIN nodes n ON n.id = c.target
      UNION ALL SELECT m.id, 'caller', n.id, n.name FROM nodes m JOIN calls c ON c.target = m.id JOIN nodes n ON n.id = c.source""",
    "subgraph_nodes": _SUB + f" SELECT {_C} FROM found",
    "subgraph_edges": _SUB + " SELECT source, target, type, source_file, line FROM edges WHERE source IN (SELECT id FROM found) AND target IN (SELECT id FROM found)",
    "shortest_path": f"""WITH RECURSIVE {_TRADE}, w AS (SELECT 0 AS node, 0 AS hops, [0] AS path
      UNION SELECT t.target, w.hops + 1, list_append(w.path, t.target) FROM w JOIN trade_edges t ON t.source = w.node WHERE w.hops < 8 AND NOT list_contains(w.path, t.target)),
      r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY hops, path) AS k FROM w)
      SELECT node, hops, array_to_string(path, '|') AS path FROM r WHERE k = 1""",
    "hop_distance": f"""WITH RECURSIVE {GRAPH}, {_HUB}, all_edges AS (SELECT DISTINCT source, target FROM edges), w AS (SELECT start AS node, 0 AS hops FROM hub
      UNION SELECT e.target, w.hops + 1 FROM w JOIN all_edges e ON e.source = w.node WHERE w.hops < 40) SELECT node, min(hops) AS hops FROM w GROUP BY node""",
    "path_edges": f"""WITH RECURSIVE {_TRADE}, w AS (SELECT 0 AS node, 0 AS hops, [0] AS path
      UNION SELECT t.target, w.hops + 1, list_append(w.path, t.target) FROM w JOIN trade_edges t ON t.source = w.node WHERE w.hops < 8 AND NOT list_contains(w.path, t.target)),
      r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY hops, path) AS k FROM w),
      h AS (SELECT node, path, unnest(range(1, hops + 1)) AS step FROM r WHERE k = 1)
      SELECT node, step, path[step] AS source, path[step + 1] AS target FROM h""",
    "cycle_nodes": _REACH_TRADE + " SELECT DISTINCT node FROM w WHERE start = node",
    "cycles_len3": f"""WITH {_TRADE}, e AS (SELECT DISTINCT source, target FROM trade_edges WHERE source <> target)
      SELECT 2 AS length, concat_ws('|', a.source, a.target, a.source) AS cycle FROM e a JOIN e b ON b.source = a.target AND b.target = a.source WHERE a.source < a.target
      UNION ALL SELECT 3, concat_ws('|', a.source, a.target, b.target, a.source) FROM e a JOIN e b ON b.source = a.target JOIN e c ON c.source = b.target AND c.target = a.source WHERE a.source < a.target AND a.source < b.target""",
    "topo_layers": f"""WITH RECURSIVE {GRAPH}, dag AS (SELECT source, target FROM calls WHERE source < target),
      w AS (SELECT DISTINCT source AS node, 0 AS layer FROM dag WHERE source NOT IN (SELECT target FROM dag) UNION SELECT d.target, w.layer + 1 FROM w JOIN dag d ON d.source = w.node)
      SELECT node, max(layer) AS layer FROM w GROUP BY node""",
    "workspace_stats": _G + "SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count, (SELECT count(*) FROM embeddings) AS vector_count",
    "type_histogram": _G + "SELECT type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM nodes GROUP BY type",
    "entity_type_counts": _G + "SELECT count(*) FILTER (type = 'function') AS functions, count(*) FILTER (type = 'class') AS classes, count(*) FILTER (type = 'method') AS methods FROM nodes",
    "top_callers": _G + "SELECT source, coalesce(name, source) AS name, calls FROM (SELECT source, count(*) AS calls FROM edges GROUP BY source ORDER BY calls DESC, source LIMIT 10) t LEFT JOIN nodes ON id = source",
    "degree": _G + "SELECT source, count(*) AS calls FROM edges GROUP BY source",
    "file_count": _G + "SELECT count(DISTINCT file_path) AS files FROM nodes",
    "function_graph_by_file": _G + f", {_FILE}, f AS (SELECT id FROM nodes WHERE file_path IN (SELECT file_path FROM one_file)) SELECT source, target, type, line FROM edges WHERE source IN (SELECT id FROM f) AND target IN (SELECT id FROM f)",
    "function_graph_by_type": _G + ", f AS (SELECT id FROM nodes WHERE type = 'method') SELECT source, target, type, line FROM edges WHERE source IN (SELECT id FROM f) AND target IN (SELECT id FROM f)",
    "confidence_slice": _G + f"SELECT {_C} FROM nodes WHERE id IN (SELECT source FROM edges WHERE confidence >= 0.3 UNION SELECT target FROM edges WHERE confidence >= 0.3)",
    "file_slice": _G + f""", {_FILE}, f AS (SELECT id FROM nodes WHERE file_path IN (SELECT file_path FROM one_file)),
      e AS (SELECT source, target FROM edges WHERE source IN (SELECT id FROM f) OR target IN (SELECT id FROM f))
      SELECT {_C} FROM nodes WHERE id IN (SELECT id FROM f UNION SELECT source FROM e UNION SELECT target FROM e)""",
    "node_slice": _G + f", {_HUB} SELECT source, target, type, source_file, line, confidence FROM edges WHERE source IN (SELECT start FROM hub) OR target IN (SELECT start FROM hub)",
    "cross_file_split": f"""WITH RECURSIVE {GRAPH}, out_w AS (SELECT id AS start, id AS node, 0 AS depth FROM nodes UNION SELECT w.start, c.target, w.depth + 1 FROM out_w w JOIN calls c ON c.source = w.node WHERE w.depth < 2),
      in_w AS (SELECT id AS start, id AS node, 0 AS depth FROM nodes UNION SELECT w.start, c.source, w.depth + 1 FROM in_w w JOIN calls c ON c.target = w.node WHERE w.depth < 2),
      m AS (SELECT DISTINCT start, node, 'callee' AS relation FROM out_w WHERE depth > 0 UNION ALL SELECT DISTINCT start, node, 'caller' FROM in_w WHERE depth > 0)
      SELECT m.start, m.relation, n.file_path = h.file_path AS same_file, count(*) AS n FROM m JOIN nodes n ON n.id = m.node JOIN nodes h ON h.id = m.start GROUP BY 1, 2, 3""",
    "call_chain_depth1": _G + ", " + _NAMES.format(j="") + f""" SELECT id AS start, concat(id, ' (', {_SHORT.format('file_path')}, ':', coalesce(start_line, 0), ')', chr(10),
      CASE WHEN callees IS NOT NULL THEN concat('  → ', callees, chr(10)) ELSE '' END, CASE WHEN callers IS NOT NULL THEN concat('  ← ', callers, chr(10)) ELSE '' END) AS text
      FROM nodes n LEFT JOIN named a ON a.start = n.id LEFT JOIN back b ON b.start = n.id""",
    "call_chain_tree": _G + f""", {_tree_side('→', '调用', 'source', 'target', 'down')}, {_tree_side('←', '被调用', 'target', 'source', 'up')}
      SELECT n.id AS start, concat(n.id, ' (', {_SHORT.format('n.file_path')}, ':', coalesce(n.start_line, 0), ')', chr(10), coalesce(d.part, ''), coalesce(u.part, '')) AS text
      FROM nodes n LEFT JOIN down d ON d.start = n.id LEFT JOIN up u ON u.start = n.id""",
    "call_graph_summary": _G + ", " + _NAMES.format(j="LEFT") + f""" SELECT {_SHORT.format('file_path')} AS short_file,
      concat('## ', {_SHORT.format('file_path')}, chr(10), string_agg(concat(name, ' → ', callees), chr(10) ORDER BY file_path, coalesce(start_line, 0), id), chr(10)) AS text
      FROM nodes n JOIN named a ON a.start = n.id GROUP BY {_SHORT.format('file_path')}""",
    "call_graph_summary_header": _G + """SELECT concat('# 调用图 (', (SELECT count(*) FROM nodes), ' 个函数, ', count(*), ' 条调用)', chr(10)) AS text
      FROM (SELECT DISTINCT c.source, coalesce(n.name, c.target) FROM calls c JOIN nodes m ON m.id = c.source LEFT JOIN nodes n ON n.id = c.target) z""",
    "call_relation_lines": _G + f", {_FILE}, " + _NAMES.format(j="") + """, ids AS (SELECT DISTINCT start_line AS ord, id, name FROM nodes WHERE file_path IN (SELECT file_path FROM one_file)),
      x AS (SELECT ord, 0 AS side, concat(name, ' → ', callees) AS line FROM ids JOIN named ON start = id UNION ALL SELECT ord, 1, concat(name, ' ← ', callers) FROM ids JOIN back ON start = id),
      y AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY ord, side) AS k FROM x) SELECT ord, side, line FROM y WHERE k = 1""",
    "caller_callee_names": _G + ", " + _NAMES.format(j="LEFT") + " SELECT id, coalesce(callees, '') AS callees, coalesce(callers, '') AS callers FROM nodes LEFT JOIN named a ON a.start = id LEFT JOIN back b ON b.start = id",
}
