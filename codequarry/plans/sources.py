"""Queries of parsers and stores whose rows SQL can foresee.

Parsers run over written-out sources: one file of each language for each supplier, whose names
carry the supplier's key, so the rows of every file are known. Stores run over the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import text as tx
from codequarry.operators import graph, history, indexing, ingest, raw
from codequarry.plans.fixtures import GRAPH, nodes, steps, view, with_views
from codequarry.schema import conform, empty
from codequarry.session import read_table as T
from codequarry.sources import parsers

#: File name and content for a key {k}.
TEMPLATES = {
    "s{k}.go": """package shop

import (
	"github.com/gin-gonic/gin"
	str "strings"
	. "dots"
)

// Setup{k} wires the routes.
func Setup{k}(r *gin.Engine, n int) error {
	r.GET("/items/{k}", List{k})
	// r.PUT("/never", List{k})
	return str.Join("a{k}(b)")
}

type Store{k} struct {
	n int
}

func (s *Store{k}) Load(id int) int { return fetch{k}(s.n) }

func List{k}() {}
""",
    "s{k}.py": '''import os.path
from flask import Flask as Base


class Shop{k}(Base):
    """Orders of {k}."""

    def load(self, n: int = 1):
        return self.find(n)


@app.post("/orders/{k}")
def make{k}(a, *b):
    def inner():
        return os.path.join(a)
    return inner()
''',
    "S{k}.java": """package shop;

import java.util.List;
import static java.util.Objects.requireNonNull;
import java.io.*;

class Shop{k} {
    /** All orders. */
    @GetMapping("/all/{k}")
    public List<String> all(int n) { return find{k}(n); }

    @DeleteMapping(value = "/all/{k}")
    void drop() { if (ready()) { store.remove("x"); } }
}
""",
    "s{k}.js": """import d, {n as m} from './lib/mod{k}'
const express = require('express')

// app.get('/never', h)
function start{k}(app) {
  app.patch('/start/{k}', m.run)
  return d.open(`f(${app})`)
}

class Shop{k} extends Base {
  load() { return this.find(1) }
}
""",
}
ENTITIES = [
    ("s{k}.go", "function", "shop.Setup{k}", 10, 14, "func Setup{k}(r *gin.Engine, n int) error", ""),
    ("s{k}.go", "class", "shop.Store{k}", 16, 18, "type Store{k}", ""),
    ("s{k}.go", "method", "shop.Store{k}.Load", 20, 20, "", "Store{k}"),
    ("s{k}.go", "function", "shop.List{k}", 22, 22, "func List{k}()", ""),
    ("s{k}.py", "class", "Shop{k}", 5, 9, "class Shop{k}", ""),
    ("s{k}.py", "method", "Shop{k}.load", 8, 9, "def load(self, n: int=1)", "Shop{k}"),
    ("s{k}.py", "function", "make{k}", 13, 16, "def make{k}(a, *b)", ""),
    ("s{k}.py", "function", "inner", 14, 15, "def inner()", ""),
    ("S{k}.java", "class", "Shop{k}", 7, 14, "", ""),
    ("S{k}.java", "method", "Shop{k}.all", 10, 10, "", "Shop{k}"),
    ("S{k}.java", "method", "Shop{k}.drop", 13, 13, "", "Shop{k}"),
    ("s{k}.js", "function", "start{k}", 5, 8, "", ""),
    ("s{k}.js", "class", "Shop{k}", 10, 12, "", ""),
]
IMPORTS = [
    ("s{k}.go", "gin", "github.com/gin-gonic/gin"), ("s{k}.go", "str", "strings"), ("s{k}.py", "path", "os.path"), ("s{k}.py", "Base", "flask.Flask"),
    ("S{k}.java", "List", "java.util.List"), ("S{k}.java", "requireNonNull", "java.util.Objects.requireNonNull"),
    ("s{k}.js", "mod{k}", "./lib/mod{k}"), ("s{k}.js", "d", "./lib/mod{k}.d"), ("s{k}.js", "m", "./lib/mod{k}.n"), ("s{k}.js", "express", "express"),
]
CALLS = [
    ("s{k}.go", "shop.Setup{k}", "r.GET", 11), ("s{k}.go", "shop.Setup{k}", "str.Join", 13), ("s{k}.go", "shop.Store{k}.Load", "fetch{k}", 20),
    ("s{k}.py", "Shop{k}.load", "self.find", 9), ("s{k}.py", "make{k}.inner", "os.path.join", 15), ("s{k}.py", "make{k}", "inner", 16),
    ("S{k}.java", "Shop{k}.all", "find{k}", 10), ("S{k}.java", "Shop{k}.drop", "ready", 13), ("S{k}.java", "Shop{k}.drop", "store.remove", 13),
    ("s{k}.js", "start{k}", "app.patch", 6), ("s{k}.js", "start{k}", "d.open", 7), ("s{k}.js", "Shop{k}.load", "this.find", 11),
]
ENDPOINTS = [
    ("s{k}.go", "GET", "/items/{k}", "shop.List{k}", "gin", 11), ("s{k}.py", "POST", "/orders/{k}", "make{k}", "flask", 12),
    ("S{k}.java", "GET", "/all/{k}", "Shop{k}.all", "spring", 10), ("S{k}.java", "DELETE", "/all/{k}", "Shop{k}.drop", "spring", 13), ("s{k}.js", "PATCH", "/start/{k}", "", "express", 6),
]


def _written(s: SparkSession, d: str) -> DataFrame:
    """(file_path, content): the sources of every supplier."""
    k = F.col("s_suppkey").cast("string")
    files = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(t).alias("t")) for n, t in TEMPLATES.items()])
    x = T(s, d, "supplier").select(k.alias("k"), F.inline(files))
    return x.select(F.concat(F.lit("src/"), F.expr("replace(n, '{k}', k)")).alias("file_path"), F.expr("replace(t, '{k}', k)").alias("content"))


def _rows(s: SparkSession, d: str) -> DataFrame:
    return parsers.parse_files(_written(s, d))


def _endpoints(s: SparkSession, d: str) -> DataFrame:
    rows = _rows(s, d)
    table = ingest.symbols(parsers.parsed_entities(rows))
    return ingest.resolve_handlers(parsers.parsed_endpoints(rows), table, parsers.parsed_imports(rows))


def _vectors(s: SparkSession, d: str, label: int, factor: float) -> DataFrame:
    v = T(s, d, "embeddings").filter(F.col("label") % 3 >= label)
    return v.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double") * factor).alias("embedding"), F.lit(factor).alias("version"))


def _upsert(s: SparkSession, d: str) -> DataFrame:
    both = _vectors(s, d, 0, 1.0).unionByName(_vectors(s, d, 1, 2.0))
    x = ingest.keep_newest(both, "id", [F.col("version").desc()])
    return x.select("id", "version", F.round(F.get("embedding", F.lit(0)), 6).alias("first"))


def _dates(s: SparkSession, d: str) -> DataFrame:
    """Times as texts of three forms, one of them no time, parsed again."""
    form = F.pmod("event_id", F.lit(3))
    text = F.when(form == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(form == 1, F.date_format("ts", "yyyy-MM-dd")).otherwise("soon")
    return T(s, d, "events").select("event_id", history.parse_date(text).alias("parsed"))


def _ranked_tree(s: SparkSession, d: str) -> DataFrame:
    return raw.ranked(raw.tree(nodes(s, d).filter("file_path <> ''"))).select("parent", "name", "is_dir", "ord")


def _last_diff(s: SparkSession, d: str) -> DataFrame:
    changes = view(s, d, "file_changes")
    last = changes.agg(F.max("hash")).first()[0]
    return history.diff(changes, (last or "none")[:12]).select("path", "old_path", "status", "additions", "deletions")


def _frameworks(s: SparkSession, d: str) -> DataFrame:
    x = parsers.parsed_imports(_rows(s, d)).select("file_path", tx.framework(F.regexp_replace("module", r"\.Flask$", "")).alias("framework"))
    return x.filter("framework <> ''")


def _resolved(s: SparkSession, d: str) -> DataFrame:
    """Calls between the sources of one supplier, resolved against the symbols of all."""
    rows = _rows(s, d)
    calls = parsers.parsed_calls(rows).filter("callee_text = 'inner' or callee_text like 'self.%'").withColumn("call_id", F.concat_ws("|", "file_path", "line"))
    x = ingest.resolve(calls, ingest.symbols(parsers.parsed_entities(rows)), parsers.parsed_imports(rows))
    return x.select("caller", "callee_text", "file_path", "resolved", "confidence")


QUERIES = {
    "written_entities": lambda s, d: parsers.parsed_entities(_rows(s, d)).select("file_path", "type", "qualified_name", "start_line", "end_line", "signature", F.coalesce("parent", F.lit("")).alias("parent")),
    "written_imports": lambda s, d: parsers.parsed_imports(_rows(s, d)),
    "written_calls": lambda s, d: parsers.parsed_calls(_rows(s, d)).select("file_path", "caller", "callee_text", "line"),
    "written_endpoints": _endpoints,
    "written_calls_resolved": _resolved,
    "frameworks": _frameworks,
    "vector_upsert": _upsert,
    "vector_delete": lambda s, d: ingest.delete_vectors(_vectors(s, d, 0, 1.0), _vectors(s, d, 2, 1.0)).select("id"),
    "vector_collection": lambda s, d: conform(view(s, d, "vec_docs"), "vectors").select("id", "content", "type", "name", "start_line", F.size("embedding").alias("dim")),
    "table_cleared": lambda s, d: empty(s, "nodes"),
    "missing_index": lambda s, d: indexing.table(s, d + "/no-such-index", "edges"),
    "date_parse": _dates,
    "commit_diff": _last_diff,
    "file_tree_ranked": _ranked_tree,
    "callers_khop_memory": lambda s, d: graph.callers(nodes(s, d), steps(s, d), nodes(s, d).select(F.col("id").alias("start")), 2, include_start=False).select("start", "id", "depth"),
}


def _expected(columns: str, rows: list[tuple]) -> str:
    value = lambda x: f"replace('{x}', '{{k}}', k)" if isinstance(x, str) else str(x)
    each = " UNION ALL ".join("SELECT " + ", ".join(f"{value(x)} AS {c}" for c, x in zip(columns.split(), r, strict=True)) + " FROM s" for r in rows)
    return f"WITH s AS (SELECT s_suppkey::varchar AS k FROM supplier), x AS ({each}) SELECT * REPLACE (concat('src/', {columns.split()[0]}) AS {columns.split()[0]}) FROM x"


SQL = {
    "written_entities": _expected("file_path type qualified_name start_line end_line signature parent", ENTITIES),
    "written_imports": _expected("file_path alias module", IMPORTS),
    "written_calls": _expected("file_path caller callee_text line", CALLS),
    "written_endpoints": _expected("file method path handler framework line", ENDPOINTS),
    "written_calls_resolved": """WITH s AS (SELECT s_suppkey::varchar AS k FROM supplier) SELECT concat('make', k) AS caller, 'inner' AS callee_text, concat('src/s', k, '.py') AS file_path, 'inner' AS resolved, 1.0::double AS confidence FROM s
      UNION ALL SELECT concat('Shop', k, '.load'), 'self.find', concat('src/s', k, '.py'), 'self.find', 0.1 FROM s""",
    "frameworks": "WITH s AS (SELECT s_suppkey::varchar AS k FROM supplier) SELECT concat('src/s', k, e) AS file_path, f AS framework FROM s, (VALUES ('.go', 'gin'), ('.py', 'flask'), ('.js', 'express')) v(e, f)",
    "vector_upsert": "SELECT vec_id AS id, CASE WHEN label % 3 >= 1 THEN 2.0 ELSE 1.0 END::double AS version, round(embedding[1]::double * CASE WHEN label % 3 >= 1 THEN 2 ELSE 1 END, 6) AS first FROM embeddings",
    "vector_delete": "SELECT vec_id AS id FROM embeddings WHERE label % 3 < 2",
    "vector_collection": f"WITH {with_views('vec_docs')} SELECT id, content, type, NULL::varchar AS name, NULL::int AS start_line, len(embedding) AS dim FROM vec_docs",
    "table_cleared": f"WITH {GRAPH} SELECT * FROM nodes WHERE false",
    "missing_index": f"WITH {GRAPH} SELECT * FROM edges WHERE false",
    "date_parse": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('day', ts) END AS parsed FROM events",
    "commit_diff": f"WITH {with_views('file_changes')} SELECT path, old_path, status, additions, deletions FROM file_changes WHERE hash = (SELECT max(hash) FROM file_changes)",
    "file_tree_ranked": f"""WITH {GRAPH}, p AS (SELECT DISTINCT list_filter(string_split(file_path, '/'), lambda x: x <> '') AS ps FROM nodes WHERE file_path <> ''),
      k AS (SELECT ps, unnest(range(1, len(ps) + 1)) AS depth FROM p WHERE len(list_filter(ps, lambda x: starts_with(x, '.') OR x IN ('node_modules', 'vendor', '__pycache__'))) = 0),
      t AS (SELECT array_to_string(ps[1:depth - 1], '/') AS parent, ps[depth] AS name, depth, bool_or(depth < len(ps)) AS is_dir FROM k GROUP BY 1, 2, 3)
      SELECT parent, name, is_dir, row_number() OVER (PARTITION BY parent ORDER BY is_dir DESC, name) AS ord FROM t""",
    "callers_khop_memory": f"""WITH RECURSIVE {GRAPH}, walk AS (SELECT id AS start, id AS node, 0 AS depth FROM nodes
      UNION SELECT w.start, c.source, w.depth + 1 FROM walk w JOIN calls c ON c.target = w.node WHERE w.depth < 2),
    best AS (SELECT start, node AS id, min(depth) AS depth FROM walk WHERE depth > 0 GROUP BY 1, 2)
    SELECT start, b.id, b.depth FROM best b JOIN nodes n ON n.id = b.id WHERE start <> b.id""",
}
