"""Text summaries of the call graph."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions.text import short_path
from codequarry.operators import graph

#: Headings and marks of the texts.
CALLS_TITLE, CALLED_TITLE, CALLS_MARK, CALLED_MARK = "调用", "被调用", "→", "←"
SECTION_TITLE, GRAPH_TITLE, FUNCTIONS_UNIT, CALLS_UNIT = "---\n## 调用关系\n", "# 调用图 (", " 个函数, ", " 条调用)\n"


#: Names that the text of one node shows at most; `neighbor_names` has them all, one a row.
MOST_NAMES = 10_000
#: What ends a list of names that is cut.
MORE = ", …"


def neighbor_names(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(start, name): distinct names of the other ends of pairs(start, id), ids where there is no node."""
    x = pairs.distinct().join(nodes.select("id", "name"), "id", "left")
    return x.select("start", F.coalesce("name", "id").alias("name")).distinct()


def _names(pairs: DataFrame, nodes: DataFrame, most: int = MOST_NAMES) -> DataFrame:
    """(start, names): the names of `neighbor_names` as one text, sorted, cut after `most`.

    The rank is filtered before rows are shuffled, so a hub costs no task more than most + 1 names.
    """
    rank = F.row_number().over(Window.partitionBy("start").orderBy("name"))
    x = neighbor_names(pairs, nodes).withColumn("_k", rank).filter(F.col("_k") <= most + 1)
    shown = F.array_sort(F.collect_list("name"))
    return x.groupBy("start").agg(F.concat(F.array_join(F.slice(shown, 1, most), ", "), F.when(F.count("*") > most, MORE).otherwise("")).alias("names"))


def _place(name: str, path: str, line: str) -> Column:
    return F.concat(F.col(name), F.lit(" ("), short_path(F.col(path)), F.lit(":"), F.coalesce(F.col(line).cast("string"), F.lit("0")), F.lit(")"))


def call_chain(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, text): `id (path:line)`, the callees after →, the callers after ←; depth 1."""
    e = graph.of_types(edges, graph.CALLS)
    known = nodes.select("id")
    out = _names(e.select(F.col("source").alias("start"), F.col("target").alias("id")).join(known, "id", "left_semi"), nodes).withColumnRenamed("names", "callees")
    back = _names(e.select(F.col("target").alias("start"), F.col("source").alias("id")).join(known, "id", "left_semi"), nodes).withColumnRenamed("names", "callers")
    head = starts.select("start").distinct().join(nodes.select(F.col("id").alias("start"), "file_path", "start_line"), "start")
    x = head.join(out, "start", "left").join(back, "start", "left")
    line = lambda mark, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"  {mark} "), F.col(c), F.lit("\n"))).otherwise("")
    return x.select("start", F.concat(_place("start", "file_path", "start_line"), F.lit("\n"), line(CALLS_MARK, "callees"), line(CALLED_MARK, "callers")).alias("text"))


def call_tree(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """(start, text): callees and callers as indented trees, each id once for each direction, by id.

    The edges of one start's neighbourhood form one group, rendered in pre-order.
    """
    e = graph.of_types(edges, graph.CALLS).select("source", "target").distinct()

    def side(step: DataFrame, tag: str) -> DataFrame:
        near = graph.reach(step, starts, max(1, depth - 1)).select("start", "node").union(starts.select("start", F.col("start").alias("node"))).distinct()
        x = near.join(step.withColumnRenamed("source", "node"), "node").join(nodes.select(F.col("id").alias("target"), _place("name", "file_path", "start_line").alias("name")), "target")
        return x.select("start", F.lit(tag).alias("side"), F.col("node").alias("source"), "target", "name")

    rows = side(e, CALLS_MARK).unionByName(side(e.select(F.col("target").alias("source"), F.col("source").alias("target")), "←"))
    head = starts.select("start").distinct().join(nodes.select(F.col("id").alias("start"), _place("id", "file_path", "start_line").alias("_head")), "start")
    rows = head.join(rows, "start", "left")

    def render(pdf: pd.DataFrame) -> pd.DataFrame:
        start = pdf["start"].iloc[0]
        lines = [pdf["_head"].iloc[0]]
        for tag, title in ((CALLS_MARK, CALLS_TITLE), (CALLED_MARK, CALLED_TITLE)):
            part = pdf[pdf["side"] == tag]
            # Without direct neighbours that are known there is no tree.
            if not (part["source"] == start).any():
                continue
            lines.append(f"  {title}:")
            near: dict[str, list[tuple[str, str]]] = {}
            for s, t, n in sorted(zip(part["source"], part["target"], part["name"], strict=True)):
                near.setdefault(s, []).append((t, n))
            seen: set[str] = set()
            stack = [(t, n, 1) for t, n in reversed(near.get(start, []))]
            while stack:
                node, name, d = stack.pop()
                if node in seen:
                    continue
                seen.add(node)
                lines.append(f"{'  ' * (d + 1)}{tag} {name}")
                if d < depth:
                    stack += [(t, n, d + 1) for t, n in reversed(near.get(node, []))]
        return pd.DataFrame({"start": [start], "text": ["\n".join(lines) + "\n"]})

    return rows.groupBy("start").applyInPandas(render, "start string, text string")


def summary_lines(nodes: DataFrame, edges: DataFrame, file: str | None = None) -> DataFrame:
    """(short_file, file_path, start_line, id, line): `name → callees` for every selected node with calls.

    With a file, callees outside of it show their id.
    """
    chosen = nodes.filter(F.col("file_path") == file) if file else nodes
    e = graph.of_types(edges, graph.CALLS).select("source", "target").distinct().join(chosen.select(F.col("id").alias("source")), "source", "left_semi")
    named = _names(e.select(F.col("source").alias("start"), F.col("target").alias("id")), chosen)
    x = chosen.join(named.withColumnRenamed("start", "id"), "id")
    line = F.concat(F.col("name"), F.lit(f" {CALLS_MARK} "), F.col("names"))
    return x.select(*_repo(nodes), short_path(F.col("file_path")).alias("short_file"), "file_path", "start_line", "id", line.alias("line"))


def _repo(nodes: DataFrame) -> list[str]:
    """The column of the repository, where nodes of several lie together."""
    return ["repo_key"] if "repo_key" in nodes.columns else []


def graph_summary(nodes: DataFrame, edges: DataFrame, file: str | None = None) -> DataFrame:
    """(short_file, text): one block for each short path, lines by (file, start line, id).

    Files of one repository that share the last two parts of their path are one block. Nodes of
    several repositories have repo_key, and so have the blocks, so a block is bounded by the
    functions of a few files; `summary_lines` has them one a row. The whole text is the header of
    `summary_header` and the blocks by their first (file, start line).
    """
    x = summary_lines(nodes, edges, file)
    key = F.struct("file_path", F.coalesce("start_line", F.lit(0)).alias("at"), "id", "line")
    rows = x.groupBy(*_repo(nodes), "short_file").agg(F.array_sort(F.collect_list(key)).alias("rs"))
    return rows.select(*_repo(nodes), "short_file", F.concat(F.lit("## "), F.col("short_file"), F.lit("\n"), F.array_join(F.transform("rs", lambda r: r.line), "\n"), F.lit("\n")).alias("text"))


def summary_header(nodes: DataFrame, edges: DataFrame, file: str | None = None) -> DataFrame:
    """(text): the title with the counts of nodes and of distinct (source, target name) pairs."""
    chosen = nodes.filter(F.col("file_path") == file) if file else nodes
    e = graph.of_types(edges, graph.CALLS).select("source", "target").distinct().join(chosen.select(F.col("id").alias("source")), "source", "left_semi")
    pairs = e.join(chosen.select(F.col("id").alias("target"), "name"), "target", "left").select("source", F.coalesce("name", "target").alias("n")).distinct()
    n = chosen.agg(F.count("*").alias("n")).scalar()
    return pairs.agg(F.count("*").alias("m")).select(F.concat(F.lit(GRAPH_TITLE), n.cast("string"), F.lit(FUNCTIONS_UNIT), F.col("m").cast("string"), F.lit(CALLS_UNIT)).alias("text"))


def relation_lines(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(ord, side, line): `name → callees`, then `name ← callers` for each of ids(ord, id); each
    line once, at its first place; names sorted, ids without node left out."""
    e = graph.of_types(edges, graph.CALLS).select("source", "target").distinct()
    known = nodes.select("id")
    chosen = ids.select("id").distinct()

    def side(step: DataFrame, mark: str, n: int) -> DataFrame:
        pairs = step.join(chosen.withColumnRenamed("id", "start"), "start", "left_semi").join(known, "id", "left_semi")
        x = _names(pairs.select("start", "id"), nodes).join(nodes.select(F.col("id").alias("start"), "name"), "start")
        return x.select(F.col("start").alias("id"), F.lit(n).alias("side"), F.concat("name", F.lit(f" {mark} "), "names").alias("line"))

    out = side(e.select(F.col("source").alias("start"), F.col("target").alias("id")), CALLS_MARK, 0)
    back = side(e.select(F.col("target").alias("start"), F.col("source").alias("id")), CALLED_MARK, 1)
    x = ids.join(out.unionByName(back), "id")
    return x.groupBy("line").agg(F.min(F.struct("ord", "side")).alias("p")).select(F.col("p.ord").alias("ord"), F.col("p.side").alias("side"), "line")


def relation_section(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(text): the section with all lines in order; for the bounded id list of one answer."""
    rows = relation_lines(nodes, edges, ids)
    return rows.agg(F.concat(F.lit(SECTION_TITLE), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "side", "line"))), lambda r: r.line), "\n"), F.lit("\n")).alias("text"), F.count("*").alias("_n")).filter("_n > 0").drop("_n")


def caller_callee_names(nodes: DataFrame, edges: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(id, callees, callers): distinct names for each node, or each of only(id), sorted, joined by a comma."""
    e = graph.of_types(edges, graph.CALLS).select("source", "target").distinct()
    out, back = e.select(F.col("source").alias("start"), F.col("target").alias("id")), e.select(F.col("target").alias("start"), F.col("source").alias("id"))
    ids = nodes.select("id")
    if only is not None:
        wanted = only.select(F.col("id").alias("start")).distinct()
        out, back = out.join(wanted, "start", "left_semi"), back.join(wanted, "start", "left_semi")
        ids = ids.join(wanted.withColumnRenamed("start", "id"), "id", "left_semi")
    a = _names(out, nodes).select(F.col("start").alias("id"), F.col("names").alias("callees"))
    b = _names(back, nodes).select(F.col("start").alias("id"), F.col("names").alias("callers"))
    none: Column = F.lit("")
    return ids.join(a, "id", "left").join(b, "id", "left").select("id", F.coalesce("callees", none).alias("callees"), F.coalesce("callers", none).alias("callers"))
