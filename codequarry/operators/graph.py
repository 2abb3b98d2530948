"""Property-graph operators over nodes(id, ...) and edges(source, target, type, source_file, line, confidence).

Traversals work level by level on (start, node) pairs, so one job answers many starts; a level
is a join with the edges, a distinct and an anti-join with what was reached before. Beyond
three levels each level is written to the checkpoint folder, so plans do not grow.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.schema import keep_last
from codequarry.session import checkpoint

EDGE_KEY = ["source", "target", "type", "source_file", "line"]
CALLS = ("calls",)


def upsert_nodes(stored: DataFrame, incoming: DataFrame, order: list[Column]) -> DataFrame:
    """Incoming rows replace stored ones of their id; of several incoming rows the first in `order` wins."""
    fresh = keep_last(incoming, ["id"], order).select(*stored.columns)
    return stored.join(fresh.select("id"), "id", "left_anti").select(*stored.columns).unionByName(fresh)


def insert_ignore(edges: DataFrame, order: list[Column]) -> DataFrame:
    """The first edge of each five-column key stays, with its confidence."""
    return keep_last(edges, EDGE_KEY, order)


def append_edges(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The store without a unique key keeps every edge."""
    return stored.unionByName(incoming)


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without the ids, edges without those that touch one."""
    gone = ids.select("id").distinct()
    kept = edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
    return nodes.join(gone, "id", "left_anti"), kept.select(*edges.columns)


def export_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, json) one row for each node and edge, so the export stays distributed."""
    one = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("json"))
    return one(nodes, "node").unionByName(one(edges, "edge"))


def import_json(rows: DataFrame, kind: str, schema: str) -> DataFrame:
    """The nodes or edges of an export."""
    return rows.filter(F.col("kind") == kind).select(F.from_json("json", schema).alias("x")).select("x.*")


def of_types(edges: DataFrame, types: Sequence[str] | None) -> DataFrame:
    """Edges of the types; none or an empty list means all."""
    return edges.filter(F.col("type").isin(*types)) if types else edges


def neighbors(nodes: DataFrame, edges: DataFrame, starts: DataFrame, direction: str = "both", types: Sequence[str] | None = None) -> DataFrame:
    """(start, node columns): distinct neighbours of each start(start); unknown ids are dropped.

    'both' is a union of two equi-joins, so no nested-loop join is planned.
    """
    if direction not in ("in", "out", "both"):
        raise ValueError(f"direction must be in, out or both, not {direction!r}")
    e = of_types(edges, types)
    out = e.select(F.col("source").alias("start"), F.col("target").alias("id"))
    back = e.select(F.col("target").alias("start"), F.col("source").alias("id"))
    pairs = out if direction == "out" else back if direction == "in" else out.unionByName(back)
    pairs = pairs.join(starts.select("start").distinct(), "start", "left_semi").distinct()
    return pairs.join(nodes, "id").select("start", *nodes.columns)


def reach(edges: DataFrame, starts: DataFrame, depth: int, include_start: bool = True) -> DataFrame:
    """(start, node, depth): nodes within `depth` steps along source -> target, with their least depth.

    G7m, G8 of the memory store: include_start=False. A start is among its own nodes only where a cycle leads back to it, and never without
    include_start. Depth 0 or less counts as 1. The result has a row for each pair in reach, so many
    starts are for small depths. A node with very many edges, or reached from very many starts, is
    one key of a level's join; adaptive execution splits its partition.
    """
    depth = max(1, depth)
    step = edges.select(F.col("source").alias("node"), F.col("target").alias("_next")).filter("node is not null and _next is not null").distinct()
    front = starts.select("start", F.col("start").alias("node")).distinct()
    seen: DataFrame | None = None if include_start else front.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        nxt = front.join(step, "node").select("start", F.col("_next").alias("node")).distinct()
        if seen is not None:
            nxt = nxt.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        if d > 3:
            nxt = checkpoint(nxt)
            if nxt.isEmpty():
                break
        level = nxt.withColumn("depth", F.lit(d))
        seen = level if seen is None else seen.unionByName(level)
        front = nxt
    return seen if include_start else seen.filter("depth > 0")


def callees(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int = 1, include_start: bool = True) -> DataFrame:
    """(start, depth, node columns); unresolved ids carry the walk on but are not returned."""
    r = reach(of_types(edges, CALLS), starts, depth, include_start)
    return r.withColumnRenamed("node", "id").join(nodes, "id").select("start", "depth", *nodes.columns)


def callers(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int = 1, include_start: bool = True) -> DataFrame:
    """The mirror of callees."""
    e = of_types(edges, CALLS).select(F.col("target").alias("source"), F.col("source").alias("target"))
    r = reach(e, starts, depth, include_start)
    return r.withColumnRenamed("node", "id").join(nodes, "id").select("start", "depth", *nodes.columns)


def callees_recursive(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int = 1) -> DataFrame:
    """G8 as one recursive SQL statement, for few starts and depths up to 3; walks are enumerated."""
    step, first = of_types(edges, CALLS).select("source", "target").distinct(), starts.select("start").distinct()
    r = edges.sparkSession.sql("""WITH RECURSIVE w(start, node, depth) AS (
        SELECT start, start, 0 FROM {first}
        UNION ALL SELECT w.start, e.target, w.depth + 1 FROM w JOIN {step} e ON e.source = w.node WHERE w.depth < :depth)
        SELECT start, node AS id, min(depth) AS depth FROM w WHERE depth > 0 GROUP BY start, node""", {"depth": max(1, int(depth))}, first=first, step=step)
    return r.join(nodes, "id").select("start", "depth", *nodes.columns)


def call_map(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int = 1) -> DataFrame:
    """Callers and callees at one depth, tagged by relation."""
    a = callers(nodes, edges, starts, depth).withColumn("relation", F.lit("caller"))
    b = callees(nodes, edges, starts, depth).withColumn("relation", F.lit("callee"))
    return a.unionByName(b)


def degree(edges: DataFrame) -> DataFrame:
    """(source, calls): edges of each source."""
    return edges.groupBy("source").agg(F.count("*").alias("calls"))


def induced(nodes: DataFrame, edges: DataFrame, include_unresolved: bool = False) -> DataFrame:
    """Edges with both ends among the nodes(id)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)


def subgraph(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int = 2, include_unresolved: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes within `depth` steps in either direction over all edge types, and the edges among them.

    Edges count where both ends are nodes, or with include_unresolved (G9m) where both were visited.
    """
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    r = reach(both, starts, depth).select("node").unionByName(starts.select(F.col("start").alias("node"))).distinct().withColumnRenamed("node", "id")
    found = nodes.join(r, "id", "left_semi")
    return found, induced(r if include_unresolved else found, edges)


def shortest_paths(edges: DataFrame, starts: DataFrame, targets: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """(start, node, hops, path): the least path by hops, then by ids, over all edge types.

    The path of a start to itself is the start alone. One row is kept for each (start, node),
    which is what keeps the search linear in the edges. It ends when nothing new is reached, or
    after max_depth hops where that is wanted. Targets without a path have no row.
    """
    step = checkpoint(edges.select(F.col("source").alias("node"), F.col("target").alias("_next")).distinct())
    front = starts.select("start", F.col("start").alias("node"), F.array("start").alias("path")).distinct()
    seen = front.withColumn("hops", F.lit(0))
    for d in count(1) if max_depth is None else range(1, max_depth + 1):
        nxt = (
            front.join(step, "node").groupBy("start", F.col("_next").alias("node")).agg(F.min("path").alias("path"))
            .join(seen.select("start", "node"), ["start", "node"], "left_anti")
            .select("start", "node", F.concat("path", F.array("node")).alias("path"))
        )
        nxt = checkpoint(nxt)
        if nxt.isEmpty():
            break
        seen = seen.unionByName(nxt.withColumn("hops", F.lit(d)))
        if d % 10 == 0:
            seen = checkpoint(seen)
        front = nxt
    return seen.join(targets.select(F.col("target").alias("node")), "node", "left_semi").select(*seen.columns) if targets is not None else seen


def path_edges(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges along each path, by step."""
    hop = paths.filter("hops > 0").select("start", "node", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("hops")), lambda i: F.struct(F.get("path", i - 1).alias("source"), F.get("path", i).alias("target")))).alias("step", "e"))
    return hop.select("start", "node", (F.col("step") + 1).alias("step"), "e.source", "e.target").join(edges, ["source", "target"])


def cyclic_core(edges: DataFrame, types: Sequence[str] | None = CALLS, rounds: int = 30) -> DataFrame:
    """(source, target): distinct edges without self-loops, after trimming ends that no cycle can use."""
    e = of_types(edges, types).select("source", "target").filter("source <> target").distinct()
    n = -1
    for _ in range(rounds):
        e = e.join(e.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
        e = checkpoint(e.join(e.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"))
        m = e.count()
        if m == n or not m:
            break
        n = m
    return e


def cycles(edges: DataFrame, max_len: int = 3, types: Sequence[str] | None = CALLS) -> DataFrame:
    """(length, cycle): elementary cycles of up to max_len nodes as closed walks from their least id.

    Walks go only through ids greater than their first, so each cycle is made once.
    """
    e = cyclic_core(edges, types)
    walk = e.filter("target > source").select(F.array("source", "target").alias("walk"), F.col("target").alias("node"))
    out = None
    for n in range(2, max_len + 1):
        closed = walk.join(e.withColumnRenamed("source", "node"), "node").filter(F.col("target") == F.col("walk")[0])
        closed = closed.select(F.lit(n).alias("length"), F.concat("walk", F.array(F.col("walk")[0])).alias("cycle"))
        out = closed if out is None else out.unionByName(closed)
        if n < max_len:
            walk = walk.join(e.withColumnRenamed("source", "node"), "node").filter((F.col("target") > F.col("walk")[0]) & ~F.array_contains("walk", F.col("target")))
            walk = walk.select(F.concat("walk", F.array("target")).alias("walk"), F.col("target").alias("node"))
    return out


def strong_components(edges: DataFrame, types: Sequence[str] | None = CALLS) -> DataFrame:
    """(node, component): the strongly connected pieces of two or more nodes, named by their least id.

    Colouring: the least id that reaches a node is propagated along the edges; a node of its own
    colour is a root, and what reaches it within its colour is its piece. Found pieces are taken
    out, the rest is trimmed and coloured again, so work follows the edges and not pairs of nodes.
    """
    e = cyclic_core(edges, types)
    out = None
    # Each round takes out at least the piece of the least id.
    while not e.isEmpty():
        color = e.select(F.col("source").alias("node")).union(e.select("target")).distinct().withColumn("color", F.col("node"))
        moved = True
        while moved:
            best = e.join(color.withColumnRenamed("node", "source"), "source").groupBy(F.col("target").alias("node")).agg(F.min("color").alias("_c"))
            nxt = color.join(best, "node", "left").select("node", F.least("color", F.coalesce("_c", "color")).alias("color"), (F.col("_c") < F.col("color")).alias("_moved"))
            nxt = checkpoint(nxt)
            moved = not nxt.filter("_moved").isEmpty()
            color = nxt.drop("_moved")
        ends = e.join(color.select(F.col("node").alias("source"), "color"), "source").join(color.select(F.col("node").alias("target"), F.col("color").alias("_t")), "target")
        inner = checkpoint(ends.filter(F.col("color") == F.col("_t")).select("source", "target", "color"))
        found = front = checkpoint(color.filter("node = color"))
        while True:
            back = inner.join(front.withColumnRenamed("node", "target"), ["target", "color"]).select(F.col("source").alias("node"), "color").distinct()
            front = checkpoint(back.join(found, ["node", "color"], "left_anti").select("node", "color"))
            if front.isEmpty():
                break
            found = found.unionByName(front)
        found = checkpoint(found)
        big = found.groupBy("color").agg(F.count("*").alias("n")).filter("n > 1").select("color")
        level = found.join(big, "color", "left_semi").select("node", F.col("color").alias("component"))
        out = checkpoint(level if out is None else out.unionByName(level))
        gone = found.select("node")
        rest = e.join(gone.withColumnRenamed("node", "source"), "source", "left_anti").join(gone.withColumnRenamed("node", "target"), "target", "left_anti")
        e = cyclic_core(rest.select("source", "target"), None)
    return out if out is not None else e.select(F.col("source").alias("node"), F.col("source").alias("component"))


def cycle_nodes(edges: DataFrame, types: Sequence[str] | None = CALLS) -> DataFrame:
    """(node): nodes that lie on a cycle of two or more nodes."""
    return strong_components(edges, types).select("node").distinct()


def cycles_dfs(edges: DataFrame, types: Sequence[str] | None = CALLS) -> DataFrame:
    """(cycle): the closed walks of a depth-first search with sorted neighbours, one search for
    each strongly connected piece. The search is sequential by nature, so a piece is one group;
    `cycles` and `cycle_nodes` stay distributed whatever the pieces' size."""
    e = of_types(edges, types).select("source", "target").filter("source <> target").distinct()
    piece = strong_components(edges, types)
    keyed = e.join(piece.withColumnRenamed("node", "source"), "source").join(piece.select(F.col("node").alias("target"), F.col("component").alias("_t")), "target")
    keyed = keyed.filter(F.col("component") == F.col("_t")).drop("_t")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        near = {k: sorted(set(v)) for k, v in pdf.groupby("source")["target"]}
        color: dict[str, int] = {}
        found: list[list[str]] = []
        for root in sorted(near):
            if color.get(root):
                continue
            stack = [(root, iter(near.get(root, ())))]
            path = [root]
            color[root] = 1
            while stack:
                node, rest = stack[-1]
                nxt = next(rest, None)
                if nxt is None:
                    color[node] = 2
                    stack.pop()
                    path.pop()
                elif color.get(nxt) == 1:
                    found.append([*path[path.index(nxt):], nxt])
                elif not color.get(nxt):
                    color[nxt] = 1
                    path.append(nxt)
                    stack.append((nxt, iter(near.get(nxt, ()))))
        return pd.DataFrame({"cycle": found}, columns=["cycle"])

    kind = dict(e.dtypes)["source"]
    return keyed.groupBy("component").applyInPandas(search, f"cycle array<{kind}>")


def topo_layers(edges: DataFrame, types: Sequence[str] | None = CALLS, max_layers: int | None = None) -> DataFrame:
    """(node, layer): Kahn's algorithm layer by layer; parallel edges count, nodes on or after a
    cycle and isolated nodes are left out."""
    e = checkpoint(of_types(edges, types).select("source", "target"))
    left = checkpoint(e.select(F.col("source").alias("node")).union(e.select("target")).distinct())
    rest, out = e, None
    for layer in count() if max_layers is None else range(max_layers):
        ready = left.join(rest.select(F.col("target").alias("node")).distinct(), "node", "left_anti")
        ready = checkpoint(ready)
        if ready.isEmpty():
            break
        level = ready.withColumn("layer", F.lit(layer))
        out = level if out is None else out.unionByName(level)
        left = left.join(ready, "node", "left_anti")
        rest = rest.join(ready.withColumnRenamed("node", "source"), "source", "left_anti").select("source", "target")
        if layer % 3 == 2:
            left, rest = checkpoint(left), checkpoint(rest)
        if layer % 10 == 9:
            out = checkpoint(out)
    return out if out is not None else left.withColumn("layer", F.lit(0)).limit(0)


def stats(nodes: DataFrame, edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """(node_count, edge_count, vector_count) in one row."""
    one = lambda df, kind: df.groupBy().agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    x = one(nodes, "node").unionByName(one(edges, "edge")).unionByName(one(vectors, "vector"))
    pick = lambda k: F.max(F.when(F.col("kind") == k, F.col("n")))
    return x.groupBy().agg(pick("node").alias("node_count"), pick("edge").alias("edge_count"), pick("vector").alias("vector_count"))


def type_histogram(nodes: DataFrame) -> DataFrame:
    """A5: (type, n, pct) with one decimal; the window runs over one row for each type."""
    g = nodes.groupBy("type").agg(F.count("*").alias("n"))
    return g.withColumn("pct", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))


def type_counts(nodes: DataFrame) -> DataFrame:
    """Functions, classes and methods in one row."""
    return nodes.agg(*[F.count_if(F.col("type") == t).alias(n) for t, n in (("function", "functions"), ("class", "classes"), ("method", "methods"))])


def top_callers(nodes: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """(source, name, calls): the k sources with most edges; an unknown source shows its id."""
    top = degree(edges).orderBy(F.desc("calls"), "source").limit(k)
    return top.join(nodes.select(F.col("id").alias("source"), "name"), "source", "left").select("source", F.coalesce("name", "source").alias("name"), "calls")


def function_graph(nodes: DataFrame, edges: DataFrame, file: str | None = None, type: str | None = None) -> tuple[DataFrame, DataFrame]:  # noqa: A002
    """nodes of a file, or else of a type, or else all, and the edges among them."""
    n = nodes.filter(F.col("file_path") == file) if file else nodes.filter(F.col("type") == type) if type else nodes
    return n, induced(n, edges)


def confidence_slice(nodes: DataFrame, edges: DataFrame, least: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """edges of that confidence and the nodes they touch."""
    e = edges.filter(F.coalesce("confidence", F.lit(0.0)) >= least)
    ends = e.select(F.col("source").alias("id")).union(e.select("target")).distinct()
    return nodes.join(ends, "id", "left_semi"), e


def focus_slice(nodes: DataFrame, edges: DataFrame, focus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with either end in focus(id), and the focus nodes with the other ends."""
    ids = focus.select("id").distinct()
    a = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    b = edges.join(ids.withColumnRenamed("id", "target"), "target", "left_semi").join(ids.withColumnRenamed("id", "source"), "source", "left_anti")
    e = a.select(*edges.columns).unionByName(b.select(*edges.columns))
    ends = e.select(F.col("source").alias("id")).union(e.select("target")).union(ids).distinct()
    return nodes.join(ends, "id", "left_semi"), e


def file_slice(nodes: DataFrame, edges: DataFrame, file: str) -> tuple[DataFrame, DataFrame]:
    """F7."""
    return focus_slice(nodes, edges, nodes.filter(F.col("file_path") == file).select("id"))


def same_file_split(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """callers and callees of each start with same_file."""
    home = nodes.select(F.col("id").alias("start"), F.col("file_path").alias("_home"))
    m = call_map(nodes, edges, starts, depth).join(home, "start")
    return m.withColumn("same_file", F.col("file_path") == F.col("_home")).drop("_home")
