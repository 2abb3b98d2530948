import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codequarry.operators import graph, summary
from codequarry.schema import SCHEMAS, conform, empty, nodes_of

EDGES = [("A", "B"), ("B", "C"), ("C", "A"), ("C", "D"), ("D", "D"), ("B", "E"), ("E", "F"), ("X", "Y")]
FILES = {"A": "p/q/a.go", "B": "p/q/a.go", "C": "p/q/b.go", "D": "p/q/b.go", "E": "r/c.go", "F": "r/c.go", "X": "r/c.go"}


@pytest.fixture(scope="module")
def kg(spark):
    nodes = spark.createDataFrame([(k, k.lower(), "function", f, i, i + 1, "", "go") for i, (k, f) in enumerate(FILES.items(), 1)], SCHEMAS["nodes"])
    edges = spark.createDataFrame([(a, b, "calls", "", 1, 1.0) for a, b in EDGES], SCHEMAS["edges"])
    return nodes, edges


def start(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "start string")


def ids(df, c="id"):
    return {r[c] for r in df.collect()}


def test_callees_and_callers(spark, kg):
    n, e = kg
    assert ids(graph.callees(n, e, start(spark, "A"), 1)) == {"B"}
    assert ids(graph.callees(n, e, start(spark, "A"), 2)) == {"B", "C", "E"}
    assert ids(graph.callees(n, e, start(spark, "A"), 3)) == {"A", "B", "C", "D", "E", "F"}
    assert ids(graph.callees(n, e, start(spark, "A"), 3, include_start=False)) == {"B", "C", "D", "E", "F"}
    assert ids(graph.callees(n, e, start(spark, "A"), 6)) == {"A", "B", "C", "D", "E", "F"}
    assert ids(graph.callers(n, e, start(spark, "C"), 1)) == {"B"}
    assert ids(graph.callees(n, e, start(spark, "X"), 1)) == set()
    assert ids(graph.callees_recursive(n, e, start(spark, "A"), 3)) == {"A", "B", "C", "D", "E", "F"}


def test_neighbors(spark, kg):
    n, e = kg
    assert ids(graph.neighbors(n, e, start(spark, "C"), "both")) == {"A", "B", "D"}
    assert ids(graph.neighbors(n, e, start(spark, "C"), "out", ["imports"])) == set()
    with pytest.raises(ValueError):
        graph.neighbors(n, e, start(spark, "C"), "sideways")


def test_subgraph(spark, kg):
    n, e = graph.subgraph(*kg, start(spark, "E"), 1)
    assert ids(n) == {"B", "E", "F"}
    assert {(r.source, r.target) for r in e.collect()} == {("B", "E"), ("E", "F")}
    _, e2 = graph.subgraph(*kg, start(spark, "X"), 1, include_unresolved=True)
    assert {(r.source, r.target) for r in e2.collect()} == {("X", "Y")}


def test_paths(spark, kg):
    p = {r.node: (r.hops, r.path) for r in graph.shortest_paths(kg[1], start(spark, "A")).collect()}
    assert p["D"] == (3, ["A", "B", "C", "D"]) and p["A"] == (0, ["A"])
    assert graph.shortest_paths(kg[1], start(spark, "D"), spark.createDataFrame([("A",)], "target string")).count() == 0
    along = graph.path_edges(graph.shortest_paths(kg[1], start(spark, "A"), spark.createDataFrame([("D",)], "target string")), kg[1])
    assert {(r.step, r.source, r.target) for r in along.collect()} == {(1, "A", "B"), (2, "B", "C"), (3, "C", "D")}


def test_cycles_and_topology(spark, kg):
    assert [r.cycle for r in graph.cycles_dfs(kg[1]).collect()] == [["A", "B", "C", "A"]]
    assert [r.cycle for r in graph.cycles(kg[1], 4).collect()] == [["A", "B", "C", "A"]]
    assert ids(graph.cycle_nodes(kg[1]), "node") == {"A", "B", "C"}
    assert {(r.node, r.layer) for r in graph.topo_layers(kg[1]).collect()} == {("X", 0), ("Y", 1)}


def test_chain_and_summary_text(spark, kg):
    text = {r.start: r.text for r in summary.call_chain(*kg, start(spark, "B", "X")).collect()}
    assert text["B"] == "B (q/a.go:2)\n  → c, e\n  ← a\n"
    assert text["X"] == "X (r/c.go:7)\n"
    tree = summary.call_tree(*kg, start(spark, "E"), 2).first().text
    assert tree == "E (r/c.go:5)\n  调用:\n    → f (r/c.go:6)\n  被调用:\n    ← b (q/a.go:2)\n      ← a (q/a.go:1)\n"
    blocks = {r.short_file: r.text for r in summary.graph_summary(*kg).collect()}
    assert blocks["q/b.go"] == "## q/b.go\nc → a, d\nd → d\n"
    assert blocks["r/c.go"] == "## r/c.go\ne → f\nx → Y\n"
    assert summary.summary_header(*kg).first().text == "# 调用图 (7 个函数, 8 条调用)\n"
    only = {r.line for r in summary.summary_lines(*kg, file="r/c.go").collect()}
    assert only == {"e → f", "x → Y"}
    order = spark.createDataFrame([(1, "E"), (2, "B")], "ord int, id string")
    assert summary.relation_section(*kg, order).first().text == "---\n## 调用关系\ne → f\ne ← b\nb → c, e\nb ← a\n"


def test_stores(spark, kg):
    n, e = kg
    n2, e2 = graph.delete_nodes(n, e, spark.createDataFrame([("B",)], "id string"))
    assert "B" not in ids(n2) and e2.count() == 5
    back = graph.import_json(graph.export_json(n, e), "node", SCHEMAS["nodes"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, n.collect()))
    dup = e.withColumn("confidence", F.lit(0.5)).unionByName(e).withColumn("seq", F.monotonically_increasing_id())
    assert ids(graph.insert_ignore(dup, [F.col("seq")]), "confidence") == {0.5}
    assert graph.append_edges(e, e).count() == 16
    assert graph.stats(n, e, empty(spark, "vectors")).first() == (7, 8, 0)
    assert conform(n.withColumn("extra", F.lit(1)), "nodes").columns == n.columns


def test_slices(spark, kg):
    n, e = kg
    assert ids(graph.confidence_slice(n, e, 0.3)[0]) == set(FILES)
    assert ids(graph.file_slice(n, e, "r/c.go")[0]) == {"B", "E", "F", "X"}
    split = graph.same_file_split(n, e, start(spark, "B"), 2).filter("id = 'A' and relation = 'caller'").first()
    assert split.same_file
    assert {(r.source, r.target) for r in graph.function_graph(n, e, file="p/q/b.go")[1].collect()} == {("C", "D"), ("D", "D")}
    assert [tuple(r) for r in graph.top_callers(n, e, 1).collect()] == [("B", "b", 2)]


def test_empty_and_nulls(spark, kg):
    none = empty(spark, "edges")
    assert graph.topo_layers(none).count() == 0
    assert graph.cycles_dfs(none).count() == 0
    assert graph.shortest_paths(none, start(spark, "A")).count() == 1
    odd = spark.createDataFrame([(None, "B", "calls", None, None, None), ("A", None, "calls", None, None, None)], SCHEMAS["edges"])
    assert graph.reach(odd, start(spark, "A"), 2).count() == 0
    rows = spark.createDataFrame([("a", None, None, None, None, None, None, None, None), (None, "x", None, None, None, None, None, None, None)], "id string, name string, type string, file_path string, start_line int, end_line int, signature string, language string, created_at timestamp")
    assert [tuple(r) for r in nodes_of(rows).collect()] == [("a", None, None, "", None, None, "", "")]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10_000))
def test_random_graphs(spark, seed):
    rnd = random.Random(seed)
    pairs = {(f"n{rnd.randrange(9)}", f"n{rnd.randrange(9)}") for _ in range(14)}
    e = spark.createDataFrame([(a, b, "calls", "", 1, 1.0) for a, b in pairs], SCHEMAS["edges"])
    near: dict = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
    level, dist = {"n0"}, {}
    for d in range(1, 4):
        level = {y for x in level for y in near.get(x, ())} - set(dist)
        dist |= dict.fromkeys(level, d)
    assert {(r.node, r.depth) for r in graph.reach(e, start(spark, "n0"), 3).collect()} == set(dist.items())
    order = {r.node: r.layer for r in graph.topo_layers(e).collect()}
    assert all(order[a] < order[b] for a, b in pairs if b in order)
    comp = {r.node: r.component for r in graph.strong_components(e).collect()}
    reach = {x: set() for p in pairs for x in p}
    for x in reach:
        todo = [x]
        while todo:
            for y in near.get(todo.pop(), ()):
                if y not in reach[x]:
                    reach[x].add(y)
                    todo.append(y)
    for x in reach:
        piece = {y for y in reach[x] if x in reach[y]} | {x}
        assert (comp[x] == min(piece)) if len(piece) > 1 else x not in comp
    for r in graph.cycles(e, 4).collect():
        c = r.cycle
        assert c[0] == c[-1] == min(c) and len(set(c)) == len(c) - 1 and all(x in pairs for x in zip(c, c[1:]))
