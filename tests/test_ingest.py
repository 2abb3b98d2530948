import json
import subprocess

import pytest
from pyspark.sql import functions as F

from codequarry.api import Engine
from codequarry.operators import history, ingest, raw
from codequarry.schema import SCHEMAS
from codequarry.sources import git, metadata, parsers
from codequarry.streaming import incremental


def parse(path, text, compat=False):
    lang = {"py": parsers.parse_python, "go": parsers.parse_go, "java": parsers.parse_java, "js": parsers.parse_js}[path.rsplit(".", 1)[-1]]
    return list(lang(path, text, compat))


def ent(rows):
    return {(r["type"], r["qualified_name"]) for r in rows if r["kind"] == "entity"}


def calls(rows):
    return {(r["caller"], r["callee_text"]) for r in rows if r["kind"] == "call"}


def test_parsers_of_snippets():
    py = "class K:\n    def m(self): g()\n"
    assert ent(parse("a.py", py, True)) == {("class", "K"), ("method", "K.m"), ("function", "m")}
    assert ent(parse("a.py", py)) == {("class", "K"), ("method", "K.m")}
    assert calls(parse("a.py", py)) == {("K.m", "g")}
    go = parse("a.go", "package p\nfunc (t *T) M() { t.N() }\n")
    assert ent(go) == {("method", "p.T.M")} and calls(go) == {("p.T.M", "t.N")} and go[0]["signature"] == ""
    assert ent(parse("A.java", "class K { void m() {} }", True)) == {("class", "K"), ("method", ".m")}
    assert ent(parse("A.java", "class K { void m() {} }")) == {("class", "K"), ("method", "K.m")}
    js = parse("a.js", "function f(){ a.b(); }")
    assert ent(js) == {("function", "f")} and calls(js) == {("f", "a.b")}
    assert parse("a.py", "def f(:\n") == []


def test_imports_and_endpoints():
    imp = lambda rows: {(r["alias"], r["module"]) for r in rows if r["kind"] == "import"}
    end = lambda rows: {(r["method"], r["path"], r["framework"]) for r in rows if r["kind"] == "endpoint"}
    go = parse("a.go", 'package p\nimport (\n\tx "a/b"\n\t"net/http"\n\t. "dot"\n)\nfunc F() { http.HandleFunc("/u", h) }\n// r.GET("/no", h)\n')
    assert imp(go) == {("x", "a/b"), ("http", "net/http")} and end(go) == {("ANY", "/u", "net/http")}
    py = parse("a.py", 'import a.b\nfrom m import x as y\nfrom flask import Flask\n@app.get("/p")\ndef f(): pass\n')
    assert {("b", "a.b"), ("y", "m.x")} <= imp(py) and end(py) == {("GET", "/p", "flask")}
    js = parse("a.js", "import d, {n as k} from './q/mod'\nconst express = require('express')\napp.post('/x', h)\n")
    assert {("mod", "./q/mod"), ("d", "./q/mod.d"), ("k", "./q/mod.n")} <= imp(js) and end(js) == {("POST", "/x", "express")}
    java = parse("A.java", 'import a.b.C;\nimport a.*;\nclass K {\n  @GetMapping("/g")\n  public String m(int a) { return f(a); }\n}')
    assert imp(java) == {("C", "a.b.C")} and end(java) == {("GET", "/g", "spring")}


def test_tiers(spark):
    sym = spark.createDataFrame(
        [("own", "own", "d/a.go", 1), ("f", "pkg.f", "x/p.go", 1), ("g", "full/mod.g", "x/m.go", 1), ("h", "base.h", "x/b.go", 1), ("T", "q.T", "x/t.go", 1), ("near", "d.near", "d/n.go", 1), ("far", "z.far", "z/f.go", 1)],
        "name string, qualified_name string, file_path string, start_line int",
    )
    imp = spark.createDataFrame([("d/a.go", "m", "full/mod"), ("d/a.go", "b", "some/base"), ("d/a.go", "u", "some/unknown")], "file_path string, alias string, module string")
    texts = ["own", "pkg.f", "m.g", "b.h", "u.k", "T.run", "q.T.x", "near", "far", "nothing"]
    c = spark.createDataFrame([(i, t, "d/a.go") for i, t in enumerate(texts)], "call_id int, callee_text string, file_path string")
    got = [(r.resolved, r.confidence) for r in ingest.resolve(c, sym, imp).orderBy("call_id").collect()]
    assert got[:6] == [("own", 1.0), ("pkg.f", 0.9), ("full/mod.g", 0.85), ("base.h", 0.8), ("unknown.k", 0.6), ("q.T.run", 0.7)]
    assert got[7:] == [("d.near", 0.5), ("z.far", 0.3), ("nothing", 0.1)]
    assert ingest.resolve(c.limit(0), sym.limit(0), imp.limit(0)).count() == 0


def test_chunks_cover_and_overlap(spark):
    text = "\n".join(f"line {i:03d} " + "x" * 50 for i in range(1, 201))
    df = spark.createDataFrame([("f.go", "q", text, 1, 200), ("g.go", "r", "a\nb", 1, 2), ("h.go", "s", "a", 5, 9)], "file_path string, qualified_name string, text string, start_line int, end_line int")
    rows = ingest.chunks(df, 1000).orderBy("file_path", "chunk_index").collect()
    big = [r for r in rows if r.file_path == "f.go"]
    assert big[0].from_line == 1 and big[-1].to_line == 200 and not big[-1].is_truncated
    assert all(b.from_line == a.to_line + 1 - 5 for a, b in zip(big, big[1:]))
    assert [r.id for r in rows if r.file_path != "f.go"] == ["g.go::r"]


def test_context_and_texts(spark):
    t = "package p\n\nimport (\n\t\"a\"\n)\n// c\nfunc F() {}\nimport \"late\"\n"
    df = spark.createDataFrame([(t,)], "t string")
    assert df.select(ingest.file_context(F.col("t")).alias("x")).first().x == 'package p\nimport (\n\t"a"\n)'
    lit = F.lit
    x = df.select(ingest.repomap_text(lit("function"), lit("q.F"), lit("f.go"), lit(1), lit(2), lit(""), lit('"""Doc. """'), lit("a, b"), lit("")).alias("x")).first().x
    assert x == "[function] q.F\nFile: f.go:1-2\nDoc.\n调用→ a, b"


def test_file_diff(spark):
    cols = "path string, hash string, size int, mod_time int"
    old = spark.createDataFrame([("gone", "h", 1, 1), ("same", "h", 1, 1), ("touched", "h", 1, 1), ("changed", "h", 1, 1)], cols)
    new = spark.createDataFrame([("same", "h", 1, 1), ("touched", "h", 1, 2), ("changed", "k", 2, 2), ("fresh", "h", 1, 1)], cols)
    d = ingest.file_diff(old, new)
    assert {tuple(r) for r in d.collect()} == {("gone", "deleted"), ("same", "unchanged"), ("touched", "unchanged"), ("changed", "modified"), ("fresh", "new")}
    assert {r.path for r in ingest.work_list(d).collect()} == {"changed", "fresh"}


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    d = tmp_path_factory.mktemp("r") / "repo"
    d.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(d), "-c", "user.name=Ann", "-c", "user.email=ann@example.com", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (d / "a.py").write_text("def f():\n    return g()\n")
    (d / "b.py").write_text("def g():\n    return 1\n\n\n# a longer file so that renames are seen\n")
    run("add", "."), run("commit", "-qm", "first\n")
    (d / "a.py").write_text("def f():\n    return g() + 1\n")
    run("mv", "b.py", "c.py"), run("add", "."), run("commit", "-qm", " second fix ")
    (d / ".hidden").mkdir()
    (d / ".hidden" / "x.py").write_text("x")
    return str(d)


def test_git_source(spark, repo, tmp_path):
    c, ch = git.commits(spark, repo), git.file_changes(spark, repo)
    assert [r.message for r in history.log(c, limit=5).orderBy("message").collect()] == ["first", "second fix"]
    assert {(r.path, r.old_path, r.status, r.additions, r.deletions) for r in ch.collect()} == {("a.py", "", "added", 0, 0), ("b.py", "", "added", 0, 0), ("a.py", "", "modified", 1, 1), ("c.py", "b.py", "renamed", 0, 0)}
    assert history.log(c, ch, file="b.py").count() == 2
    h = history.file_history(c, ch, spark.createDataFrame([("b.py",)], "file string"))
    assert {r.path for r in h.collect()} == {"b.py", "c.py"}
    b = git.blame(spark, repo, spark.createDataFrame([("a.py",), ("none.py",)], "path string"))
    assert [(r.line_number, r.content) for r in b.orderBy("line_number").collect()] == [(1, "def f():"), (2, "    return g() + 1")]
    assert {r.path for r in git.tracked(spark, repo).collect()} == {"a.py", "c.py"}
    assert git.clone(f"file://{repo}", str(tmp_path / "copy")) == git.head(repo) == git.checkout(repo, "main")
    assert {r.path.rsplit("/", 1)[-1] for r in ingest.scan_files(spark, repo).collect()} == {"a.py", "c.py"}
    assert history.detail(c, ch).filter("message = 'second fix'").first().additions == 1


def test_dates(spark):
    rows = [("2024-05-01T10:00:00Z",), ("2024-05-01",), ("soon",), (None,)]
    got = [r.x for r in spark.createDataFrame(rows, "d string").select(history.parse_date(F.col("d")).alias("x")).collect()]
    assert got[0].hour == 10 and got[1].day == 1 and got[2] is None and got[3] is None
    n = [r.x for r in spark.createDataFrame([("",), ("a",), ("a\n",), ("a\nb",)], "d string").select(history.count_lines(F.col("d")).alias("x")).collect()]
    assert n == [0, 1, 1, 2]


def test_metadata(spark, tmp_path):
    for p in ("one", "two/dev"):
        (tmp_path / p).mkdir(parents=True)
        (tmp_path / p / "metadata.json").write_text(json.dumps({"repo_id": p.split("/")[0], "branch": "dev" if "/" in p else "", "api_endpoints": [{"method": "GET", "path": "/"}]}, indent=1))
    assert {r.key for r in metadata.read(spark, str(tmp_path)).collect()} == {"one@main", "two@dev"}
    metadata.write(spark.createDataFrame([("q",)], "repo_id string"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "_dir=q").exists()
    state = spark.createDataFrame([("a", None, "h", 1)], SCHEMAS["file_state"])
    assert spark.read.parquet(ingest.write_state(state, str(tmp_path / "state"), 1)).count() == 1


def test_raw(spark):
    f = spark.createDataFrame([("a/x.go", "one\nTODO two\nTODO three"), ("vendor/y.go", "TODO"), ("z.py", "TODO")], "file_path string, content string")
    assert [(r.file_path, r.line_number) for r in raw.grep(f, "TODO", "*.go").collect()] == [("a/x.go", 2), ("a/x.go", 3)]
    assert raw.grep(f, "TODO", None, 30, 1).count() == 2
    assert [r.line_number for r in raw.read_lines(f.filter("file_path = 'a/x.go'"), 2, 9).collect()] == [2, 3]
    assert raw.numbered(f.filter("file_path = 'a/x.go'"), 1, 1).first().text == "   1: one"
    assert {r.path: r.is_dir for r in raw.tree(f).collect()} == {"a": True, "a/x.go": False, "z.py": False}


def test_stream_and_engine(spark, repo, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    cols = "file_path string, content string, version bigint"
    spark.createDataFrame([("a.py", "def f():\n    return g()\n", 1), ("b.py", "def g():\n    return 1\n", 1)], cols).write.mode("append").parquet(src)
    incremental.watch(spark, src, out, str(tmp_path / "cp")).awaitTermination()
    assert {r.id for r in incremental.current(spark, out, "nodes").collect()} == {"f", "g"}
    spark.createDataFrame([("a.py", "def k():\n    return k()\n", 2)], cols).write.mode("append").parquet(src)
    incremental.watch(spark, src, out, str(tmp_path / "cp")).awaitTermination()
    nodes, edges = incremental.current(spark, out, "nodes"), incremental.current(spark, out, "edges")
    assert {r.id for r in nodes.collect()} == {"k", "g"}
    assert {(r.source, r.target, r.confidence) for r in edges.collect()} == {("k", "k", 1.0)}
    files = spark.createDataFrame([("a.py", "def k():\n    return k()\n")], "file_path string, content string")
    vec = nodes.select("id", F.lit("def k").alias("content"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"), "signature", "type", F.lit("r@main").alias("repo_key"))

    class Fixed:
        def __call__(self, texts):
            return [[1.0, 0.0] for _ in texts]

    e = Engine(spark, conformed(nodes), edges, vec, git.commits(spark, repo), git.file_changes(spark, repo), files, spark.createDataFrame([("r", None)], "repo_id string, indexed_at timestamp"), None, Fixed())
    assert e.stats().first().node_count == 2
    assert "→ k" in e.call("callgraph", query="k").first().text
    assert e.call("search", query="anything").count() == 2
    assert e.call("read_code", path="a.py:1-1").first().text == "   1: def k():"
    assert e.call("read_code", pattern="def").count() == 1
    assert e.call("history", query="fix").count() == 1
    assert e.call("history", query="a.py").count() == 2
    assert e.call("history", query=git.head(repo)[:8]).count() == 1
    assert e.call("context", query="k").first().text.startswith("# 代码上下文")
    assert e.call("switch_repo").count() == 1
    assert e.rag("k", call_graph=True).count() == 1 and e.multi_search("k").count() == 2 and e.multi_rag("k").count() == 2
    assert e.context_search("k").count() == 2 and e.with_repo("none").semantic_search("k").count() == 0
    assert e.shortest_path("k", "k").first().hops == 0 and e.cycles().count() == 0 and e.topo_sort().count() == 0
    assert e.file_tree().count() == 1 and e.api_endpoints().count() == 0 and e.blame("x").count() == 0
    with pytest.raises(ValueError):
        e.call("no_such_tool")


def conformed(nodes):
    from codequarry.schema import conform

    return conform(nodes, "nodes")
