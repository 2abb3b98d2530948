import subprocess

import pytest

from codequarry.api import Engine
from codequarry.operators import indexing, ingest


class Counting:
    """An embedder that leaves a line for each text it is asked for."""

    def __init__(self, log):
        self.log = str(log)

    def __call__(self, texts):
        with open(self.log, "a") as f:
            f.writelines("x\n" for _ in texts)
        return [[float(len(t)), 1.0] for t in texts]


@pytest.fixture
def folder(tmp_path):
    src = tmp_path / "src"
    (src / "pkg").mkdir(parents=True)
    (src / "pkg" / "a.py").write_text("def f():\n    return g()\n")
    (src / "pkg" / "b.py").write_text("def g():\n    return 1\n")
    (src / "pkg" / "C.GO").write_text("package p\nfunc H() { G() }\n")
    (src / "notes.txt").write_text("def no(): pass\n")
    (src / ".hidden").mkdir()
    (src / ".hidden" / "x.py").write_text("def x(): pass\n")
    return src


def edges(e):
    return {(r.source, r.target, r.confidence) for r in e.edges.collect()}


def test_index_of_a_folder(spark, folder, tmp_path):
    target, log = str(tmp_path / "index"), tmp_path / "log"
    e = Engine.index(spark, str(folder), target, Counting(log))
    assert {r.id for r in e.nodes.collect()} == {"f", "g", "p.H"} and ("f", "g", 0.9) in edges(e)
    assert e.stats().first().asDict() == {"node_count": 3, "edge_count": 2, "vector_count": 3}
    assert {r.path.rsplit("/", 1)[-1] for r in indexing.table(spark, target, "file_state").collect()} == {"a.py", "b.py", "C.GO"}
    asked = len(log.read_text().split())
    assert asked == 3

    # Only the caller changes; the callee's file keeps its rows and the edge its target.
    (folder / "pkg" / "a.py").write_text("def f():\n    return g() + k()\n\n\ndef k():\n    return 2\n")
    e = Engine.index(spark, str(folder), target, Counting(log))
    assert indexing.latest(spark, target) == 1
    assert {("f", "g", 0.9), ("f", "k", 1.0)} <= edges(e) and {r.id for r in e.nodes.collect()} == {"f", "g", "k", "p.H"}
    assert len(log.read_text().split()) < asked + 4
    old = indexing.table(spark, target, "nodes", 0)
    assert {r.id for r in old.collect()} == {"f", "g", "p.H"}

    # A removed file leaves with its entities and vectors.
    (folder / "pkg" / "b.py").unlink()
    e = Engine.index(spark, str(folder), target, Counting(log))
    assert {r.id for r in e.nodes.collect()} == {"f", "k", "p.H"} == {r.id for r in e.vectors.collect()}
    assert ("f", "g", 0.1) in edges(e)
    before = len(log.read_text().split())
    e = Engine.index(spark, str(folder), target, Counting(log))
    assert len(log.read_text().split()) == before and e.nodes.count() == 3
    # A version without file states is not whole and does not count.
    subprocess.run(["rm", "-r", f"{target}/file_state/v=3"], check=True)
    assert indexing.latest(spark, target) == 2 and Engine.open(spark, target).nodes.count() == 3


def test_empty_folder_and_missing_index(spark, tmp_path):
    (tmp_path / "src").mkdir()
    e = Engine.index(spark, str(tmp_path / "src"), str(tmp_path / "index"))
    assert e.stats().first().asDict() == {"node_count": 0, "edge_count": 0, "vector_count": 0}
    assert indexing.table(spark, str(tmp_path / "none"), "nodes").count() == 0 and indexing.latest(spark, str(tmp_path / "none")) is None


def test_state_is_read_back(spark, tmp_path):
    folder = str(tmp_path / "state")
    assert ingest.read_state(spark, folder).count() == 0
    one = spark.createDataFrame([("a", None, "h", 1)], "path string, mod_time timestamp, hash string, size bigint")
    ingest.write_state(one, folder, 1)
    ingest.write_state(one.unionByName(one), folder, 2)
    assert ingest.read_state(spark, folder).count() == 2 and ingest.read_state(spark, folder, 1).count() == 1
    assert {r.status for r in ingest.file_diff(ingest.read_state(spark, folder), one).collect()} == {"unchanged"}


def test_history_of_an_indexed_repository(spark, folder, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(folder), "-c", "user.name=Ann", "-c", "user.email=a@example.com", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main"), run("add", "."), run("commit", "-qm", "one")
    (folder / "pkg" / "a.py").write_text("def f():\n    return g() + 1\n")
    run("checkout", "-qb", "side"), run("commit", "-qam", "two"), run("checkout", "-q", "main")
    run("mv", "pkg/b.py", "pkg/d e.py"), run("commit", "-qm", "three"), run("merge", "-q", "--no-ff", "-m", "four", "side")
    e = Engine.index(spark, str(folder), str(tmp_path / "index"))
    at = {r.message: r.hash for r in e.commits().collect()}
    assert list(at) and set(at) == {"one", "two", "three", "four"}
    rows = lambda m: [(r.path, r.old_path, r.status, r.additions, r.deletions) for r in e.diff(at[m][:10]).collect()]
    assert rows("two") == rows("four") == [("pkg/a.py", "", "modified", 1, 1)]
    assert rows("three") == [("pkg/d e.py", "pkg/b.py", "renamed", 0, 0)]
    assert {x[2:] for x in rows("one")} == {("added", 0, 0)} and len(rows("one")) == 5
    assert e.commits(since="2000-01-01", until="not a date").count() == 4 and e.commits(since="2999-01-01T00:00:00Z").count() == 0
    assert e.blame("pkg/a.py").count() == 2
