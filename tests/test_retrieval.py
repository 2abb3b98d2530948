import math

import pytest
from pyspark.sql import functions as F

from codequarry.functions import text as tx
from codequarry.operators import retrieval as r
from codequarry.schema import SCHEMAS


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols)).select(expr.alias("x")).first().x


def test_scalars(spark):
    c = F.col("c")
    assert one(spark, tx.tokenize(c), c="Get_user(ID) 世 a x1 x1") == ["get_user", "id", "世", "x1", "x1"]
    assert one(spark, tx.short_path(c), c="a/b/c.go") == "b/c.go"
    assert one(spark, tx.short_path(c), c="a/b") == "a/b"
    assert one(spark, tx.repo_id(c), c="https://x.test/a/my repo.git") == "my_repo"
    assert one(spark, tx.repo_id(c), c="..") == "default"
    assert one(spark, F.struct(*tx.parse_key(c)), c="a@b@dev") == ("a@b", "dev")
    assert one(spark, F.struct(*tx.path_spec(c)), c="x/y.go:3-9") == ("x/y.go", 3, 9)
    assert one(spark, F.struct(*tx.path_spec(c)), c="x/y.go") == ("x/y.go", None, None)
    assert one(spark, tx.is_route(c), c="/a/:id") and not one(spark, tx.is_route(c), c="/a\\b") and not one(spark, tx.is_route(c), c="/" + "é" * 100)
    assert one(spark, tx.http_method(c), c="HandleFunc") == "ANY" and one(spark, tx.http_method(c), c="Foo") == ""
    assert one(spark, tx.framework(c), c="github.com/go-chi/chi/v5") == "chi"
    assert one(spark, tx.language_of(c), c="a/B.CPP") == "cpp"
    assert len(one(spark, tx.stable_uuid(c), c="a")) == 36


def test_bm25_by_hand(spark):
    cand = spark.createDataFrame([(1, "x.parseFile", "parse file now", "", 0.5, "method"), (1, "y.z", "other", "", 0.6, "class")], "query_id int, id string, content string, signature string, score double, type string")
    q = spark.createDataFrame([(1, "parse file")], "query_id int, text string")
    got = {x.id: (x.bm25, x.final) for x in r.bm25(cand, q).collect()}
    assert got["x.parseFile"][0] == pytest.approx(5.131668, abs=1e-5)
    assert got["x.parseFile"][1] == pytest.approx(0.505267, abs=1e-6)
    assert got["y.z"][1] == pytest.approx(0.36)
    boosted = {x.id: x.final for x in r.code_boost(r.bm25(cand, q), spark.createDataFrame([(1, "a func")], "query_id int, text string")).collect()}
    assert boosted["x.parseFile"] == pytest.approx(0.555267, abs=1e-6)
    none = r.bm25(cand, spark.createDataFrame([(1, "-")], "query_id int, text string")).collect()
    assert {x.final for x in none} == {0.5, 0.6}


def test_topk(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0], "r1"), ("b", [0.0, 1.0], "r1"), ("c", [2.0, 0.0], "r2"), ("d", None, "r2"), ("e", [0.0, 0.0], "r2"), ("f", [1.0], "r2")], "id string, embedding array<float>, repo string")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id int, embedding array<float>")
    assert [(x.id, x.rank) for x in r.topk(v, q, 2).orderBy("rank").collect()] == [("a", 1), ("c", 2)]
    assert [x.id for x in r.topk(v, q, 5, 0.5, {"repo": "r2"}).collect()] == ["c"]
    assert {(x.repo, x.id) for x in r.topk(v, q, 1, by="repo").collect()} == {("r1", "a"), ("r2", "c")}
    assert r.topk(v, q.limit(0), 2).count() == 0


def test_topk_by_blocks_of_queries(spark, monkeypatch):
    import random

    rnd = random.Random(2)
    vec = lambda: [rnd.uniform(-1, 1) for _ in range(4)]
    v = spark.createDataFrame([(f"v{i}", vec(), f"r{i % 3}") for i in range(60)], "id string, embedding array<float>, repo string")
    q = spark.createDataFrame([(i, vec()) for i in range(30)], "query_id int, embedding array<float>")
    whole, parted = sorted(map(tuple, r.topk(v, q, 3).collect())), sorted(map(tuple, r.topk(v, q, 2, by="repo").collect()))
    monkeypatch.setattr(r, "QUERY_BLOCK_BYTES", 200)
    assert sorted(map(tuple, r.topk(v, q, 3).collect())) == whole and sorted(map(tuple, r.topk(v, q, 2, by="repo").collect())) == parted


def test_fuse_ignores_set_order(spark):
    rows = [(1, 1, "a", 1), (1, 1, "b", 2), (1, 2, "b", 1)]
    f = lambda rs: {x.id: x.rrf for x in r.fuse(spark.createDataFrame(rs, "query_id int, set_no int, id string, rank int")).collect()}
    assert f(rows) == f([(q, 3 - s, i, k) for q, s, i, k in rows])
    assert f(rows)["b"] == pytest.approx(1 / 61 + 1 / 60)


def test_budget_and_text(spark):
    src = spark.createDataFrame([(1, "a", 0.9, "body a", "s"), (1, "b", 0.8, "", ""), (1, "c", 0.7, "x" * 500, "s"), (1, "d", 0.6, "tail", "s")], "query_id int, id string, score double, content string, signature string")
    src = src.withColumns({"name": F.col("id"), "type": F.lit("function"), "file_path": F.lit("f.go"), "start_line": F.lit(1), "end_line": F.lit(2), "reason": F.lit("semantic")})
    q = spark.createDataFrame([(1, "find"), (2, "nothing")], "query_id int, text string")
    kept = r.rag_budget(src, q, 300).orderBy("ord").collect()
    assert [x.id for x in kept] == ["a"] and max(x.used for x in kept) <= 300
    texts = {x.query_id: x.text for x in r.rag_text(src, q, budget=300).collect()}
    assert texts[1] == "# 代码上下文 (查询: find)\n\n## 1. [function] a\nFile: f.go (L1-L2) | Score: 0.900 | semantic\n\n```\nbody a\n```\n\n"
    assert texts[2] == "# 代码上下文 (查询: nothing)\n\n"
    assert [x.ord for x in r.rag_budget(src, q, 10_000).orderBy("ord").collect()] == [1, 3, 4]
    nodes = spark.createDataFrame([("a", "a", "function", "f.go", 1, 2, "", "go"), ("z", "z", "function", "g.go", 1, 2, "", "go")], SCHEMAS["nodes"])
    edges = spark.createDataFrame([("a", "z", "calls", "", 1, 1.0)], SCHEMAS["edges"])
    assert r.rag_text(src, q, nodes, edges, 400).filter("query_id = 1").first().text.endswith("\n---\n## 调用关系\na → z\n")


def test_embed_and_pool(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id int, t string")
    e = r.embed(df, "t", r.HashEmbedder(8)).orderBy("id").collect()
    assert math.isclose(sum(x * x for x in e[0].embedding), 1, abs_tol=1e-6) and set(e[1].embedding) == {0.0}

    class Failing:
        def __call__(self, texts):
            if len(texts) > 1 or texts[0] == "bad":
                raise OSError
            return [[1.0]]

    got = {x.id: x.embedding for x in r.embed(spark.createDataFrame([(1, "ok"), (2, "bad")], "id int, t string"), "t", Failing()).collect()}
    assert got == {1: [1.0], 2: None}
    p = r.mean_pool(spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0])], "k int, embedding array<float>"), ["k"]).first()
    assert p.embedding == [2.0, 3.0]
