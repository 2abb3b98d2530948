import datetime as dt
import unicodedata

from pyspark.sql import functions as F

from codequarry.functions.ids import clean_id
from codequarry.operators import bloom, heavy_keys, orphans

REL = "id bigint, source_id string, target_id string, type string, confidence double, created_at timestamp"
T = lambda d: dt.datetime(2024, 1, d)


def test_clean_id(spark):
    nfd = unicodedata.normalize("NFD", "é1")
    rows = [("  a ",), ("\u00a0b\u3000",), (nfd,), ("",), (" \t",), (None,), ("a b",)]
    got = [r.x for r in spark.createDataFrame(rows, "i string").select(clean_id(F.col("i")).alias("x")).collect()]
    assert got == ["a", "b", "é1", None, None, None, "a b"]


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    bits = bloom.filter_bits(2000)
    words = bloom.build(keys, "k", bits).scalar()
    probe = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    r = bloom.hashed(probe, "k").withColumn("m", bloom.might_contain(words, bits)).select("k", "m").collect()
    assert all(x.m for x in r if int(x.k) < 2000)
    assert sum(x.m for x in r if int(x.k) >= 2000) < 100
    assert bloom.filter_bits(10**12) == bloom.MAX_BITS


def tables(spark, rel, ent, rem=(), ext=()):
    return (
        spark.createDataFrame(rel, REL).withColumn("ref", F.lit("clash")).withColumn("spans", F.lit(1)),
        spark.createDataFrame(list(ent), "id string, created_at timestamp").withColumn("ref", F.lit(1)),
        spark.createDataFrame(list(rem), "entity_id string, removed_at timestamp"),
        spark.createDataFrame(list(ext), "id string"),
    )


def test_orphans_in_time(spark):
    rel = [
        (1, "a", "b", "calls", 1.0, T(1)),  # b comes later
        (2, "a", " b ", "calls", None, T(3)),
        (3, "a", "b", "calls", None, T(6)),  # removed on 5
        (4, "a", "b", "calls", None, T(8)),  # created anew on 7
        (5, "a", "nobody", "calls", None, None),
        (6, "a", "b", "calls", None, None),  # no time: any row is enough
        (7, "ext", None, "calls", None, T(1)),
        (8, "A", "  ", "calls", None, T(9)),  # letter case counts
        (9, "a", "b", "calls", None, T(5)),  # removed at that very time
        (9, "a", "b", "calls", None, T(5)),
        (10, "c", "a", "calls", None, T(4)),  # removed at its creation
    ]
    ent = [("a", T(1)), ("a", T(1)), ("b", T(2)), ("b", T(7)), ("c", T(3)), ("late", None)]
    t = tables(spark, rel, ent, [("b", T(5)), ("b", T(5)), ("c", T(3)), (None, T(1)), ("a", None)], [("ext",)])
    got = {(r.relationship_id, r.side) for r in orphans.orphan_rows(*t).collect()}
    assert got == {(1, "target"), (3, "target"), (5, "target"), (8, "source"), (9, "target"), (10, "source")}
    rep = {(r.side, r.month): r.orphans for r in orphans.orphan_report(*t).collect()}
    assert rep[("target", "2024-01")] == 3 and rep[("target", None)] == 1


def test_orphans_of_an_id_that_is_removed_very_often(spark):
    rel = [(i, "a", "b", "calls", None, T(i)) for i in range(1, 28)] + [(50, "a", "b", "calls", None, None)]
    ent = [("a", T(1)), *[("b", T(d)) for d in range(2, 26, 4)]]
    rem = [("b", T(d)) for d in range(4, 28, 4)]
    t = tables(spark, rel, ent, rem)
    want = {(r[0], r[1]) for r in orphans.orphans(*t).select("relationship_id", "side").collect()}
    got = {(r[0], r[1]) for r in orphans.orphans(*t, max_spans=2).select("relationship_id", "side").collect()}
    assert got == want == {(i, "target") for i in range(1, 28) if i < 2 or i >= 24 or i % 4 in (0, 1)}


def test_orphans_of_empty_tables(spark):
    t = tables(spark, [(1, "a", "b", "x", None, T(1))], [])
    assert orphans.orphan_rows(*t).count() == 2
    assert orphans.orphan_rows(*tables(spark, [], [("a", T(1))])).count() == 0


def test_orphans_with_a_full_filter_and_hot_target(spark):
    rel = [(i, "s", "hot" if i % 3 else f"t{i}", "calls", 1.0, T(2)) for i in range(6000)]
    t = tables(spark, rel, [("hot", T(1)), ("s", T(1))], [("hot", T(3))])
    got = orphans.orphans(*t, max_bits=1 << 10).select("relationship_id", "side").distinct().collect()
    assert {(r[0], r[1]) for r in got} == {(i, "target") for i in range(0, 6000, 3)}


def test_pairs(spark):
    rel = [(i, f"s{i % 4}", " hot ", "calls", 0.5, None) for i in range(97)] + [(98, None, "x", None, None, None), (99, "", None, "calls", 1.0, None), (100, "s", "", "calls", 1.0, None)]
    df = spark.createDataFrame(rel, REL).withColumn("n", F.lit("clash"))
    got = {(r.target_id, r.type): (r.n_rows, r.n_sources, r.mean_confidence) for r in heavy_keys.pair_stats(df).collect()}
    assert got == {("hot", "calls"): (97, 4, 0.5), ("x", None): (1, 0, None)}
    assert [(r.target_id, r.type) for r in heavy_keys.heavy_pairs(df).collect()] == [("hot", "calls")]
    assert heavy_keys.heavy_pairs(df.limit(0)).count() == 0


def test_heavy_counts_against_plain_counts(spark):
    import random

    rnd = random.Random(5)
    rows = [(i, f"s{rnd.randrange(50)}", f"t{min(rnd.randrange(400), rnd.randrange(400))}", rnd.choice(["calls", "imports", None]), 0.5) for i in range(6000)]
    df = spark.createDataFrame(rows, "id bigint, source_id string, target_id string, type string, confidence double")
    plain = df.groupBy("target_id", "type").count().collect()
    for share in (0.002, 0.001, 0.00001):
        want = {(r[0], r[1], r[2]) for r in plain if r[2] >= share * 6000}
        assert {tuple(r) for r in heavy_keys.heavy_counts(df, share).collect()} == want
    assert heavy_keys.candidates(heavy_keys.pair_rows(df), 0.00001) is None
