"""References to records that do not exist (problem 1).

Method: a Bloom filter of the parent keys (entities and external symbols), bounded in size
and broadcast as a scalar, proves most orphans at once; only the references that it lets
through are joined exactly, against the times at which each entity was alive. Orphans are
then counted per side and month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions.ids import clean_id
from codequarry.operators import bloom

#: References to an id that holds more than this share of a sample are spread over SALTS tasks;
#: the sample decides on the spreading alone, never on a result.
HOT_SHARE, SALTS, HOT_SAMPLE = 0.005, 32, 0.02
#: Ids removed more often than this are not looked up in arrays but by a sorted as-of pass.
MAX_SPANS = 1000


def references(relationships: DataFrame) -> DataFrame:
    """(relationship_id, side, ref, at): one row for each reference that is one.

    Null and blank ids are no reference. Extra columns are ignored.
    """
    r = relationships.select("id", "source_id", "target_id", "created_at")
    r = r.select("id", "created_at", clean_id(F.col("source_id")).alias("s"), clean_id(F.col("target_id")).alias("t"))
    both = F.array(
        F.struct(F.lit("source").alias("side"), F.col("s").alias("ref")),
        F.struct(F.lit("target").alias("side"), F.col("t").alias("ref")),
    )
    return (
        r.select(F.col("id").alias("relationship_id"), F.col("created_at").alias("at"), F.inline(both))
        .filter(F.col("ref").isNotNull())
    )


def lifetimes(entities: DataFrame, removals: DataFrame) -> DataFrame:
    """(ref, born, gone): the disjoint spans [born, gone) in which an id exists; gone null: still there.

    A removal ends the id at its time, also if the id was created at that very time. Rows
    of entities without created_at give a span that never holds at a known time.
    """
    e = entities.select(clean_id(F.col("id")).alias("ref"), F.col("created_at").alias("t"), F.lit(0).alias("k"))
    d = removals.select(clean_id(F.col("entity_id")).alias("ref"), F.col("removed_at").alias("t"), F.lit(1).alias("k"))
    marks = e.filter("ref is not null").distinct().unionByName(d.filter("ref is not null and t is not null").distinct())
    after = Window.partitionBy("ref").orderBy(F.col("t").asc_nulls_first(), "k").rowsBetween(0, Window.unboundedFollowing)
    gone = F.min(F.when(F.col("k") == 1, F.col("t"))).over(after)
    spans = marks.withColumn("gone", gone).filter("k = 0")
    return spans.groupBy("ref", "gone").agg(F.min("t").alias("born"))


def _dead_as_of(refs: DataFrame, entities: DataFrame, removals: DataFrame, ids: DataFrame) -> DataFrame:
    """(relationship_id, side, at): references to ids(ref) that do not hold, for ids with any number of removals.

    An id is alive at a time if its last creation until then is later than its last removal;
    one running pass in time order finds both, without collecting anything.
    """
    null = F.lit(None)
    e = entities.select(clean_id(F.col("id")).alias("ref"), F.col("created_at").alias("t"), F.lit(0).alias("k"))
    d = removals.select(clean_id(F.col("entity_id")).alias("ref"), F.col("removed_at").alias("t"), F.lit(1).alias("k"))
    marks = e.unionByName(d).filter("t is not null").distinct().join(ids, "ref", "left_semi")
    marks = marks.select("ref", "t", "k", null.cast("bigint").alias("relationship_id"), null.cast("string").alias("side"))
    mine = refs.join(ids, "ref", "left_semi")
    asked = mine.filter("at is not null").select("ref", F.col("at").alias("t"), F.lit(2).alias("k"), "relationship_id", "side")
    until = Window.partitionBy("ref").orderBy("t", "k").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda kind: F.max(F.when(F.col("k") == kind, F.col("t"))).over(until)
    seen = marks.unionByName(asked).withColumns({"_c": last(0), "_r": last(1)}).filter("k = 2")
    alive = F.col("_c").isNotNull() & (F.col("_r").isNull() | (F.col("_r") < F.col("_c")))
    dead = seen.filter(~alive).select("relationship_id", "side", F.col("t").alias("at"))
    known = e.select("ref").distinct()
    timeless = mine.filter("at is null").join(known, "ref", "left_anti").select("relationship_id", "side", "at")
    return dead.unionByName(timeless)


def orphans(relationships: DataFrame, entities: DataFrame, removals: DataFrame, external: DataFrame,
            max_bits: int = bloom.MAX_BITS, max_spans: int = MAX_SPANS) -> DataFrame:
    """(relationship_id, side, at): the orphan references, one row for each that was delivered.

    Ids are compared without surrounding white space and composed; letter case counts. An
    id of `external` always exists. With a null `created_at` any row of the id is enough.
    Empty tables are allowed: without parents every reference is an orphan.
    """
    refs = references(relationships)
    life = lifetimes(entities, removals)
    ext = external.select(clean_id(F.col("id")).alias("ref")).filter("ref is not null").distinct()
    parents = entities.select(clean_id(F.col("id")).alias("ref")).filter("ref is not null").unionByName(ext)
    bits = bloom.filter_bits(entities.count() + external.count(), max_bits=max_bits)
    words = bloom.build(parents, "ref", bits).scalar()
    seen = bloom.hashed(refs, "ref").withColumn("maybe", bloom.might_contain(words, bits)).drop("_a", "_b")
    sure = seen.filter(~F.col("maybe")).select("relationship_id", "side", "at")
    open_refs = seen.filter("maybe").drop("maybe")

    # The spans of an id are at most one more than its removals; ids with very many go another way.
    often = removals.select(clean_id(F.col("entity_id")).alias("ref")).groupBy("ref").agg(F.count("*").alias("n")).filter(F.col("n") > max_spans).select("ref")
    often = often.join(ext, "ref", "left_anti")
    extra = None
    if not often.isEmpty():
        extra = _dead_as_of(open_refs, entities, removals, often)
        open_refs = open_refs.join(often, "ref", "left_anti").select(*open_refs.columns)
        life = life.join(often, "ref", "left_anti").select(*life.columns)

    always = ext.select("ref", F.lit(None).cast("timestamp").alias("gone"), F.lit(None).cast("timestamp").alias("born"), F.lit(True).alias("always"))
    spans = life.select("ref", "gone", "born", F.lit(False).alias("always")).unionByName(always)
    # One array of spans for each id keeps the join one to one; it is as long as the id has removals.
    spans = spans.groupBy("ref").agg(F.collect_list(F.struct("born", "gone", "always")).alias("spans"))

    sample = references(relationships.sample(HOT_SAMPLE, seed=1)).groupBy("ref").agg(F.count("*").alias("n"))
    total = sample.agg(F.sum("n")).scalar()
    hot = sample.filter((F.col("n") >= 100) & (F.col("n") > HOT_SHARE * total)).select("ref", F.lit(True).alias("hot"))
    # At most 1 / HOT_SHARE ids pass the filter, so this table may be broadcast whatever the input.
    left = open_refs.join(F.broadcast(hot), "ref", "left").withColumn(
        "salt", F.when(F.col("hot"), F.pmod(F.xxhash64("relationship_id", "side"), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    )
    right = spans.join(F.broadcast(hot), "ref", "left").withColumn(
        "salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))
    )
    joined = left.drop("hot").join(right.drop("hot"), ["ref", "salt"], "left")
    holds = F.exists(
        "spans",
        lambda x: x.always | F.col("at").isNull() | ((x.born <= F.col("at")) & (x.gone.isNull() | (x.gone > F.col("at")))),
    )
    gone = joined.filter(~F.coalesce(holds, F.lit(False))).select("relationship_id", "side", "at")
    found = sure.unionByName(gone)
    return found if extra is None else found.unionByName(extra)


def orphan_rows(*tables: DataFrame) -> DataFrame:
    """Distinct (relationship_id, side)."""
    return orphans(*tables).select("relationship_id", "side").distinct()


def orphan_report(relationships: DataFrame, *rest: DataFrame) -> DataFrame:
    """(side, month, orphans): per side and month of created_at; month null where the time is."""
    o = orphans(relationships, *rest).distinct()
    return (
        o.groupBy("side", F.date_format("at", "yyyy-MM").alias("month"))
        .agg(F.count("*").alias("orphans"))
    )
