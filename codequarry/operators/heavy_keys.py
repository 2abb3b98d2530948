"""Per-key results where a few keys hold most rows (problem 4).

Method: map-side combining. Every map task keeps the states of its keys in Spark's hash
aggregate, which spills and merges them by itself; what is shuffled are partial states only.
Heavy pairs are found in two passes: bounded hash tables of counters (a frequent-items sketch,
one for each task, merged) name the few pairs that can be heavy, then these alone are counted
exactly, so that a task sends no more than one row for each of them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions.ids import clean_id

#: Counters that a sketch may hold at most; below a share of 16 / MAX_COUNTERS all pairs are counted.
MAX_COUNTERS = 1_000_000


def pair_rows(relationships: DataFrame) -> DataFrame:
    """(target_id, type, source_id, confidence) of rows that belong to a pair, ids trimmed and composed."""
    r = relationships.select("target_id", "type", "source_id", "confidence")
    r = r.select(clean_id(F.col("target_id")).alias("target_id"), "type", clean_id(F.col("source_id")).alias("source_id"), "confidence")
    return r.filter("target_id is not null")


def stats_of(rows: DataFrame) -> DataFrame:
    """The states by (target, type, source) first, which spreads a hot pair over all tasks, then by pair.

    An exact number of sources needs each of them once, so the first states are as many as the
    distinct triples, whatever the aggregate.
    """
    fine = rows.groupBy("target_id", "type", "source_id").agg(
        F.count("*").alias("n"), F.sum("confidence").alias("c"), F.count("confidence").alias("nc")
    )
    return fine.groupBy("target_id", "type").agg(
        F.sum("n").alias("n_rows"),
        F.count("source_id").alias("n_sources"),
        F.round(F.sum("c") / F.nullif(F.sum("nc"), F.lit(0)), 6).alias("mean_confidence"),
    )


def pair_stats(relationships: DataFrame) -> DataFrame:
    """(target_id, type, n_rows, n_sources, mean_confidence) for each pair.

    Ids are trimmed and composed; rows whose target is null or blank belong to no pair. A
    null type is a type of its own, a null or blank source is no source, a null confidence
    does not count in the mean (null where there is none). Every delivered row counts.
    """
    return stats_of(pair_rows(relationships))


def _pair(df: DataFrame) -> DataFrame:
    return df.withColumn("_pair", F.xxhash64("target_id", "type"))


def candidates(rows: DataFrame, share: float) -> DataFrame | None:
    """(_pair): hashes of at most 2 / share + 1 pairs, among them each with that share of rows; None where no sketch is fine enough.

    With c counters the error of a count is below 3.5 / c of the rows, here less than a quarter of the share.
    """
    counters = max(1024, math.ceil(16 / share))
    if counters > MAX_COUNTERS:
        return None
    k = math.ceil(2 / share) + 1
    top = _pair(rows).agg(F.expr(f"approx_top_k(_pair, {k}, {counters})").alias("top"))
    return top.select(F.explode(F.transform("top", lambda x: x["item"])).alias("_pair"))


def heavy_rows(relationships: DataFrame, share: float) -> DataFrame:
    """The rows of the pairs that may hold that share of all rows."""
    rows = pair_rows(relationships)
    few = candidates(rows, share)
    # At most 2 / share + 1 rows, whatever the input.
    return rows if few is None else _pair(rows).join(F.broadcast(few), "_pair", "left_semi").drop("_pair")


def heavy_counts(relationships: DataFrame, share: float = 0.02) -> DataFrame:
    """(target_id, type, n_rows) of pairs with at least that share of all rows, counted exactly."""
    total = relationships.agg(F.count("*").alias("n")).scalar()
    n = heavy_rows(relationships, share).groupBy("target_id", "type").agg(F.count("*").alias("n_rows"))
    return n.filter(F.col("n_rows") >= F.lit(share) * total)


def heavy_pairs(relationships: DataFrame, share: float = 0.02) -> DataFrame:
    """(target_id, type, n_rows, n_sources, mean_confidence) of pairs with at least that share of all rows."""
    total = relationships.agg(F.count("*").alias("n")).scalar()
    return stats_of(heavy_rows(relationships, share)).filter(F.col("n_rows") >= F.lit(share) * total)
