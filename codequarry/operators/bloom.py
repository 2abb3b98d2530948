"""A Bloom filter made and probed by Spark expressions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bound of the filter: 2**26 bits are 8 MiB, whatever the number of keys.
MAX_BITS = 1 << 26
HASHES = 5


def filter_bits(keys: int, bits_per_key: int = 12, max_bits: int = MAX_BITS) -> int:
    """A power of two of about bits_per_key for each key, at least 2**10 and at most max_bits."""
    return min(max_bits, max(1 << 10, 1 << math.ceil(math.log2(max(1, keys * bits_per_key)))))


def hashed(df: DataFrame, key: str) -> DataFrame:
    """With the two hashes of the key, of 31 bits so that sums never overflow under ANSI rules."""
    low = F.lit((1 << 31) - 1)
    return df.withColumns({
        "_a": F.xxhash64(key).bitwiseAND(low),
        "_b": F.xxhash64(key, F.lit(1)).bitwiseOR(F.lit(1)).bitwiseAND(low),
    })


def _position(i: int, bits: int) -> Column:
    return (F.col("_a") + F.col("_b") * F.lit(i)).bitwiseAND(F.lit(bits - 1))


def build(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """One row with `words`, the array of bits / 64 longs.

    Each map task ORs its own words before the shuffle, so at most bits / 64 rows leave a
    task; the array is bounded by MAX_BITS and not by the number of keys.
    """
    p = hashed(keys.select(key), key).select(F.explode(F.array(*[_position(i, bits) for i in range(HASHES)])).alias("p"))
    words = p.groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v")
    )
    every = keys.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("w"))
    full = every.join(words, "w", "left").select("w", F.coalesce("v", F.lit(0).cast("long")).alias("v"))
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "v"))), lambda x: x.v).alias("words"))


def might_contain(words: Column, bits: int) -> Column:
    """For rows of `hashed`: false only where the key was certainly never added."""
    hit = F.lit(True)
    for i in range(HASHES):
        p = _position(i, bits)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)).cast("int"))
        hit = hit & (F.get(words, F.shiftright(p, 6).cast("int")).bitwiseAND(bit) != 0)
    return hit
