"""Mixing sources to target weights (problem 9).

Method: Efraimidis-Spirakis sampling. Each record gets the key E / w with E exponential from a
hash of its id and w its quality; within a source records are taken by rising key until the
token budget is used, after as many complete epochs as fit. A record beyond what is left of the
budget is passed over and the prefix sum goes on behind it with those that still fit, until the
rest is negligible. Where a prefix sum crosses the budget is found by sums of key ranges, split
again until a range is small, so no task ever holds a whole source.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm import batches, lexmask, tokens
from codequarry.session import checkpoint

#: Key ranges into which a source, or the range that is cut, is split at once.
RANGES = 1024
#: Records of one source that may be summed one by one in a task.
SMALL = 20_000
#: Share of a source's budget that may be left over though records would still fit.
SLACK = 0.001


def _counts(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True values of each stretch of a mask, by blocks of 256, so that no running total of every byte is made."""
    tail = -len(mask) % 256
    blocks = np.append(0, np.cumsum(np.count_nonzero(np.append(mask, np.zeros(tail, dtype=bool)).reshape(-1, 256), axis=1)))
    before = lambda at: blocks[at // 256] + np.array([np.count_nonzero(mask[x - x % 256 : x]) for x in at.tolist()])
    return before(ends) - before(starts) if len(starts) else np.zeros(0)


def _once(text: str) -> float:
    """The share of lines that are not empty and stand only once, or for the first time."""
    rows = text.split("\n")
    n = len(rows) - rows.count("")
    return (len(set(rows)) - (n < len(rows))) / n if n else 1.0


def quality(texts: pa.Array) -> np.ndarray:
    """A weight from 0.05 to 1 for each text: the product of its share of letters and digits, of how near the mean
    length of its words is to that of running text, of its lines that stand only once, and of a
    discount for very short texts. Texts without spaces between words (Chinese, Japanese) are
    not judged by word length."""
    data, starts, ends = lexmask.buffers(texts)
    high = data >= 0x80
    good = ((data >= 48) & (data <= 57)) | ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122)) | high
    space = (data == 32) | ((data >= 9) & (data <= 13))
    size = np.maximum(ends - starts, 1)
    share, blank, wide = (_counts(m, starts, ends) / size for m in (good, space, high))
    word = (1 - blank) * size / np.maximum(blank * size, 1)
    fit = np.where(wide > 0.5, 1.0, np.exp(-np.square(np.log(np.maximum(word, 1) / 5.5)) / 2))
    once = np.array([_once(t) if t else 1.0 for t in texts.to_pylist()], dtype=float)
    return np.clip(np.minimum(1.0, share / 0.8) * np.maximum(fit, 0.2) * once * (0.5 + 0.5 * np.minimum(1.0, size / 400)), 0.05, 1.0)


def sized(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, tokens, weight): texts with at least one token; sources trimmed, in lower case."""
    path = vocabulary or tokens.vocabulary()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = tokens.encoding(path)
        for batch in it:
            for piece in batches.pieces(batch, "text"):
                texts = piece.column("text")
                n = [len(enc.encode_ordinary(t)) if t else 0 for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("source"), pa.array(n, pa.int64()), pa.array(quality(texts).astype(float))],
                    names=["doc_id", "source", "tokens", "weight"],
                )

    source = F.lower(F.regexp_replace("source", r"(?U)^\s+|\s+$", ""))
    return (
        documents.select("doc_id", F.nullif(source, F.lit("")).alias("source"), "text")
        .mapInArrow(run, "doc_id bigint, source string, tokens bigint, weight double")
        .filter("tokens > 0 and source is not null")
    )


def _key(seed: int) -> Column:
    """E / w: the uniform number comes from the id, so a run can be repeated at any partitioning."""
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / F.col("weight")


def plan(records: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, docs, have, budget, epochs, rest): what to take of each source.

    Without total_tokens the total is the largest at which every source reaches its share
    within its repeats; with it each source is cut at its repeats. Sources without records have
    budget 0 and do not bound the total.
    """
    have = records.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("have"))
    t = targets.select(F.lower(F.trim("source")).alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("bigint"))
    t = t.filter("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    x = t.join(have, "source", "left").fillna(0, ["docs", "have"])
    most = F.when(F.col("have") > 0, F.col("have") * F.col("max_repeats") / F.col("target_share"))
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.coalesce(F.min(most).over(Window.partitionBy()), F.lit(0.0))
    x = x.withColumn("budget", F.floor(F.least(F.col("target_share") * total + 1e-6, (F.col("have") * F.col("max_repeats")).cast("double"))))
    epochs = F.when(F.col("have") > 0, F.least(F.floor(F.col("budget") / F.col("have")), F.col("max_repeats"))).otherwise(F.lit(0))
    return x.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("have"))


@dataclass
class _Fill:
    """What is still to be taken of a source, and the stretches of keys that were taken."""

    source: str
    rest: float
    slack: float
    docs: int
    #: Key and id of the record passed over last, and where the search for the next begins.
    after: tuple[float, int] = (-1.0, 0)
    lo: float = 0.0
    hi: float = 2.0
    #: (key and id after which, key and id before which, tokens up to which) records are taken.
    taken: list[tuple[float, int, float, int, float]] = field(default_factory=list)


def _eligible(records: DataFrame, fills: list[_Fill]) -> DataFrame:
    """Records behind those passed over that may still fit, by place in [lo, hi)."""
    rows = [(f.source, float(f.rest), *f.after, f.lo, f.hi) for f in fills]
    state = records.sparkSession.createDataFrame(rows, "source string, rest double, ak double, ad bigint, lo double, hi double")
    # One row for each source that a user lists.
    x = records.join(F.broadcast(state), "source").filter("place >= lo and place < hi and tokens <= rest")
    return x.filter("key > ak or (key = ak and doc_id > ad)")


def _leap(records: DataFrame, fills: list[_Fill]) -> dict[str, float]:
    """Tokens of the ranges of keys that fit as a whole; lo moves behind them, to a small range in which the rest is used up."""
    base = {f.source: 0.0 for f in fills}
    todo = [f for f in fills if f.docs > SMALL]
    while todo:
        bins = _eligible(records, todo).withColumn("bin", F.least(F.floor((F.col("place") - F.col("lo")) / (F.col("hi") - F.col("lo")) * RANGES), F.lit(RANGES - 1)))
        sums: dict[str, list] = {}
        # At most RANGES rows for each source.
        for r in bins.groupBy("source", "bin").agg(F.sum("tokens").alias("n"), F.count("*").alias("docs")).collect():
            sums.setdefault(r.source, []).append((r.bin, r.n, r.docs))
        again = []
        for f in todo:
            width = (f.hi - f.lo) / RANGES
            at = f.hi
            for i, n, docs in sorted(sums.get(f.source, [])):
                if base[f.source] + n > f.rest:
                    at = f.lo + i * width
                    if docs > SMALL and width > 1e-14:
                        again.append(f)
                    break
                base[f.source] += n
            f.lo, f.hi = at, at + width
        todo = again
    return base


_STRETCH = "source string, ak double, ad bigint, ck double, cd bigint, most double, rest double"


def _greedy(base: dict[str, float], fills: dict[str, _Fill]):
    """Take records by rising key as long as they fit; a stretch ends at each that does not."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = fills[pdf["source"].iloc[0]]
        pdf = pdf.sort_values(["key", "doc_id"])
        (ak, ad), most = f.after, float(f.rest)
        rest = most - base[f.source]
        out = []
        for key, doc, n in zip(pdf["key"], pdf["doc_id"], pdf["tokens"], strict=True):
            if n <= rest:
                rest -= n
            else:
                out.append((f.source, ak, ad, key, doc, most, rest))
                ak, ad, most = key, doc, rest
            if rest <= f.slack:
                break
        last = pdf.iloc[-1] if len(pdf) >= SMALL and rest > f.slack else None
        # The stretch that is open ends behind the last record that was looked at.
        end = (float("inf"), 0) if last is None and rest > f.slack else (key, doc + 1)
        out.append((f.source, ak, ad, *end, most, rest))
        return pd.DataFrame(out, columns=["source", "ak", "ad", "ck", "cd", "most", "rest"])

    return run


def _fill(records: DataFrame, fills: list[_Fill]) -> None:
    """Take records of each source by rising key, passing over those that do not fit, until the rest is negligible."""
    fills = [f for f in fills if f.rest > f.slack]
    while fills:
        for f in fills:
            f.lo, f.hi = 0.0, 2.0
        base = _leap(records, fills)
        for f in fills:
            f.hi = 2.0
        # Records delivered twice have one key; they fit or are passed over together.
        one = _eligible(records, fills).groupBy("source", "key", "doc_id").agg(F.sum("tokens").alias("tokens"))
        first = one.withColumn("_k", F.row_number().over(Window.partitionBy("source").orderBy("key", "doc_id"))).filter(F.col("_k") <= SMALL).drop("_k")
        got: dict[str, list] = {}
        for r in first.groupBy("source").applyInPandas(_greedy(base, {f.source: f for f in fills}), _STRETCH).collect():
            got.setdefault(r.source, []).append(r)
        more = []
        for f in fills:
            rows = sorted(got.get(f.source, []), key=lambda r: (r.ak, r.ad))
            if not rows:
                # All that is eligible lies before lo and fits.
                f.taken.append((*f.after, float("inf"), 0, float(f.rest)))
                f.rest -= base[f.source]
                continue
            f.taken += [(r.ak, r.ad, r.ck, r.cd, r.most) for r in rows]
            f.rest = rows[-1].rest
            if f.rest > f.slack and rows[-1].ck != float("inf"):
                f.after = (rows[-1].ck, rows[-1].cd - 1)
                more.append(f)
        fills = more


def _marked(records: DataFrame, fills: list[_Fill]) -> DataFrame:
    """records with _s, null where they were not taken."""
    runs = records.sparkSession.createDataFrame([(f.source, *t) for f in fills for t in f.taken], "_s string, ak double, ad bigint, ck double, cd bigint, most double")
    above = (F.col("key") > F.col("ak")) | ((F.col("key") == F.col("ak")) & (F.col("doc_id") > F.col("ad")))
    below = (F.col("key") < F.col("ck")) | ((F.col("key") == F.col("ck")) & (F.col("doc_id") < F.col("cd")))
    # The stretches of a source do not overlap, so no record is multiplied.
    return records.join(F.broadcast(runs), (F.col("source") == F.col("_s")) & above & below & (F.col("tokens") <= F.col("most")), "left")


def mix(documents: DataFrame, targets: DataFrame, seed: int = 1, total_tokens: int | None = None, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, tokens, copies): the chosen records, copies from 1 to max_repeats.

    Records without a source, of a source without a target, without a doc_id or without a
    token are never chosen. A doc_id delivered twice counts as two records with one key. A
    source misses its budget by at most SLACK of it or half of the smallest record that is left.
    """
    # The wanted mixture has one row for each source that a user lists; it is small by its nature.
    records = checkpoint(
        sized(documents, vocabulary).filter("doc_id is not null")
        .join(F.broadcast(targets.select(F.lower(F.trim("source")).alias("source")).distinct()), "source", "left_semi")
        .withColumn("key", _key(seed))
        # A monotone map of the key to 0 to 1.
        .withColumn("place", 1 - F.exp(-F.col("key") * 0.6))
    )
    todo = plan(records, targets, total_tokens).select("source", "epochs", "rest", "max_repeats", "budget", "docs").collect()
    fills = [_Fill(r.source, float(r.rest), SLACK * float(r.budget), r.docs) for r in todo if r.docs and r.epochs < r.max_repeats]
    _fill(records, fills)
    spark = documents.sparkSession
    epochs = spark.createDataFrame([(r.source, int(r.epochs), int(r.max_repeats)) for r in todo], "source string, epochs bigint, max_repeats bigint")
    # Nothing that fits is left; the smallest record beyond is taken where its excess is less than the rest.
    left = spark.createDataFrame([(f.source, float(f.rest)) for f in fills if f.rest > f.slack], "source string, rest double")
    near = _marked(records, fills).filter("_s is null").join(F.broadcast(left), "source").filter("tokens < 2 * rest")
    last = near.groupBy("source").agg(F.min(F.struct("tokens", "key", "doc_id")).alias("at")).collect()
    for r in last:
        f = next(f for f in fills if f.source == r.source)
        f.taken.append((r["at"].key, r["at"].doc_id - 1, r["at"].key, r["at"].doc_id + 1, float(r["at"].tokens)))
    x = _marked(records, fills).join(F.broadcast(epochs), "source")
    copies = F.least(F.col("epochs") + F.col("_s").isNotNull().cast("bigint"), F.col("max_repeats")).cast("int")
    return x.select("doc_id", "source", "tokens", copies.alias("copies")).filter("copies > 0")


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, docs, copies, tokens, actual_share) of a mixture."""
    got = chosen.groupBy("source").agg(F.count("*").alias("docs"), F.sum("copies").alias("copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    t = targets.select(F.lower(F.trim("source")).alias("source"), "target_share")
    x = t.join(got, "source", "left").fillna(0, ["docs", "copies", "tokens"])
    total = F.sum("tokens").over(Window.partitionBy())
    return x.withColumn("actual_share", F.round(F.col("tokens") / F.nullif(total, F.lit(0)), 6))
