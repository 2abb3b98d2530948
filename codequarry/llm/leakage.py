"""Evaluation texts in training text (problem 8).

Method: a distributed positional inverted index. The training text is cut into segments of
bounded size; for each term of a segment the index stores one list of token positions, as a
table that is partitioned by term, a term's lists spread over several files. A search finds, for
each window of a test item, its rarest terms in the whole index, joins these with the index, and
only where such a term has postings intersects the lists of the other terms, shifted by their
offsets, rarest first. Whole windows are exact phrase matches; windows of which most terms stand
within a few words of their places are proximity matches. Neither items nor postings pass
through the driver, and a segment is the largest group that a task holds.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.session import remove_at_end, shared_folder

WORDS = 12
#: Bytes of training text of a segment; a longer text is a segment of its own.
SEGMENT = 4 << 20
#: Positions left free between the texts of a segment, so that no window reaches over.
GAP = 64
#: Text of test items that meets a segment in one task; more items are spread over several.
BLOCK_BYTES = 16 << 20
#: Tasks over which the lists of one term are spread when the index is written.
SPREAD = 8
#: Candidates that are looked at in one step.
STEP = 1 << 20
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits after NFKC normalisation and case folding."""
    if not text.isascii():
        # Folding can undo the normal form, so it is made again.
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
        return _WORD.findall(text)
    return _WORD.findall(text.lower())


def pack(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising lists of numbers as variable-length bytes of their differences: (bytes, bounds of the lists)."""
    d = np.diff(values, prepend=0)
    d[begin] = values[begin]
    size = np.ones(len(d), dtype=np.int64)
    for bits in (7, 14, 21, 28):
        size += d >= 1 << bits
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    for k in range(int(size.max(initial=0))):
        on = size > k
        out[at[on] + k] = ((d[on] >> (7 * k)) & 127) | np.where(size[on] > k + 1, 128, 0)
    return out, np.append(at[begin], len(out))


def unpack(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values of all lists, number of values of each list)."""
    ends = np.flatnonzero(data < 128) + 1
    if not len(ends):
        return np.zeros(0, dtype=np.int64), np.zeros(len(bounds) - 1, dtype=np.int64)
    begins = np.append(0, ends[:-1])
    shift = 7 * (np.arange(len(data)) - np.repeat(begins, ends - begins))
    d = np.add.reduceat((data & 127).astype(np.int64) << shift, begins)
    counts = np.searchsorted(ends, bounds[1:], side="right") - np.searchsorted(ends, bounds[:-1], side="right")
    first = np.cumsum(counts) - counts
    total = np.cumsum(d)
    some = counts > 0
    return total - np.repeat((total - d)[first[some]], counts[some]), counts


_INDEX = "term string, segment bigint, n bigint, postings binary, doc_ids array<bigint>"


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])


def segment_rows(ids: list[int | None], texts: list[str | None], segment: int) -> pa.RecordBatch:
    """The index of one segment: a row for each term, and one without term that tells the documents."""
    lists = [words(t) if t else [] for t in texts]
    sizes = np.array([len(w) for w in lists], dtype=np.int64)
    before = np.cumsum(sizes) - sizes
    begin = before + GAP * (np.arange(len(sizes)) + 1)
    coded = pa.array([w for x in lists for w in x], pa.string()).dictionary_encode()
    code = np.asarray(coded.indices)
    place = np.arange(len(code)) + np.repeat(begin - before, sizes)
    order = np.argsort(code, kind="stable")
    n = np.bincount(code, minlength=len(coded.dictionary)).astype(np.int64)
    data, bounds = pack(place[order], np.cumsum(n) - n)
    head, head_bounds = pack(begin, np.zeros(min(1, len(begin)), dtype=np.int64))
    k = len(coded.dictionary)
    length = int(sizes.sum()) + GAP * (len(sizes) + 1)
    return pa.RecordBatch.from_arrays(
        [
            pa.concat_arrays([pa.nulls(1, pa.string()), coded.dictionary]), pa.array(np.full(k + 1, segment)), pa.array(np.append(length, n)),
            pa.concat_arrays([_binary(head, head_bounds), _binary(data, bounds)]), pa.array([ids, *[None] * k], pa.list_(pa.int64())),
        ],
        names=["term", "segment", "n", "postings", "doc_ids"],
    )


def _segments(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list[int | None] = []
    texts: list[str] = []
    size, number = 0, TaskContext.get().partitionId() << 32
    for batch in it:
        for key, text, n in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), pc.binary_length(batch.column("text")).to_pylist(), strict=True):
            if ids and size + n > SEGMENT:
                yield segment_rows(ids, texts, number)
                ids, texts, size, number = [], [], 0, number + 1
            ids.append(key)
            texts.append(text)
            size += n
    if ids:
        yield segment_rows(ids, texts, number)


@dataclass(frozen=True)
class Index:
    """A stored index: its folder and the number of parts by which terms were dealt out."""

    folder: str
    parts: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_INDEX + ", part int").parquet(self.folder)


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce("term", F.lit(""))), F.lit(parts)).cast("int").alias("part")


def build_index(documents: DataFrame, folder: str | None = None, parts: int | None = None) -> Index:
    """Write the positional index of documents(doc_id, text).

    Rows are (term, segment, n, postings) in folders by the term's hash, and for each segment
    one row without term with its doc_ids and their first positions. Null and empty texts have
    no postings. Without a folder the index lies in the shared folder of intermediate tables
    and is removed when the session ends. `parts` follows the number of shuffle partitions.
    """
    spark = documents.sparkSession
    if folder is None:
        folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        remove_at_end(spark, folder)
    parts = parts or max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
    rows = documents.select("doc_id", "text").filter("text <> ''").mapInArrow(_segments, _INDEX).select("*", _part(parts))
    spread = F.pmod(F.xxhash64("segment"), F.lit(SPREAD))
    rows.repartition("part", spread).sortWithinPartitions("part", "term", "segment").write.mode("overwrite").option("compression", "zstd").partitionBy("part").parquet(folder)
    return Index(folder, parts)


def _windows(items: DataFrame, counts: DataFrame, n: int, least: int) -> DataFrame:
    """(item, term, s, k): for each window with at least `least` terms in the index its anchors, the rarest
    of those, k words after its begin s. A match has `least` of the n terms, so it has one of the
    n - least + 1 rarest, of which those without postings need not be looked at."""
    t = items.select("item", F.posexplode("terms").alias("pos", "term")).join(counts, "term", "left")
    ahead = Window.partitionBy("item").orderBy("pos").rowsBetween(0, n - 1)
    w = t.withColumn("_w", F.collect_list(F.struct("df", "pos", "term")).over(ahead)).filter(F.size("_w") == n)
    present = F.array_sort(F.filter("_w", lambda x: x.df.isNotNull()))
    w = w.select("item", F.col("pos").alias("s"), present.alias("_p")).filter(F.size("_p") >= least)
    anchors = F.slice("_p", F.lit(1), F.size("_p") - least + 1)
    return w.select("item", "s", F.explode(anchors).alias("a")).select("item", F.col("a.term").alias("term"), "s", (F.col("a.pos") - F.col("s")).alias("k"))


def _lists(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """(all values, bounds) of a list column."""
    a = column.combine_chunks()
    n = np.asarray(pc.fill_null(pc.list_value_length(a), 0)).astype(np.int64)
    return pc.list_flatten(a), np.append(0, np.cumsum(n))


def intersect(left: pa.Table, right: pa.Table, n: int, slop: int, least: int) -> pa.Table:
    """(item_id, doc_id, terms) of one segment. left: item_id, terms and anchors(s, k) of items with an anchor
    there; right: the segment's index rows of the items' terms and its row without term."""
    rows: list[list] = [[], [], []]
    head = right.filter(pc.is_null(right["term"]))
    right = right.filter(pc.is_valid(right["term"]))
    if head.num_rows and right.num_rows and left.num_rows:
        ids = head["doc_ids"].combine_chunks().flatten()
        raw = np.frombuffer(head["postings"][0].as_py(), dtype=np.uint8)
        doc_begin = unpack(raw, np.array([0, len(raw)]))[0]
        blobs = right["postings"].combine_chunks()
        bounds = np.append(0, np.cumsum(np.asarray(pc.binary_length(blobs)).astype(np.int64)))
        postings, df = unpack(np.frombuffer(b"".join(blobs.to_pylist()), dtype=np.uint8), bounds)
        begin = np.append(0, np.cumsum(df))
        stream = np.full(int(head["n"][0].as_py()) + 2 * GAP, -1, dtype=np.int64)
        stream[postings] = np.repeat(np.arange(len(df)), df)
        flat, at = _lists(left["terms"])
        terms = np.asarray(pc.fill_null(pc.index_in(flat, value_set=right["term"].combine_chunks()), -1)).astype(np.int64)
        pairs, pair_at = _lists(left["anchors"])
        row = np.repeat(np.arange(left.num_rows), np.diff(pair_at))
        win = at[row] + np.asarray(pairs.field("s")).astype(np.int64)
        off = np.asarray(pairs.field("k")).astype(np.int64)
        anchor = terms[win + off]
        grid = terms[win[:, None] + np.arange(n)]
        alive = (anchor >= 0) & ((grid >= 0).sum(axis=1) >= least)
        row, win, off, anchor, grid = row[alive], win[alive], off[alive], anchor[alive], grid[alive]
        order = np.argsort(np.where(grid >= 0, df[grid], np.iinfo(np.int64).max), axis=1, kind="stable")
        keys = left["item_id"].combine_chunks()
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
        whole = slop == 0 and least == n
        for part in _blocks(df[anchor], STEP):
            size = df[anchor[part]]
            w = np.repeat(part, size)
            step = np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size)
            place = postings[np.repeat(begin[anchor[part]], size) + step]
            start = place - off[w]
            if whole:
                for k in range(n):
                    if not len(w):
                        break
                    o = order[w, k]
                    keep = stream[start + o] == grid[w, o]
                    w, start, place = w[keep], start[keep], place[keep]
                met = np.full(len(w), n)
            else:
                met = np.zeros(len(w), dtype=np.int64)
                for k in range(n):
                    hit = np.zeros(len(w), dtype=bool)
                    for shift in range(-slop, slop + 1):
                        hit |= stream[start + k + shift] == grid[w, k]
                    met += hit & (grid[w, k] >= 0)
                keep = met >= least
                w, place, met = w[keep], place[keep], met[keep]
            doc = np.searchsorted(doc_begin, place, side="right") - 1
            found.append(_most(row[w] * len(ids) + doc, met))
        pair, met = _most(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
        rows = [keys.take(pa.array(pair // len(ids))), ids.take(pa.array(pair % len(ids))), met]
    return pa.table({"item_id": pa.array(rows[0], pa.int64()), "doc_id": pa.array(rows[1], pa.int64()), "terms": pa.array(rows[2], pa.int32())})


def _most(pair: np.ndarray, met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once, with its greatest number."""
    order = np.lexsort((-met, pair))
    pair, met = pair[order], met[order]
    first = np.append(True, pair[1:] != pair[:-1])[: len(pair)]
    return pair[first], met[first]


def _blocks(sizes: np.ndarray, block: int) -> Iterator[np.ndarray]:
    """Runs of windows with about `block` candidates each, so memory stays bounded."""
    at = np.cumsum(sizes)
    begin = 0
    while begin < len(sizes):
        base = at[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(at, base + block, side="right")))
        yield np.arange(begin, end)
        begin = end


def _item_terms(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        terms = [words(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(terms, pa.list_(pa.string()))], names=["item_id", "terms"])


def search(index: Index, benchmark: DataFrame, n: int = WORDS, slop: int = 0, least: int | None = None) -> DataFrame:
    """(item_id, doc_id, terms): documents of an index that hold a window of n words of an item, at least
    `least` of them, each at most `slop` words off its place; with the most words that were met.

    Items of fewer words, null and empty texts match nothing, and null item_ids are no items.
    """
    least = n if least is None else least
    if not 0 < least <= n or slop < 0 or n + slop > GAP:
        raise ValueError(f"wanted 0 < least <= n and n + slop <= {GAP}")
    spark = benchmark.sparkSession
    rows, parts = index.rows(spark), index.parts
    clean = benchmark.select("item_id", "text").filter("item_id is not null and text is not null").distinct()
    size = clean.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    items = clean.mapInArrow(_item_terms, "item_id bigint, terms array<string>").filter(F.size("terms") >= n).distinct()
    items = items.withColumn("item", F.sha2(F.concat_ws(" ", F.col("item_id").cast("string"), F.array_join("terms", " ")), 256))
    vocabulary = items.select(F.explode("terms").alias("term")).distinct().select("term", _part(parts))
    known = rows.filter("term is not null")
    counts = known.select("part", "term", "n").join(vocabulary, ["part", "term"]).groupBy("term").agg(F.sum("n").alias("df"))
    anchors = _windows(items, counts, n, least).select("*", _part(parts))
    places = anchors.join(known.select("part", "term", "segment"), ["part", "term"])
    places = places.groupBy("segment", "item").agg(F.collect_set(F.struct("s", "k")).alias("anchors"))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    left = places.join(items, "item").select("segment", block.alias("block"), "item_id", "terms", "anchors")
    lists = known.join(vocabulary, ["part", "term"], "left_semi").select("segment", "term", "n", "postings", "doc_ids")
    right = rows.filter("term is null").select(*lists.columns).unionByName(lists)
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return intersect(a, b, n, slop, least)

    found = left.groupBy("segment", "block").cogroup(right.groupBy("segment", "block")).applyInArrow(run, "item_id bigint, doc_id bigint, terms int")
    return found.groupBy("item_id", "doc_id").agg(F.max("terms").alias("terms"))


def leaks(documents: DataFrame, benchmark: DataFrame, n: int = WORDS) -> DataFrame:
    """(item_id, doc_id): item and document share at least n consecutive words.

    Items or documents of fewer words, empty and null texts match nothing; every document is
    searched for every item.
    """
    return search(build_index(documents), benchmark, n).select("item_id", "doc_id")


def near_leaks(documents: DataFrame, benchmark: DataFrame, n: int = WORDS, slop: int = 2, least: int = 10) -> DataFrame:
    """(item_id, doc_id, terms): proximity matches, with the most terms of a window that were met."""
    return search(build_index(documents), benchmark, n, slop, least)
