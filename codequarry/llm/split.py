"""Splitting oversized texts at natural boundaries (problem 10).

Method: recursive bisection. A text beyond the limit is cut at the strongest boundary near its
middle - blank line, line end, sentence end, clause, blank, any character - and halves beyond
the limit less the overlap are cut again; then each piece but the first gets the last tokens
before it as overlap. Cuts lie between tokens, where both sides keep their tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm import batches, tokens

LIMIT, OVERLAP = 1000, 50


def strengths(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How natural a cut before each byte offset is: 5 blank line, 4 line end, 3 sentence end,
    2 clause, 1 blank, 0 within a word, -1 within a character."""
    size = len(data)
    get = lambda p: np.where((p >= 0) & (p < size), data[np.clip(p, 0, max(size - 1, 0))], 0)
    p1, p2, p3, nx = get(at - 1), get(at - 2), get(at - 3), get(at)
    blank = lambda x: (x == 32) | (x == 9) | (x == 13)
    out = np.zeros(len(at), dtype=np.int8)
    out[(nx & 0xC0) == 0x80] = -1
    word = blank(nx) | blank(p1) | (nx == 10)
    cjk = (p3 == 0xE3) & (p2 == 0x80)
    full = (p3 == 0xEF) & (p2 == 0xBC)
    end = (p1 == 46) | (p1 == 33) | (p1 == 63)
    end2 = ((p2 == 46) | (p2 == 33) | (p2 == 63)) & blank(p1)
    clause = (p1 == 44) | (p1 == 59) | (p1 == 58)
    out = np.where((out == 0) & word, 1, out)
    out = np.where((out >= 1) & clause, 2, out)
    out = np.where((out >= 0) & ((cjk & (p1 == 0x81)) | (full & ((p1 == 0x8C) | (p1 == 0x9B) | (p1 == 0x9A)))), 2, out)
    out = np.where((out >= 1) & end, 3, out)
    out = np.where((out >= 1) & end2, 3, out)
    out = np.where((out >= 0) & ((cjk & (p1 == 0x82)) | (full & ((p1 == 0x81) | (p1 == 0x9F)))), 3, out)
    out = np.where((out >= 0) & (p1 == 10), 4, out)
    return np.where((out == 4) & ((p2 == 10) | ((p2 == 13) & (p3 == 10))), 5, out)


def bisect(strength: np.ndarray, n: int, most: int) -> list[int]:
    """Cut positions that leave segments of at most `most` tokens; strength[i] is for a cut before token i."""
    cuts: list[int] = []
    todo = [(0, n)]
    while todo:
        a, b = todo.pop()
        size = b - a
        if size <= most:
            continue
        mid, reach = (a + b) // 2, max(1, size // 4)
        lo, hi = max(a + 1, mid - reach), min(b - 1, mid + reach) + 1
        s = strength[lo:hi]
        best = s.max()
        if best < 0:
            # No character begins near the middle; look everywhere.
            lo, hi = a + 1, b
            s = strength[lo:hi]
            best = s.max()
        where = np.flatnonzero(s == best) + lo
        cut = int(where[np.argmin(np.abs(where - mid))])
        cuts.append(cut)
        todo += [(a, cut), (cut, b)]
    return sorted(cuts)


def pieces(text: str, path: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[str, int, int]]:
    """(piece, tokens, tokens of overlap at its begin); the text itself where it is short enough.

    The overlap begins at the first character at or after the 50th token back, so it is a
    token or so shorter where that token begins within a character.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    raw = text.encode("utf-8", "replace")
    if len(raw) <= limit:
        # A token has at least one byte, so such a text is never too long.
        return [(text, -1, 0)]
    enc, size = tokens.encoding(path)
    ids = np.asarray(enc.encode_ordinary(text), dtype=np.int64)
    if len(ids) <= limit:
        return [(text, len(ids), 0)]
    ends = np.cumsum(size[ids])
    starts = ends - size[ids]
    data = np.frombuffer(raw, dtype=np.uint8)
    strength = strengths(data, starts)
    cuts = [0, *bisect(strength, len(ids), limit - overlap), len(ids)]
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        first = a
        if a:
            first = max(0, a - overlap)
            while first < a and strength[first] < 0:
                first += 1
        out.append((raw[starts[first] : ends[b - 1]].decode("utf-8", "replace"), b - first, a - first))
    return out


_SCHEMA = "doc_id bigint, piece_no int, pieces int, tokens int, overlap int, text string"


def split_documents(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str | None = None, only_split: bool = False) -> DataFrame:
    """(doc_id, piece_no, pieces, tokens, overlap, text): pieces of at most `limit` tokens.

    Texts within the limit come out whole as piece 0 (tokens -1 where their bytes alone prove
    it), or not at all with only_split; null texts give none, empty ones one empty piece.
    """
    path = vocabulary or tokens.vocabulary()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for piece in batches.pieces(batch, "text"):
                rows = []
                for key, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), strict=True):
                    if text is None:
                        continue
                    parts = pieces(text, path, limit, overlap)
                    if len(parts) > 1 or not only_split:
                        rows += [(key, i, len(parts), n, o, t) for i, (t, n, o) in enumerate(parts)]
                if rows:
                    c = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[0], pa.int64()), *(pa.array(c[k], pa.int32()) for k in (1, 2, 3, 4)), pa.array(c[5], pa.string())],
                        names=["doc_id", "piece_no", "pieces", "tokens", "overlap", "text"],
                    )

    return documents.select("doc_id", "text").mapInArrow(run, _SCHEMA)


def oversized(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str | None = None) -> DataFrame:
    """(doc_id): texts that were cut."""
    return split_documents(documents, limit, overlap, vocabulary, only_split=True).filter(F.col("pieces") > 1).select("doc_id").distinct()
