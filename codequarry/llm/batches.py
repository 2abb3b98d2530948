"""Record batches cut into pieces of bounded size, by language of the file name."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from codequarry.llm import lexmask

#: Bytes of text that are worked on at once; a longer text is a piece of its own.
PIECE = 2 << 20


def pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about PIECE bytes of that column each."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = np.cumsum(size)
    begin = 0
    while begin < batch.num_rows:
        base = at[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(at, base + PIECE, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def by_language(batch: pa.RecordBatch, path: str, column: str) -> Iterator[tuple[str, np.ndarray, pa.Array, pa.RecordBatch]]:
    """(language, row numbers in the piece, texts, piece)."""
    for piece in pieces(batch, column):
        langs = np.array([lexmask.language_of(p) for p in piece.column(path).to_pylist()], dtype=object)
        for lang in dict.fromkeys(langs.tolist()):
            rows = np.flatnonzero(langs == lang)
            yield lang, rows, piece.column(column).take(pa.array(rows)), piece
