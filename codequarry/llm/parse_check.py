"""The operator of problem 7 on tables: validity of each file and rates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm import batches, parse


#: Extensions that are read for comments and strings like a language whose grammar is not theirs,
#: and those whose language has a part, JSX, that the grammars lack.
OTHER_GRAMMAR = ("kt", "scala")
WITH_JSX = ("jsx", "tsx")


def judge(paths: list[str | None], texts: pa.Array, lang: str) -> tuple[list[str], np.ndarray]:
    """Language, '' where a file is not judged, and validity of each file of one lexing language."""
    ext = np.array([(p or "").rpartition(".")[2].lower() for p in paths], dtype=object)
    judged = ~np.isin(ext, OTHER_GRAMMAR)
    ok = np.ones(len(ext), dtype=bool)
    at = np.flatnonzero(judged)
    if len(at):
        ok[at] = parse.valid(texts if len(at) == len(ext) else texts.take(pa.array(at)), lang)
    # The rejected ones may hold JSX.
    judged &= ok | ~np.isin(ext, WITH_JSX)
    return [lang if x else "" for x in judged.tolist()], ok | ~judged


def _run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for lang, rows, texts, piece in batches.by_language(batch, "file_path", "content"):
            at = pa.array(rows)
            langs, ok = judge(piece.column("file_path").take(at).to_pylist(), texts, lang)
            yield pa.RecordBatch.from_arrays(
                [piece.column("file_id").take(at), piece.column("repo_id").take(at), pa.array(langs, pa.string()), pa.array(ok)],
                names=["file_id", "repo_id", "language", "parses"],
            )


def parse_status(parse_results: DataFrame) -> DataFrame:
    """(file_id, repo_id, language, parses) for each delivered file.

    The extension of file_path decides the language; files of no supported language are not
    judged (language '') and count as parsing, and so do empty and null contents. Files of .jsx and
    .tsx that the grammars without JSX reject are not judged either. Rows delivered twice come
    out twice.
    """
    return parse_results.select("file_id", "repo_id", "file_path", "content").mapInArrow(
        _run, "file_id bigint, repo_id string, language string, parses boolean"
    )


def invalid_files(parse_results: DataFrame) -> DataFrame:
    return parse_status(parse_results).filter(~F.col("parses")).select("file_id").distinct()


def invalid_rates(parse_results: DataFrame) -> DataFrame:
    """(repo_id, language, files, invalid, rate) over distinct files; language '' where none is supported."""
    one = parse_status(parse_results).groupBy("file_id").agg(
        F.min("repo_id").alias("repo_id"), F.min("language").alias("language"), F.min("parses").alias("parses")
    )
    bad = F.count_if(~F.col("parses"))
    return one.groupBy("repo_id", "language").agg(
        F.count("*").alias("files"), bad.alias("invalid"), F.round(bad / F.count("*"), 6).alias("rate")
    )
