"""Functions paired with their documentation (problem 3).

Method: comment spans (and Python docstrings) and function spans are extracted independently;
an as-of join on (file, line) gives each function the nearest comment before it, and the
interval that the comment may document - the annotations and the statement that follow it
directly - rejects those with a statement or a blank line between.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.llm import batches, lexmask, natural

_LINE_MARK = re.compile(r"^\s*(?:[rRuUbB]{0,2}(?:\"\"\"|'''|\"|'))?\s*(?:/\*+!?|\*+/?|//+[/!]?|#+!?|--+)?\s?|\s*(?:\*+/|\"\"\"|''')\s*$")
#: Fixed patterns: directives for tools.
_DIRECTIVE = re.compile(
    r"^\s*(?:noqa\b|nolint\b|nosec\b|pylint\s*:|pragma\b|type:\s*ignore|mypy\s*:|flake8\s*:|fmt:|isort\s*:|yapf\s*:|eslint-|tslint:|jshint\b|istanbul\b|"
    r"prettier-|@?ts-|go:|\+build\b|checkstyle\s*:|spotless:|NOSONAR\b|noinspection\b|#?(?:end)?region\b\s*\w*$|clang-format\b|sonar\s*:|skipcq\b|[cv]8 ignore)", re.I)
_TODO = re.compile(r"^\s*(?:TODO|FIXME|XXX|TBD|HACK|WIP|待办|待补充)\b", re.I)
_TAG = re.compile(r"^\s*(?:[@\\]\w+(?:\s*\{[^}]*\})?(?:\s+[\[\]\w.$]+)?|:\w+(?:\s+[\w.]+)*\s*:|\{@\w+[^}]*\})\s*-?\s*")
#: Fixed patterns: sentences that only say that documentation is missing or still to come.
_MISSING = re.compile(
    r"(?i)(?:\b(?:documentation|docs|docstring|description)\b.{0,50}\b(?:missing|will (?:be )?(?:added|follow|come|written|provided)|to (?:be (?:added|written|done|provided)|come|follow)|coming|pending|absent|tbd)\b"
    r"|\b(?:write|add|insert|fill in|provide)\b.{0,30}\b(?:documentation|docs|docstring|description)\b.{0,40}\b(?:later|soon|here|todo)\b|\b(?:no|missing|lacks|without) (?:documentation|docs|docstring|description)\b"
    r"|\b(?:needs?|has|have|yet|still|remains?)\b.{0,20}\bto be (?:documented|described)\b|\bnot (?:yet )?(?:been )?documented\b|\bundocumented\b"
    r"|(?:dokumentation|beschreibung|doku)\b.{0,60}(?:fehlt|folgt|nachgereicht|nachgetragen|wird (?:später|spaeter|noch|bald))|noch (?:nicht )?(?:zu )?dokumentier|(?:muss|wird) (?:noch|später) (?:dokumentiert|beschrieben)"
    r"|(?:documentation|description)\b.{0,60}(?:manqu|à venir|a venir|plus tard|compléter|completer|bientôt|sera ajoutée)|(?:reste|doit) .{0,30}(?:documenter|documenté|décrire)"
    r"|(?:documentación|documentacion|descripción|descripcion)\b.{0,60}(?:falta|pendiente|tarde|pronto|añadir|completar)|(?:falta|pendiente).{0,30}(?:documenta|descri)"
    r"|(?:документац|описани)\w*.{0,60}(?:отсутств|позже|будет|добав|нужн|скоро)|(?:нужно|надо|ещё не) .{0,30}(?:документ|опис)"
    r"|(?:文档|说明|注释|描述).{0,20}(?:稍后|以后|待|补充|缺|尚未)|(?:待|稍后|尚未|需要).{0,10}(?:文档|说明|注释|描述|补充)"
    r"|(?:ドキュメント|説明|文書|コメント).{0,20}(?:後で|あとで|未|追加|ありません|予定)|(?:後で|あとで|未).{0,10}(?:ドキュメント|説明|記述|文書))")
#: Bytes that a comment has at least which is not trivial: five letters with four blanks and a mark.
SHORTEST = 10
#: Words of a sentence that only says that documentation is missing; a longer one says more than that.
MISSING_WORDS = 16
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s*")


def describe(doc: str | None) -> str:
    """The running text of a documentation; '' where it is trivial.

    Trivial are fewer than five words (eight Chinese or Japanese characters) besides marks,
    tags, directives, to-do notes, tables, rulers and commented-out code, and texts that only
    say that documentation is missing or to come.
    """
    if not doc:
        return ""
    kept: list[str] = []
    lines = doc.replace("\r", "").split("\n")
    for raw in lines:
        line = _LINE_MARK.sub("", _LINE_MARK.sub("", raw)).strip()
        if not line or _DIRECTIVE.match(line) or _TODO.match(line):
            continue
        line = _TAG.sub("", line).strip()
        if not line or "|" in line and natural.running(line) < natural.MIN_WORDS:
            continue
        if not natural.cjk(line) and not re.search(r"[^\W\d_]{2}", line):
            continue
        if natural.code_line(line) or natural._QUERY.match(line):
            continue
        kept.append(line)
    text = " ".join(kept)
    words = cjk = 0
    for sentence in _SENTENCE.split(text):
        if _MISSING.search(sentence) and len(sentence.split()) <= MISSING_WORDS:
            continue
        words += natural.running(sentence)
        cjk += natural.cjk(sentence)
    return text if words >= natural.MIN_WORDS or cjk >= natural.MIN_CJK else ""


@F.pandas_udf(T.StringType())
def describe_udf(docs: pd.Series) -> pd.Series:
    return docs.map(describe)


_DEF = re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+[^\s(\[]+\s*(?=[(\[])", re.M)
_BRACKET = re.compile(r"[()\[\]{}:\n]")
#: From the colon of a header to the docstring, over comments.
_DOCSTRING = re.compile(r"[ \t\r\x02]*\n(?:[ \t\r\x02]*\n)*[ \t]*[rRuUbB]{0,2}(\x01)")


def _docstrings(masked: str, x: int, y: int) -> Iterator[tuple[int, int]]:
    """(start of the header, start of the docstring) of functions of a masked text; headers end at the colon outside brackets."""
    for m in _DEF.finditer(masked, x, y):
        depth = 0
        for b in _BRACKET.finditer(masked, m.end(), y):
            c = b[0]
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
            elif not depth and (c == ":" or masked[b.start() - 1] not in "\\\r"):
                d = _DOCSTRING.match(masked, b.end(), y) if c == ":" else None
                if d:
                    yield m.start(), d.start(1)
                break
            if depth < 0:
                break


def documented(texts: pa.Array, lang: str) -> list[tuple[int, int, int, str]]:
    """(file, first line, last line, description): a function that starts in these lines has it."""
    if not lang or lang in ("json", "yaml", "properties") or not len(texts):
        return []
    s = lexmask.spans(texts, lang)
    data, lo, hi, kind, file = s.data, s.lo, s.hi, s.kind, s.file
    blob = data.tobytes()
    ends = np.flatnonzero(data == 10)
    newline = lexmask.running(data == 10)
    solid = lexmask.running(data > 32)
    out: list[tuple[int, int, int, str]] = []
    # Comments that stand alone on their lines, consecutive ones as one block.
    c = np.flatnonzero(kind == lexmask.COMMENT)
    if len(c):
        k = np.searchsorted(ends, lo[c], side="left")
        begin = np.maximum(np.where(k > 0, ends[np.maximum(k - 1, 0)] + 1 if len(ends) else 0, 0), s.starts[file[c]])
        bom = (solid[lo[c]] - solid[begin] == 3) & (begin == s.starts[file[c]]) & (data[begin] == 0xEF)
        alone = (solid[lo[c]] == solid[begin]) | bom
        c = c[alone]
    if len(c):
        a, b = c[:-1], c[1:]
        joined = (file[a] == file[b]) & (solid[lo[b]] == solid[hi[a]]) & (newline[lo[b]] - newline[hi[a]] == 1)
        first = np.concatenate([[True], ~joined])
        heads = np.flatnonzero(first)
        tails = np.concatenate([heads[1:], [len(c)]]) - 1
        for h, t in zip(c[heads].tolist(), c[tails].tolist(), strict=True):
            f = int(file[h])
            x, y, stop = int(lo[h]), int(hi[t]), int(s.ends[f])
            if y - x < SHORTEST:
                continue
            n = blob.find(b"\n", y, stop)
            if n < 0 or blob[y:n].strip():
                continue
            anchor = last = int(newline[n] - newline[s.starts[f]]) + 2
            at = n + 1
            depth = 0
            while at < stop:
                n = blob.find(b"\n", at, stop)
                n = stop if n < 0 else n
                row = blob[at:n].strip()
                if not row and not depth:
                    last = 0
                    break
                if not depth and not row.startswith(b"@"):
                    break
                depth = max(0, depth + row.count(b"(") - row.count(b")"))
                last += 1
                at = n + 1
            else:
                last = 0
            if last:
                text = describe(blob[x:y].decode("utf-8", "replace"))
                if text:
                    out.append((f, anchor, last, text))
    if lang == "python":
        blank = data.copy()
        edge = np.zeros(len(data) + 1, dtype=np.int32)
        use = lo < hi
        np.add.at(edge, lo[use], np.where(kind[use] == lexmask.COMMENT, 1, 1 << 16))
        np.add.at(edge, hi[use], np.where(kind[use] == lexmask.COMMENT, -1, -(1 << 16)))
        inside = np.cumsum(edge[:-1])
        blank[(inside > 0) & (inside < 1 << 16) & (data != 10)] = 2
        blank[(inside >= 1 << 16) & (data != 10)] = 1
        start_of = {int(x): int(y) for x, y, q in zip(lo, hi, kind, strict=True) if q == lexmask.STRING}
        masked = blank.tobytes().decode("latin-1")
        for f, (x, y) in enumerate(zip(s.starts.tolist(), s.ends.tolist(), strict=True)):
            for top_at, p in _docstrings(masked, x, y):
                q = start_of.get(p)
                text = describe(blob[p:q].decode("utf-8", "replace")) if q else ""
                if not text:
                    continue
                line = top = int(newline[top_at] - newline[x]) + 1
                at = top_at
                while at > x:
                    prev = blob.rfind(b"\n", x, at - 1) + 1
                    prev = max(prev, x)
                    if not blob[prev : at - 1].lstrip().startswith(b"@"):
                        break
                    top, at = top - 1, prev
                out.append((f, top, line, text))
    return out


_DOC_SCHEMA = "file_id bigint, first_line int, last_line int, description string"


def _run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for lang, rows, texts, piece in batches.by_language(batch, "file_path", "content"):
            found = documented(texts, lang)
            if found:
                ids = piece.column("file_id").take(pa.array(rows)).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[f[0]] for f in found], pa.int64()), *(pa.array([f[i] for f in found], pa.int32()) for i in (1, 2)), pa.array([f[3] for f in found], pa.string())],
                    names=["file_id", "first_line", "last_line", "description"],
                )


def comment_spans(parse_results: DataFrame) -> DataFrame:
    """(file_id, first_line, last_line, description): what a function starting there may take."""
    return parse_results.select("file_id", "file_path", "content").mapInArrow(_run, _DOC_SCHEMA)


def function_docs(parse_results: DataFrame, parsed_entities: DataFrame) -> DataFrame:
    """(file_id, start_line, qualified_name, signature, end_line, description): functions and
    methods whose documentation is not trivial.

    The documentation is doc_comment where that is not null - an empty one documents nothing -
    and else the comment directly above (above annotations, no blank line between) or the
    docstring in the file. Rows delivered twice come out once; a function that is also emitted
    under its bare name comes out once for each name.
    """
    cols = ["file_id", "start_line", "end_line", "qualified_name", "signature"]
    fn = parsed_entities.filter(F.lower("type").isin("function", "method") & F.col("file_id").isNotNull() & F.col("start_line").isNotNull())
    own = fn.filter("doc_comment is not null and doc_comment <> ''").select(*cols, describe_udf("doc_comment").alias("description"))
    bare = fn.filter("doc_comment is null").select(*cols)

    spans = comment_spans(parse_results)
    none: Column = F.lit(None)
    events = bare.select(*cols, F.col("start_line").alias("_line"), F.lit(1).alias("_kind"), none.cast("int").alias("_last"), none.cast("string").alias("description")).unionByName(
        spans.select(
            "file_id", none.cast("int").alias("start_line"), none.cast("int").alias("end_line"), none.cast("string").alias("qualified_name"), none.cast("string").alias("signature"),
            F.col("first_line").alias("_line"), F.lit(0).alias("_kind"), F.col("last_line").alias("_last"), "description",
        )
    )
    before = Window.partitionBy("file_id").orderBy("_line", "_kind", "_last").rowsBetween(Window.unboundedPreceding, 0)
    nearest = F.last(F.when(F.col("_kind") == 0, F.struct("_last", "description")), ignorenulls=True).over(before)
    joined = events.withColumn("_near", nearest).filter((F.col("_kind") == 1) & (F.col("start_line") <= F.col("_near._last")))
    return own.filter("description <> ''").unionByName(joined.select(*cols, F.col("_near.description").alias("description"))).distinct()


def documented_rows(parse_results: DataFrame, parsed_entities: DataFrame) -> DataFrame:
    return function_docs(parse_results, parsed_entities).select("file_id", "start_line").distinct()


def code_pairs(parse_results: DataFrame, parsed_entities: DataFrame) -> DataFrame:
    """(file_id, start_line, qualified_name, signature, code, description).

    A function emitted more than once keeps its longest qualified name. The code are the
    file's lines start_line to end_line; files delivered twice count once.
    """
    docs = function_docs(parse_results, parsed_entities)
    best = docs.groupBy("file_id", "start_line").agg(
        F.max(F.struct(F.length(F.coalesce("qualified_name", F.lit(""))).alias("n"), "qualified_name", "signature", "end_line", "description")).alias("b")
    )
    # One row for each file, so its text is shuffled once and not once for each function.
    per_file = best.groupBy("file_id").agg(F.collect_list(F.struct("start_line", "b")).alias("fns"))
    files = parse_results.select("file_id", "content").dropDuplicates(["file_id"])
    x = per_file.join(files, "file_id").select("file_id", F.split("content", "\n").alias("ls"), F.explode("fns").alias("f"))
    start = F.greatest(F.col("f.start_line"), F.lit(1))
    code = F.array_join(F.slice("ls", start, F.greatest(F.coalesce(F.col("f.b.end_line"), start) - start + 1, F.lit(0))), "\n")
    return x.select("file_id", F.col("f.start_line").alias("start_line"), F.col("f.b.qualified_name").alias("qualified_name"), F.col("f.b.signature").alias("signature"), code.alias("code"), F.col("f.b.description").alias("description"))
