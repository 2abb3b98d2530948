"""Generated, minified, vendored and data files (problem 5).

Method: thresholds on layout statistics - longest and mean line, share of long lines, white space, letters and
digits, density of numeric literals, long encoded runs, periodic line shapes - tuned per
language. What layout cannot tell - copies of third-party code and single files of tools look like any
code - is told by the marks that tools and copyists leave in comments at the head of a file, and
by the directories that hold third-party copies; `file_kinds` names the reason.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm import batches, lexmask


@dataclass(frozen=True)
class Limits:
    """Limits of one language; a file beyond them is minified or data."""

    #: Mean line length, or share of bytes in lines of more than LONG bytes, and white-space share of minified text.
    minified_line: float = 110.0
    minified_long: float = 0.7
    minified_space: float = 0.13
    #: Share of bytes in numeric literals or encoded runs with their separators.
    data_share: float = 0.92
    #: With no more other lines than this, a smaller share is enough.
    data_lines: int = 7
    data_share_short: float = 0.5
    #: Share of lines whose shape recurs with one short period.
    periodic: float = 0.9


LIMITS = {
    "python": Limits(minified_line=140, minified_space=0.08),
    "go": Limits(minified_line=160, minified_space=0.06),
    "java": Limits(minified_line=160, minified_space=0.08),
    "javascript": Limits(),
    "typescript": Limits(),
    "json": Limits(minified_line=1e9, minified_long=2, data_share=0.92, data_lines=0, periodic=2),
    "yaml": Limits(minified_line=1e9, minified_long=2, data_share=0.92, data_lines=0, periodic=2),
    "properties": Limits(minified_line=1e9, minified_long=2, data_share=0.92, data_lines=0, periodic=2),
}
DEFAULT = Limits(minified_line=160, minified_space=0.06)

#: Bytes of a long line, and of the longest line that minified text has at least.
LONG, LONGEST = 500, 200
#: White-space share below which a script that is named as minified is so.
NAMED_SPACE = 0.16

#: Directories that hold copies of third-party code.
THIRD_PARTY_DIRS = (
    "vendor _vendor third_party third-party thirdparty 3rdparty node_modules bower_components jspm_packages pods carthage site-packages dist-packages "
    "deps external externals godeps"
).split()
#: Fixed patterns: what tools write about a file as a whole.
_GENERATED = re.compile(
    r"(?i)(?:^|[\s*/#<!(])(?:@generated\b|<auto-?generated\b|code generated by\b.*\bdo not edit|auto-?generated(?:\s+file)?\s*(?:from|by|:|[-–]|\.|$)(?!\s*method)"
    r"|(?:do not|don't|never) (?:edit|modify|change|touch) this (?:file|code|module|class)\b|(?:this|the) (?:file|module|class) (?:must|should|may) not be (?:edited|modified|changed)\b"
    r"|(?:this|the) (?:file|code|source|class|module) (?:is|was|has been) (?:auto(?:matically)?[- ]?)?(?:generated|produced|created) (?:by|from|using)\b"
    r"|generated (?:automatically )?(?:by|from) .{0,80}\b(?:do not (?:edit|modify)|not be edited|overwritten)"
    r"|(?:wird|wurde) (?:automatisch )?(?:von|durch|aus) .{0,40}(?:erzeugt|generiert|erstellt)|automatisch (?:erzeugte|generierte)|automatisch (?:erzeugt|generiert) (?:von|aus|durch)"
    r"|(?:est|a été) (?:produit|généré|créé)e?s?(?: automatiquement)? (?:par|à partir|depuis)|généré automatiquement par"
    r"|(?:generado|creado|producido)s? (?:automáticamente |automaticamente )?(?:por|a partir de|con) .{0,60}(?:no (?:lo |se )?(?:edit|modif|debe|cambi)|a mano)|generado autom[aá]ticamente por"
    r"|(?:сгенерирован|создан|сформирован|генериру|созда)\w*(?: автоматически)? .{0,60}(?:не (?:правьте|редактир|изменя|прав|следует)|вручную)|автоматически (?:сгенерирован|создан|сформирован))"
    r"|(?:由.{0,40}(?:自动)?(?:生成|产生).{0,20}(?:请勿|不要|切勿|勿)|自动生成的?(?:文件|代码)"
    r"|(?:によって|により|から|が).{0,10}(?:自動)?生成.{0,30}(?:編集|変更|手)|自動生成された(?:ファイル|コード))"
)
_BANNER = re.compile(
    r"(?i)^\W*(?:/\*!\s*)?@?[\w.\-/]+\s+v?\d+\.\d+(?:\.\d+)*(?:[-+.]\w+)*\s*(?:\||[-–]|\*/|$|\(c\)|©|copyright).*$"
)
_BANNER_MORE = re.compile(r"(?i)\(c\)|©|copyright|licen[cs]e|https?://|authors|/\*!")
#: Fixed patterns: what copies of other projects say about themselves.
_COPIED = re.compile(
    r"(?i)\b(?:imported|copied|vendored|taken|forked|mirrored|borrowed|bundled|extracted)\b(?: verbatim| unmodified| unchanged| as is| directly)? from (?:the )?[\w.@/\-]+.{0,60}(?:\d+\.\d+|\bproject\b|\brelease\b|\bupstream\b|\bversion\b|https?://)"
    r"|\bupstream copy\b|\b(?:local|your|any|manual) (?:changes|edits|modifications) (?:will|would) be (?:dropped|lost|overwritten|discarded) (?:at|on|by|with) (?:the )?next (?:import|sync|update|upgrade|release)"
    r"|\breport (?:bugs|issues|problems) upstream\b|\b(?:keep|kept|stay)\b.{0,20}\bin (?:step|sync) with (?:the )?(?:original|upstream)\b|\b(?:vendored|third[- ]party) (?:copy|code|library|source) (?:of|from)\b"
    r"|(?:unveränderte )?kopie (?:von|aus|des)\b.{0,60}\d+\.\d+|(?:unverändert|wörtlich) (?:übernommen|kopiert) (?:aus|von)|copie (?:conforme |exacte )?(?:de|du)\b.{0,60}\d+\.\d+|copia(?:do)? (?:literal(?:mente)? )?(?:de|del|desde)\b.{0,60}\d+\.\d+"
    r"|(?:скопирован|взят|импортирован)\w* (?:без изменений )?из\b.{0,80}\d+\.\d+|(?:复制|拷贝|导入|摘)自.{0,60}\d+\.\d+|(?:から(?:コピー|取り込)|のコピー).{0,60}"
)
_REMARK = re.compile(r"\s*(?:#|//|/\*|\*)")
_SHAPE = re.compile(r"[^\W\d]\w*|\d[\w.]*")
_NUMBERS = re.compile(r"(?:(?<![\w.])[-+]?(?:0x[0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)\s*[,;|]?\s*){8,}")
#: A run is tried at its first character only.
_ENCODED = re.compile(r"(?:[\"'`]|(?<![A-Za-z0-9+/=_\-]))[A-Za-z0-9+/=_\-]{48,}[\"'`]?\s*[,+;]?\s*|(?:\\x[0-9a-fA-F]{2}){12,}")
_STRINGS = re.compile(r"(?:[\"'][^\"'\n]{0,80}[\"']\s*,\s*){12,}")
_GENERATED_NAME = re.compile(r"(?:_pb2(?:_grpc)?\.pyi?|\.pb\.go|\.pb\.cc|\.pb\.h|\.g\.\w+|\.gen\.\w+|_gen\.go|_generated\.\w+|\.generated\.\w+|OuterClass\.java|\.designer\.\w+)$", re.I)
_GENERATED_DIRS = {"generated", "autogen", "gen", "generated-sources", "__generated__"}


def third_party_path(path: str) -> bool:
    """Whether a directory of the path holds third-party copies; parts of names do not count."""
    dirs = [d.lower() for d in re.split(r"[\\/]+", path)[:-1]]
    return any(d in THIRD_PARTY_DIRS for d in dirs)


def head_comments(blob: bytes, s: lexmask.Spans, f: int, begin: int, end: int) -> list[str]:
    """The comments of a file before its first code line other than package and imports."""
    out: list[str] = []
    at = int(s.starts[f])
    for i in range(begin, end):
        gap = blob[at : int(s.lo[i])].lstrip(b"\xef\xbb\xbf")
        code = [x.strip() for x in gap.split(b"\n") if x.strip()]
        if any(not re.match(rb"(?:package|import|from|use|using|#include|require|'use strict'|\"use strict\"|<\?php|[()\"]|[\w./]+\"?$)", x) for x in code):
            break
        if s.kind[i] == lexmask.COMMENT:
            out.append(blob[int(s.lo[i]) : int(s.hi[i])].decode("utf-8", "replace"))
        elif s.kind[i] == lexmask.KEY and not re.fullmatch(rb"\s*(?:(?:---|%[^\n]*)\s*)*", blob[int(s.lo[i]) : int(s.hi[i])]):
            break
        at = int(s.hi[i])
    return out


def periodic(text: str) -> float:
    """The largest share of lines that have the shape of the line a period (2 or 3) before."""
    shapes = [x for x in map(str.strip, _SHAPE.sub("w", text).split("\n")) if x and not _REMARK.match(x)]
    n = len(shapes)
    if n < 12 or len(set(shapes)) > max(10, n // 4):
        return 0.0
    best = 0.0
    for p in (2, 3):
        if n >= 3 * p:
            best = max(best, sum(a == b for a, b in zip(shapes, shapes[p:], strict=False)) / (n - p) if len(set(shapes[-2 * p :])) > 1 else 0.0)
    return best


def layout(texts: pa.Array) -> dict[str, np.ndarray]:
    """Layout statistics of each text, from byte classes."""
    data, starts, ends = lexmask.buffers(texts)
    size = ends - starts
    run = lexmask.running
    count = lambda c: c[ends] - c[starts]
    space = run((data == 32) | (data == 9) | (data == 13) | (data == 10))
    alnum = run(((data >= 48) & (data <= 57)) | ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122)) | (data >= 0x80))
    control = run(((data < 32) & (data != 9) & (data != 10) & (data != 13) & (data != 12)) | (data == 127))
    digit = run((data >= 48) & (data <= 57))

    # Lines of all texts: each begins at a text's start or behind a line end.
    nl = np.flatnonzero(data == 10)
    first, last = np.searchsorted(nl, starts), np.searchsorted(nl, ends)
    n_lines = last - first
    owner = np.repeat(np.arange(len(starts)), n_lines + 1)
    head = np.cumsum(n_lines + 1) - (n_lines + 1)
    behind = np.append(nl, 0)[np.clip(first[owner] + np.arange(len(owner)) - head[owner] - 1, 0, len(nl))] + 1
    begins = np.where(np.arange(len(owner)) == head[owner], starts[owner], behind)
    stop = np.append(begins[1:] - 1, 0)
    stop[head + n_lines] = ends
    length = stop - begins
    longest = np.maximum.reduceat(length, head) if len(head) else np.zeros(0, dtype=np.int64)
    in_long = np.bincount(owner, weights=np.where(length > LONG, length, 0), minlength=len(starts))
    safe = np.maximum(size, 1)
    lines = n_lines + 1
    return {
        "size": size, "lines": lines, "longest": longest, "mean": size / np.maximum(lines, 1), "long": in_long / safe, "space": count(space) / safe,
        "alnum": count(alnum) / safe, "control": count(control) / safe, "digit": count(digit) / safe,
    }


def data_share(text: str, least: float = 0.0) -> tuple[float, int]:
    """Share of the text in long runs of literals, and the lines without any, which are not counted (0) below a share."""
    kept = _STRINGS.sub(" ", _ENCODED.sub(" ", _NUMBERS.sub(" ", text)))
    share = 1 - len("".join(kept.split())) / max(1, len("".join(text.split())))
    return share, sum(1 for x in kept.split("\n") if re.search(r"\w", x)) if share >= least else 0


def by_layout(i: int, path: str, text: str, st: dict[str, np.ndarray], lang: str) -> str:
    """'minified', 'data', 'generated' or '' for a text that is not blank, by layout statistics alone."""
    lim = LIMITS.get(lang, DEFAULT)
    if (
        st["longest"][i] >= LONGEST and (st["mean"][i] > lim.minified_line or st["long"][i] > lim.minified_long)
        and st["space"][i] < lim.minified_space and st["alnum"][i] < 0.85 and st["digit"][i] < 0.4 and lim.minified_long <= 1
    ):
        return "minified"
    share, other = data_share(text, lim.data_share_short)
    if share >= lim.data_share or (share >= lim.data_share_short and other <= lim.data_lines):
        return "data"
    if lim.periodic <= 1:
        dirs = {d.lower() for d in re.split(r"[\\/]+", path)[:-1]}
        named = bool(_GENERATED_NAME.search(path)) or bool(dirs & _GENERATED_DIRS)
        if periodic(text.lstrip("\ufeff")) >= (0.75 if named else lim.periodic):
            return "generated"
    if lang in ("javascript", "typescript") and re.search(r"\.min\.[cm]?[jt]s$", path) and st["space"][i] < NAMED_SPACE and st["longest"][i] > LONGEST:
        return "minified"
    return ""


def by_sign(path: str, rows: list[str]) -> tuple[str, str]:
    """(kind, reason) by the folder, or by a mark in the lines of a file's head comments."""
    if third_party_path(path):
        return "vendored", "folder"
    if any(_GENERATED.search(x) for x in rows):
        return "generated", "mark of a tool"
    if any(_COPIED.search(x) for x in rows):
        return "vendored", "mark of a copy"
    if any(_BANNER.match(x) and _BANNER_MORE.search(x) for x in rows):
        return "vendored", "banner"
    return "", ""


def judge(paths: list[str | None], texts: pa.Array, lang: str) -> list[tuple[str, str]]:
    """(kind, reason) of each file: kind 'generated', 'vendored', 'minified', 'data' or '' for hand-written ones;
    reason 'layout' where layout alone tells that a file is not hand-written, else the sign that does.

    Empty files are '' unless their folder decides. Texts with control bytes are damaged and
    not judged by layout; whether they parse is another operator's matter.
    """
    st = layout(texts)
    s = lexmask.spans(texts, lang) if lang else None
    blob = s.data.tobytes() if s is not None else b""
    first = np.searchsorted(s.file, np.arange(len(texts))) if s is not None else []
    last = np.searchsorted(s.file, np.arange(len(texts)), side="right") if s is not None else []
    out = []
    for i, (path, text) in enumerate(zip(paths, texts.to_pylist(), strict=True)):
        path, text = path or "", text or ""
        blank = not text.strip()
        head = head_comments(blob, s, i, int(first[i]), int(last[i])) if s is not None and not blank else []
        kind, reason = by_sign(path, [x for c in head for x in c.split("\n")])
        shape = "" if blank or st["control"][i] > 0.01 else by_layout(i, path, text, st, lang)
        out.append((kind or shape, "layout" if shape else reason))
    return out


def classify(paths: list[str | None], texts: pa.Array, lang: str) -> list[str]:
    """The kinds of `judge`."""
    return [kind for kind, _ in judge(paths, texts, lang)]


def _run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for lang, rows, texts, piece in batches.by_language(batch, "file_path", "content"):
            at = pa.array(rows)
            found = judge(piece.column("file_path").take(at).to_pylist(), texts, lang)
            yield pa.RecordBatch.from_arrays(
                [piece.column("file_id").take(at), piece.column("repo_id").take(at), piece.column("file_path").take(at), *(pa.array([f[k] for f in found], pa.string()) for k in (0, 1)), pa.array([lang] * len(found), pa.string())],
                names=["file_id", "repo_id", "file_path", "kind", "reason", "lang"],
            )


def file_kinds(parse_results: DataFrame) -> DataFrame:
    """(file_id, repo_id, file_path, kind, reason, lang); kind and reason '' for hand-written files."""
    return parse_results.select("file_id", "repo_id", "file_path", "content").mapInArrow(
        _run, "file_id bigint, repo_id string, file_path string, kind string, reason string, lang string"
    )


def kind_counts(parse_results: DataFrame) -> DataFrame:
    """(kind, reason, lang, files): distinct files by kind, by what told it, and language; kind '' are hand-written ones."""
    one = file_kinds(parse_results).groupBy("file_id").agg(F.max(F.struct("kind", "reason", "lang")).alias("k"))
    return one.groupBy("k.kind", "k.reason", "k.lang").agg(F.count("*").alias("files"))


def not_handwritten(parse_results: DataFrame) -> DataFrame:
    return file_kinds(parse_results).filter("kind <> ''").select("file_id").distinct()


def _path_key(path: str) -> Column:
    """Spelling of paths: slashes, leading ./ and repeated slashes do not matter."""
    p = F.regexp_replace(F.regexp_replace(F.col(path), r"\\", "/"), r"/+", "/")
    return F.regexp_replace(p, r"^(?:\./)+", "")


def handwritten_entities(parse_results: DataFrame, entities: DataFrame, repos: DataFrame) -> DataFrame:
    """entities without those whose file is no hand-written one.

    An entity names its repository by the first part of its id, the last part of repo_path;
    files are compared by (repository, path). Entities of unknown files stay.
    """
    names = repos.select("repo_id", F.element_at(F.split("repo_path", "/"), -1).alias("_repo"))
    bad = (
        file_kinds(parse_results).filter("kind <> ''").join(names, "repo_id")
        .select("_repo", _path_key("file_path").alias("_path")).distinct()
    )
    keyed = entities.withColumn("_repo", F.element_at(F.split(F.trim("id"), "/"), 1)).withColumn("_path", _path_key("file_path"))
    return keyed.join(bad, ["_repo", "_path"], "left_anti").drop("_repo", "_path")
