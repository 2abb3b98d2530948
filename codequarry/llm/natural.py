"""Natural language inside code (problem 2).

Method: the byte automaton of `lexmask` marks comments and strings over Arrow buffers;
interpolated Kneser-Ney character models score the marked runs line by line against seven
languages and a model of code-like text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm import batches, langmodel, lexmask

MIN_WORDS, MIN_CJK = 5, 8
LATIN = ("en", "de", "fr", "es")
#: Bits a character by which the model of a further language must be better.
FOREIGN = 0.3
#: Length from which a line of a comment may run on in the next.
WRAPPED = 45
_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]{1,6})\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|([ntr])|(.))", re.S)
_MARKS = re.compile(r"^(?:[rRbBuUfF]{1,2}(?=[\"']))?[\s/*#!;\-=\"'`|>:,]+|[\s*/\"'`$\\]+$")
_TAG = re.compile(r"^(?:@\w+(?:\s+\{[^}]*\})?(?:\s+[\w.$]+\s*-)?|:\w+(?:\s+\w+)*:|TODO\b:?|FIXME\b:?|NOTE\b:?|XXX\b:?)\s*")
#: A word of running text: letters with marks of punctuation around.
_RUN = re.compile(r"[(\[\"'«„“‚‘¿¡`]*[^\W\d_]+(?:['’\-][^\W\d_]+)*[)\]\"'»“”’`.,;:!?…]*\Z")
_HUMP = re.compile(r"[a-zß-ÿ][A-Z]")
_CJK = re.compile(r"[\u3005\u3041-\u30fa\u30fc-\u30ff\u3400-\u4dbf\u4e00-\u9fff]")
_CJK_BREAK = re.compile(r"[^\u3001\u3002\u3005\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uff00-\uffef\d\s]+")
#: Fixed words that begin statements of query languages.
_QUERY = re.compile(r"\s*(?:SELECT|INSERT\s+INTO|UPDATE|DELETE\s+FROM|CREATE\s+(?:TABLE|INDEX|VIEW)|ALTER\s+TABLE|DROP|MERGE\s+INTO|WITH\s+\w+\s+AS|MATCH\s*\(|TRUNCATE)\b")
#: Signs of code; code_line() tells statements from sentences that only mention code.
_CODE_SIGN = re.compile(r"(?:[;{]|\)\s*:)\s*$|^\s*(?:[\w.]+\s*(?:[-+*/|&^%:]?=)\s|[\w.]+\([^)]*\)\s*;?$|return\b[^.]*$|if\s*\(|for\s*\(|while\s*\()|=>|\w\(\w*\)|&&|\|\||==|!=")
#: Quoted texts, trailing remarks and, as words of a sentence, plural endings and calls.
_QUOTED = re.compile(r"(?<!\w)(?:\"[^\"]*\"|'[^']*'|`[^`]*`)(?!\w)")
_TRAILING = re.compile(r"(?<=[;{})\w])\s+(?:#|//|/\*)\s.*$")
_PLURAL = re.compile(r"(?<=\w)\((?:s|es|en|n|r|e|ies|и|ы|а)\)")
_CALL = re.compile(r"[^\W\d][\w.$:]*\((?:[^()\s]|,\s)*\)")
#: Fixed words of statements; two other words side by side are no code, save for a type before a name.
_KEYWORDS = set(
    "return const let var val new public private protected static final def class func function fn import from package void int long short double float char bool boolean string unsigned throw throws "
    "raise await async yield if elif else for while do try catch except finally switch case default break continue and or not in is as with null none nil true false this self extends implements "
    "interface enum struct type export readonly abstract override assert del lambda typeof instanceof delete defer go range select echo print".split()
)
_SEPARATE = re.compile(r"&&|\|\|")
_ASSIGNMENT = re.compile(r"\s*(?:\w+\s+){0,3}[\w.\[\]]+\s*[-+*/|&^%:]?=\s")
#: Whole statements: a quoted text assigned, the head of a function.
_WHOLE = re.compile(
    r"\s*(?:(?:const|let|var|val|final|static|String|string|auto|char)\s+)*[\w.\[\]]+\s*[-+*/|&^%:]?=\s*[brufBRUF]{0,2}[\"'`]|\s*(?:[\w.]+\s+){0,6}[\w.$]+\s*\([^()]*\)\s*(?::\s*\S+\s*)?\{\s*$"
)
_STATEMENT_END = re.compile(r"(?:[;{]|\)\s*:)\s*$")


@dataclass
class Unit:
    file: int
    line: int
    lo: int
    hi: int
    text: str
    size: int


def decode(raw: str) -> str:
    """Escapes of a literal replaced; escaped line ends become real ones."""
    if "\\" not in raw:
        return raw

    def one(m: re.Match) -> str:
        a, b, c, d, e = m.groups()
        if a or b or c:
            n = int(a or b or c, 16)
            return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else " "
        return {"n": "\n", "t": " ", "r": ""}[d] if d else e

    return _ESCAPE.sub(one, raw)


def running(text: str) -> int:
    """Words of running text, 0 unless they are most of the text."""
    tokens = text.split()
    n = sum(1 for t in tokens if _RUN.match(t) and not _HUMP.search(t))
    return n if n * 10 >= 6 * len(tokens) else 0


def cjk(text: str) -> int:
    return len(_CJK.findall(text))


def code_line(text: str) -> bool:
    """Whether a line is code: it has a sign of code, and no sentence is left beside its calls and
    quoted texts - words that follow one another, or mostly Chinese or Japanese characters."""
    if not _CODE_SIGN.search(text):
        return False
    if _WHOLE.match(text):
        return True
    if cjk(text) >= MIN_CJK:
        bare = _CALL.sub("", _QUOTED.sub("", text))
        if 2 * cjk(bare) >= len(re.sub(r"\s", "", bare)):
            return False
    tokens = _CALL.sub("x", _PLURAL.sub("", _QUOTED.sub('"', _TRAILING.sub("", text)))).split()
    chain = longest = pairs = 0
    at_start = True
    for i, token in enumerate(tokens):
        word = bool(_RUN.match(token)) and not _HUMP.search(token) and token.strip("()[].,:;!?").lower() not in _KEYWORDS
        chain = chain + 1 if word else 0
        pairs += chain > 1
        longest = max(longest, chain)
        if i < 3:
            at_start &= bool(_RUN.match(token)) and (word or i == 2) and token[-1] not in "();"
    if longest >= 4:
        return False
    if _SEPARATE.search(text):
        return True
    if pairs >= 3 or len(tokens) > 3 and at_start and not _STATEMENT_END.search(text):
        return False
    return pairs < 2 or bool(_STATEMENT_END.search(text) or _ASSIGNMENT.match(text))


def plausible(text: str) -> bool:
    """Long enough to be a passage and no query, pattern or statement by its form."""
    if cjk(text) >= MIN_CJK:
        return True
    if running(text) < MIN_WORDS or _QUERY.match(text):
        return False
    return not code_line(text)


def clean(line: str) -> str:
    line = _MARKS.sub("", line)
    return _TAG.sub("", line)


def judge(texts: list[str]) -> list[str]:
    """The language of each text, '' where it is none of the seven."""
    s = langmodel.score(texts)
    out = []
    for t, row in zip(texts, s, strict=True):
        best = int(row.argmax())
        lang = langmodel.LANGS[best]
        if lang == "code":
            best = int(np.argsort(row)[-2])
            # Close to a language and made of running words: names within a sentence.
            lang = langmodel.LANGS[best] if row[langmodel.CODE_CLASS] - row[best] < 0.35 and running(t) * 10 >= 7 * len(t.split()) else ""
        n = cjk(t)
        if lang in ("zh", "ja"):
            if n < MIN_CJK:
                lang = ""
        elif lang and running(t) < MIN_WORDS:
            lang = ""
        out.append(lang)
    # Lines of further languages in Latin script would else go to the nearest of the seven.
    latin = [i for i, x in enumerate(out) if x in LATIN]
    best = langmodel.score([texts[i] for i in latin], others=True).max(axis=1, initial=-np.inf)
    for i, other in zip(latin, best.tolist(), strict=True):
        if other > s[i, langmodel.LANGS.index(out[i])] + FOREIGN:
            out[i] = ""
    return out


def units(s: lexmask.Spans, lang: str) -> list[Unit]:
    """Lines of comments and literals that may hold a passage; wrapped lines are joined."""
    data, lo, hi, kind = s.data, s.lo, s.hi, s.kind
    keep = kind != lexmask.REGEX
    if lang not in ("yaml", "properties"):
        keep &= kind != lexmask.KEY
    file = s.file
    spaces = lexmask.running(data == 32)
    high = lexmask.running((data >= 0x80) | (data == 92))
    newline = lexmask.running(data == 10)
    solid = lexmask.running(data > 32)
    # Line comments on consecutive lines with nothing between are one block.
    group = np.ones(len(lo), dtype=bool)
    if len(lo) > 1:
        a, b = slice(None, -1), slice(1, None)
        joined = (
            (kind[a] == lexmask.COMMENT) & (kind[b] == lexmask.COMMENT) & (file[a] == file[b]) & (solid[lo[b]] == solid[hi[a]])
            & (newline[lo[b]] - newline[hi[a]] == 1) & (newline[hi[a]] == newline[lo[a]]) & (newline[hi[b]] == newline[lo[b]])
        )
        group[1:] = ~joined
    first = np.flatnonzero(group)
    last = np.concatenate([first[1:], [len(lo)]]) - 1 if len(first) else first
    g_lo, g_hi = lo[first], hi[last]
    may = keep[first] & ((spaces[g_hi] - spaces[g_lo] >= MIN_WORDS - 1) | (high[g_hi] - high[g_lo] >= 3 * MIN_CJK) | ((high[g_hi] - high[g_lo] >= MIN_CJK) & (g_hi - g_lo >= 6 * MIN_CJK)))
    out: list[Unit] = []
    blob = data.tobytes()
    for i in np.flatnonzero(may).tolist():
        a, b, f = int(g_lo[i]), int(g_hi[i]), int(file[first[i]])
        k = int(kind[first[i]])
        raw = blob[a:b].decode("utf-8", "replace")
        line = int(newline[a] - newline[s.starts[f]]) + 1
        if k == lexmask.KEY and (b < len(data) and data[b] == 58):
            continue
        if k != lexmask.COMMENT:
            raw = decode(raw)
        prev: Unit | None = None
        long_line = False
        for j, part in enumerate(raw.split("\n")):
            text = clean(part)
            if not text:
                prev = None
                continue
            # Only a long line is taken to be wrapped; short ones stand for themselves.
            if prev is not None and long_line and prev.text[-1] not in ".!?。！？:" and text[0].islower() and not code_line(text):
                prev.text += " " + text
                prev.size += len(text)
            else:
                prev = Unit(f, line + (j if k == lexmask.COMMENT or "\\" not in raw else 0), a, b, text, len(text))
                out.append(prev)
            long_line = len(part.strip()) >= WRAPPED
    return [u for u in out if plausible(u.text)]


def passages(texts: pa.Array, lang: str) -> list[tuple[int, int, str, str, int]]:
    """(file, line, language, text, characters)."""
    if not lang or not len(texts):
        return []
    found = units(lexmask.spans(texts, lang), lang)
    langs = judge([u.text for u in found])
    return [(u.file, u.line, x, u.text, u.size) for u, x in zip(found, langs, strict=True) if x]


_SCHEMA = "file_id bigint, start_line int, natural_lang string, text string, chars bigint, file_chars bigint"


def _run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for lang, rows, texts, piece in batches.by_language(batch, "file_path", "content"):
            found = passages(texts, lang)
            if not found:
                continue
            ids = piece.column("file_id").take(pa.array(rows)).to_pylist()
            size = [len(t or "") for t in texts.to_pylist()]
            at = [f[0] for f in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in at], pa.int64()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.string()),
                 pa.array([f[3] for f in found], pa.string()), pa.array([f[4] for f in found], pa.int64()), pa.array([size[i] for i in at], pa.int64())],
                names=["file_id", "start_line", "natural_lang", "text", "chars", "file_chars"],
            )


def natural_passages(parse_results: DataFrame) -> DataFrame:
    """(file_id, start_line, natural_lang, text, chars, file_chars): each passage of at least
    five words, or eight Chinese or Japanese characters, in a comment or string.

    Null and empty contents and files of unknown extension give none; files delivered twice
    give theirs twice.
    """
    return parse_results.select("file_id", "file_path", "content").mapInArrow(_run, _SCHEMA)


def language_rows(parse_results: DataFrame) -> DataFrame:
    return natural_passages(parse_results).select("file_id", "natural_lang").distinct()


def language_shares(parse_results: DataFrame) -> DataFrame:
    """(file_id, natural_lang, passages, chars, share): share of the file's characters."""
    one = natural_passages(parse_results).distinct()
    return one.groupBy("file_id", "natural_lang").agg(
        F.count("*").alias("passages"), F.sum("chars").alias("chars"), F.round(F.sum("chars") / F.max("file_chars"), 6).alias("share")
    )
