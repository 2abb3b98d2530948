"""Source files that do not parse (problem 7).

Method: generalised LL on a graph-structured stack, all dialects of a language together; a
file is flagged where every dialect rejects it. The parser works inside out so that it can
remember: comments and literals come from the byte automaton, tokens become one character
each, and the innermost bracket groups are parsed first and replaced by one character that
stands for the set of nonterminals they derive. Equal token strings - most statements of most
files - are parsed once for each Python worker.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from codequarry.llm import grammars, lexmask
from codequarry.llm.gll import Grammar

#: Entries after which a memory of parsed token strings starts anew.
MEMORY = 300_000

_OPS = {
    "javascript": ("=> ... ?.", ">>>= >>= <<= **= &&= ||= ??= += -= *= /= %= &= |= ^=", "=== !== == != <= >= && || ?? **"),
    "java": ("-> ... ::", ">>>= >>= <<= += -= *= /= %= &= |= ^=", "== != <= >= && ||"),
    "go": ("... := <-", "<<= >>= &^= += -= *= /= %= &= |= ^=", "== != <= >= && || &^"),
    "python": ("-> ... := **", "**= //= >>= <<= += -= *= /= %= &= |= ^= @=", "== != <= >= <>"),
    "json": ("", "", ""),
}
_OPS["typescript"] = _OPS["javascript"]
_GROUP = {"P": 0xF0000, "S": 0xF4000, "B": 0xF8000}
_BRACKET = {"(": "P", "[": "S", "{": "B"}
_BRACE_GROUPS = "\U000f8000-\U000fbfff"


class Labels:
    """Characters for sets of labels."""

    def __init__(self) -> None:
        self.of: dict[str, tuple[str, ...]] = {}
        self._char: dict[tuple[str, frozenset], str] = {}
        self._next = dict(_GROUP)

    def char(self, kind: str, names: frozenset[str]) -> str:
        c = self._char.get((kind, names))
        if c is None:
            c = self._char[kind, names] = chr(self._next[kind])
            self._next[kind] += 1
            self.of[c] = tuple(f"{kind}:{x}" for x in names)
        return c

    def __call__(self, c: str) -> tuple[str, ...]:
        return self.of.get(c) or (c,)


class Missing(dict):
    def __missing__(self, word: str) -> str:
        return "1" if word[0] in ".0123456789" else "n"


_INNER = re.compile(r"([(\[{])([^()\[\]{}\x00]*)([)\]}])")
_BLANK = re.compile(r"\s+")
_SIGNED = re.compile(r"(?:(?<=[,(\[{])|(?<![^\x00]))-1(?=,|$)")
_EQUAL = re.compile(r"([^,;]),\1(?:,\1){2,}")
_ANY_BRACKET = re.compile(r"[()\[\]{}]")
_MATCH = {"(": ")", "[": "]", "{": "}"}


class Parser:
    """The parser of one language."""

    chunked = {"Stmts", "Members", "Top", "TypeBody"}

    def __init__(self, lang: str):
        self.lang = lang
        self.labels = Labels()
        words = grammars.RESERVED["javascript" if lang == "typescript" else lang].split()
        soft = grammars.CONTEXTUAL[lang].split()
        self.tokens = Missing()
        for i, w in enumerate([*words, *soft]):
            self.tokens[w] = chr(0x100 + i)
        own, assign, binary = (x.split() for x in _OPS[lang])
        for i, w in enumerate(own):
            self.tokens[w] = chr(0x180 + i)
        self.tokens.update(dict.fromkeys(assign, "A"), **dict.fromkeys(binary, "o"))
        if lang == "python":
            self.tokens["//"] = "O"
        elif lang != "json":
            self.tokens.update({"++": "I", "--": "I"})
        ops = sorted((w for w in self.tokens if not w[0].isalpha()), key=len, reverse=True)
        prefix = r"(?:[rRbBuUfFtT]{1,2})(?=\x01)|" if lang == "python" else ""
        prefix += r"(?<=\x04)[a-z]+|" if lang in ("javascript", "typescript") else ""
        number = r"\.?\d[\w.]*(?:(?<=[eEpP])[+-]\d[\w.]*)?"
        self._token = re.compile(
            prefix + r"[A-Za-z_$\x80-\xff][\w$\x80-\xff]*|" + number + "".join("|" + re.escape(o) for o in ops), re.ASCII
        )
        self._prefix = lang == "python"
        self._flags = lang in ("javascript", "typescript")
        keep = lambda names: "".join(self.tokens[w] for w in names.split() if w in self.tokens)
        self.key = keep
        basics = (
            "ID = 'n'" + "".join(f" | '{w}'" for w in soft) + "\nNUM = '1'\nSTR = 's'\nTPL = 't'\nRE = 'r'\n"
            + "Keyword = " + " | ".join(f"'{w}'" for w in words) + "\n"
        )
        self.dialects = [""]
        if lang == "typescript":
            untyped = "\n".join(x.partition(" =")[0] + " =" for x in grammars.TS_ONLY.strip().splitlines())
            text = _prefixed(grammars.JS + grammars.TS_ONLY + basics, "ts_") + _prefixed(grammars.JS + untyped + "\n" + basics, "js_")
            self.dialects = ["ts_", "js_"]
        elif lang == "javascript":
            text = grammars.JS + "\n".join(x.partition(" =")[0] + " =" for x in grammars.TS_ONLY.strip().splitlines()) + "\n" + basics
        else:
            text = {"java": grammars.JAVA, "go": grammars.GO, "python": grammars.PYTHON, "json": grammars.JSON}[lang] + basics
        self.grammar = Grammar(text, lambda w: self.tokens[w] if len(w) > 1 else w)
        self.inside = {k: sorted({x for x in re.findall(rf"{k}:(\w+)", text) if x in self.grammar.start}) for k in "PSB"}
        self.top = {"json": "Value", "java": "Top", "go": "Top", "javascript": "Stmts", "typescript": "Stmts"}.get(lang, "")
        self.groups: dict[str, dict[str, str]] = {"P": {}, "S": {}, "B": {}}
        self.chunks: dict[str, frozenset[str]] = {}
        self._lists = {d + x for d in self.dialects for x in self.chunked} & set(self.grammar.start)
        if lang == "go":
            self._cut = re.compile("(?<=N)")
        elif lang in ("java", "javascript", "typescript"):
            stay = keep("else catch finally while instanceof in of from as extends implements is satisfies permits throws")
            begin = "n@#" + "".join(c for w, c in self.tokens.items() if w[0].isalpha() and c not in stay)
            self._cut = re.compile(f"(?<=;)(?![{keep('else while')}])|(?<=[{_BRACE_GROUPS}])(?=[{begin}])")
            if lang != "java":
                ends = "n1str\\]I" + keep(("void " if lang == "typescript" else "") + "this super null true false break continue return debugger of async get set static from as let type readonly abstract")
                no = stay.replace(keep("while"), "").replace(keep("else"), "")
                first = "n1s!~@#I" + "".join(c for w, c in self.tokens.items() if w[0].isalpha() and c not in no)
                named = "".join(c for w, c in self.tokens.items() if w[0].isalpha())
                self._asi = re.compile(f"(?:(?<=[{ends}])|(?<=\\.[{named}]))[ \t\r]*\n\\s*(?=[{first}])")
                # The line of a decorator goes on in the next.
                self._decorator = re.compile(r"(@n(?:\.n)*);")
                # Where these end a line, a statement may end or go on.
                open_ends = r"\)>" if lang == "typescript" else r"\)"
                bracket = rf"|(?<=[{ends}>])[ \t\r]*\n\s*(?=\[)" if lang == "typescript" else ""
                self._asi_open = re.compile(f"(?<=[{open_ends}])[ \t\r]*\n\\s*(?=[{first}])|(?<=\\}})[ \t\r]*\n\\s*(?=[{keep('else')}])" + bracket)
        if lang == "go":
            self._semi = re.compile(r"(?<=[n1s)\]}I" + keep("return break continue fallthrough") + r"])[ \t\r\f]*\n")
        if lang == "python":
            self._lines: dict[str, str] = {}
            self.blocks = Grammar(grammars.PYTHON_BLOCKS, lambda w: w)
            self.kinds = [x for x in self.grammar.start if re.match("[HI][A-Z]", x) and x != "ID"] + ["Simple", "Py2"]
            self.line_labels = Labels()
            self._suites: dict[str, str] = {}
            self._files: dict[str, bool] = {}

    def tokenise(self, text: str) -> str:
        t = self.tokens
        if self._prefix:
            text = self._token.sub(lambda m: "" if m.end() < len(text) and text[m.end()] == "\x01" and len(m[0]) < 3 and m[0] not in t else t[m[0]], text)
        elif self._flags:
            # Letters right after a regular expression are its flags.
            text = self._token.sub(lambda m: "" if m.start() and text[m.start() - 1] == "\x04" and m[0].isalpha() else t[m[0]], text)
        else:
            text = self._token.sub(lambda m: t[m[0]], text)
        return text.replace("\x01", "s").replace("\x03", "t").replace("\x04", "r")

    def _group(self, open_: str, inner: str, close: str) -> str:
        if _MATCH[open_] != close:
            return "\x02"
        kind = _BRACKET[open_]
        memory = self.groups[kind]
        c = memory.get(inner)
        if c is None:
            if len(memory) > MEMORY:
                memory.clear()
            text = _BLANK.sub("", inner) if self.lang == "python" else inner
            c = memory[inner] = self.labels.char(kind, self.derives(text, self.inside[kind]))
        return c

    def derives(self, text: str, names: list[str]) -> frozenset[str]:
        if "\x02" in text:
            return frozenset()
        # A list of equal elements parses like one of three, so long tables cost nothing.
        text = _EQUAL.sub(r"\1,\1,\1", _SIGNED.sub("1", text))
        lists = [x for x in names if x in self._lists]
        pieces = [x for x in self._cut.split(text) if x] if lists else []
        if len(pieces) < 2:
            return self.grammar.accepted(text, names, self.labels)
        out = set(lists)
        for p in pieces:
            ok = self.chunks.get(p)
            if ok is None:
                if len(self.chunks) > MEMORY:
                    self.chunks.clear()
                ok = self.chunks[p] = self.grammar.accepted(p, self._lists, self.labels)
            out &= ok
            if not out:
                break
        rest = [x for x in names if x not in self._lists]
        return frozenset(out) | (self.grammar.accepted(text, rest, self.labels) if rest else frozenset())

    def reduce(self, text: str) -> str:
        """Groups replaced inside out; files are kept apart by NUL."""
        for _ in range(12):
            text, n = _INNER.subn(lambda m: self._group(m[1], m[2], m[3]), text)
            if not n:
                return text
        return "\0".join(self._reduce_deep(p) for p in text.split("\0"))

    def _reduce_deep(self, text: str) -> str:
        """The same for one deeply nested file, in one pass with a stack."""
        opened: list[str] = []
        parts: list[list[str]] = [[]]
        at = 0
        for m in _ANY_BRACKET.finditer(text):
            parts[-1].append(text[at : m.start()])
            at = m.end()
            if m[0] in _MATCH:
                opened.append(m[0])
                parts.append([])
            elif opened:
                inner = "".join(parts.pop())
                parts[-1].append(self._group(opened.pop(), inner, m[0]))
            else:
                parts[-1].append("\x02")
        parts[-1].append(text[at:])
        while opened:
            inner = "".join(parts.pop())
            parts[-1].append(opened.pop() + inner)
        return "".join(parts[0])

    def valid(self, files: list[str]) -> list[bool]:
        """files: skeletons, see `skeletons`."""
        text = self.tokenise("\n\0\n".join(files))
        if self.lang == "python":
            return self._python(text)
        if self.lang == "go":
            text = self._semi.sub("N", text)
        elif self.lang in ("javascript", "typescript"):
            text = self._decorator.sub(r"\1U", self._asi.sub(";", text))
            text = self._asi_open.sub("U", text)
        text = re.sub(r"[ \t\r\n\f\v]+", "", text)
        return [self._file(f) for f in self.reduce(text).split("\0")]

    def _file(self, f: str) -> bool:
        if not f or f.strip("N") == "":
            return True
        if self.lang == "go" and f.lstrip("N")[:1] != self.tokens["package"]:
            return False
        if re.search(r"[()\[\]{}\x02]", f):
            return False
        return bool(self.derives(f, [d + self.top for d in self.dialects]))

    # Python: logical lines get kinds, indentation becomes blocks.
    def _python(self, text: str) -> list[bool]:
        text = re.sub(r"\\\r?\n", " ", text)
        text = self.reduce(text)
        text = re.sub(r"(?<=\S)[ \t\r\f]+", "", text)
        return [self._python_file(f) for f in text.split("\0")]

    def _kind(self, line: str) -> str:
        if len(self._lines) > MEMORY:
            self._lines.clear()
        names = self.grammar.accepted(line, self.kinds, self.labels) if not re.search(r"[()\[\]{}\x02]", line) else frozenset()
        names = frozenset("Simple" if x == "Py2" else x for x in names)
        key = frozenset(names)
        c = self.line_labels.char("P", key)
        self.line_labels.of[c] = tuple(key)
        self._lines[line] = c
        return c

    def _suite(self, m: re.Match) -> str:
        inner = m[1]
        c = self._suites.get(inner)
        if c is None:
            if len(self._suites) > MEMORY:
                self._suites.clear()
            c = self._suites[inner] = self.line_labels.char("B", self.blocks.accepted(inner, ["Suite", "CaseSuite"], self.line_labels))
        return c

    def _python_file(self, text: str) -> bool:
        out: list[str] = []
        stack = [0]
        known = self._lines
        for line in text.split("\n"):
            body = line.lstrip(" \t\f\r")
            if not body:
                continue
            width = len(line) - len(body)
            if width and "\t" in line[:width]:
                width = len(line[:width].expandtabs(8))
            if width != stack[-1]:
                if width > stack[-1]:
                    out.append("{")
                    stack.append(width)
                else:
                    while width < stack[-1]:
                        out.append("}")
                        stack.pop()
                    if width != stack[-1]:
                        return False
            out.append(known.get(body) or self._kind(body))
        if not out:
            return True
        out.extend("}" * (len(stack) - 1))
        simple = self.line_labels.char("P", frozenset(["Simple"]))
        self.line_labels.of[simple] = ("Simple",)
        text = re.sub(f"{simple}{{2,}}", simple, "".join(out))
        n = 1
        while n:
            text, n = re.subn(r"\{([^{}]*)\}", self._suite, text)
        ok = self._files.get(text)
        if ok is None:
            if len(self._files) > MEMORY:
                self._files.clear()
            ok = self._files[text] = bool(self.blocks.accepted(text, ["File"], self.line_labels))
        return ok


def _prefixed(text: str, p: str) -> str:
    names = {x.partition(" =")[0].strip() for x in text.strip().splitlines()}
    quoted = re.compile(r"'[^']*'|\w+")
    return quoted.sub(lambda m: p + m[0] if m[0] in names else m[0], text) + "\n"


@lru_cache(maxsize=None)
def parser(lang: str) -> Parser:
    return Parser(lang)


_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[[*range(9), *range(14, 32), 127]] = 2
_MARK = np.array([32, 32, 1, 4, 32, 3], dtype=np.uint8)


def skeletons(s: lexmask.Spans) -> list[str]:
    """The code of each file, a literal as one byte, a comment as a blank or a newline."""
    lo, hi, kind = s.lo, s.hi, s.kind
    use = lo < hi
    lo, hi, kind = lo[use], hi[use], kind[use]
    data = _CLEAN[s.data]
    edge = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi, -1)
    inside = np.cumsum(edge[:-1]) > 0
    lines = lexmask.running(s.data == 10)
    mark = _MARK[kind]
    mark = np.where((kind == lexmask.COMMENT) & (lines[hi] > lines[lo]), 10, mark)
    data[lo] = mark
    keep = ~inside
    keep[lo] = True
    size = s.ends - s.starts
    bom = np.flatnonzero(size >= 3)
    b = s.starts[bom]
    b = b[(s.data[b] == 0xEF) & (s.data[b + 1] == 0xBB) & (s.data[b + 2] == 0xBF)] if len(b) else b
    for k in range(3):
        keep[b + k] = False
    for f in np.flatnonzero((size >= 2) & (s.data[np.minimum(s.starts, max(len(s.data) - 1, 0))] == 35)).tolist() if len(s.data) else ():
        keep[int(s.starts[f]) : lexmask.shebang_end(s.data, int(s.starts[f]), int(s.ends[f]))] = False
    at = lexmask.running(keep)
    text = data[keep].tobytes().decode("latin-1")
    return [text[x:y] for x, y in zip(at[s.starts].tolist(), at[s.ends].tolist(), strict=True)]


_YAML_PLAIN = re.compile(r"(?:[^:#\n]|:(?!\s|$)|(?<!\s)#)+")
_YAML_FLOW_PLAIN = re.compile(r"(?:[^:#\n,\[\]{}]|:(?![\s,\[\]{}]|$)|(?<!\s)#)+")
_YAML_SCALAR_HEAD = re.compile(r"[|>][-+0-9]*[ \t]*(?:(?<=[ \t])#[^\n]*)?(?=\n|$)")
_YAML_PROPERTY = re.compile(r"[&!][^\s,\[\]{}]*")
_YAML_QUOTED = {'"': re.compile(r'"(?:[^"\\]|\\.)*"', re.S), "'": re.compile(r"'(?:[^']|'')*'", re.S)}


@lru_cache(maxsize=1)
def _yaml_grammars() -> tuple[Grammar, Grammar, dict[str, str]]:
    """Lines, blocks over kinds of lines, and the kinds of the lines seen so far."""
    return Grammar(grammars.YAML_LINES, lambda w: w), Grammar(grammars.YAML_BLOCKS, lambda w: w), {}


def _yaml_line(text: str, at: int) -> tuple[str, int]:
    """(tokens, end) of a line's content behind its marks; quoted and flow values may take in the lines
    that follow. An unfinished one ends in the token z."""
    out: list[str] = []
    begin, depth = at, 0
    while at < len(text):
        c = text[at]
        if c == "\n" and not depth:
            break
        if c in " \t\n":
            at += 1
        elif c == "#" and (at == begin or text[at - 1] in " \t\n"):
            n = text.find("\n", at)
            at = len(text) if n < 0 else n
        elif c == ":" and (text[at + 1 : at + 2] in ("", " ", "\n", "\t") or depth and (text[at + 1] in "[]{}," or out[-1] in "s]}")):
            out.append(c)
            at += 1
        elif depth and c in "]}," or c in "[{" and (depth or not out or out[-1] not in "ps]}"):
            depth += (c in "[{") - (c in "]}")
            out.append(c)
            at += 1
        elif c in "\"'" and (not out or out[-1] not in "ps"):
            m = _YAML_QUOTED[c].match(text, at)
            if not m:
                return "".join([*out, "z"]), len(text)
            out.append("s")
            at = m.end()
        elif c in "&!" and (not out or out[-1] not in "ps"):
            at = _YAML_PROPERTY.match(text, at).end()
        elif c in "|>" and not depth and _YAML_SCALAR_HEAD.match(text, at):
            out.append("h")
            at = _YAML_SCALAR_HEAD.match(text, at).end()
        else:
            m = (_YAML_FLOW_PLAIN if depth else _YAML_PLAIN).match(text, at)
            out.append("z" if c in "@`%|>]}," or not m else "p")
            at = m.end() if m else at + 1
    return "".join(out) + ("z" if depth else ""), at


_YAML_MARK = re.compile(r"[-?:](?=\s|$)[ \t]*(?:(?<=[ \t])#[^\n]*)?")


def yaml_valid(text: str) -> bool:
    """Whether each line derives a kind of line, and the kinds with their indentation a document."""
    if "\t" in text and re.search(r"^ *\t+ *[^\s#]", text, re.M):
        return False
    if re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", text):
        return False
    text = text.lstrip("\ufeff").replace("\r\n", "\n")
    lines, blocks, known = _yaml_grammars()
    out: list[str] = []
    stack: list[int] = []

    def place(kind: str, column: int) -> bool:
        if not stack:
            stack.append(column)
        if column > stack[-1]:
            out.append("{")
            stack.append(column)
        while column < stack[-1] and len(stack) > 1:
            stack.pop()
            out.append("}")
        out.append(kind)
        return column == stack[-1]

    #: Columns beyond which lines belong to a block scalar, or go on with a plain one.
    skip: int | None = None
    runs_on: int | None = None
    at = 0
    while at < len(text):
        n = text.find("\n", at)
        n = len(text) if n < 0 else n
        row = text[at:n]
        begin = at
        body = row.lstrip(" ")
        width = len(row) - len(body)
        at += width
        if not body.strip() or skip is not None and width > skip or body[0] == "#":
            at = n + 1
            continue
        skip = None
        if not width and (body in ("---", "...") or body.startswith(("--- ", "... ", "%"))):
            out.extend("}" * (len(stack) - 1) + "D")
            stack.clear()
            runs_on = None
            skip = -1 if re.match(r"--- +[|>]", body) else None
            at = n + 1
            continue
        if runs_on is not None and width > runs_on:
            if re.search(r":(?:\s|$)", re.sub(r"\s#.*", "", row)):
                return False
            at = n + 1
            continue
        runs_on = None
        parent = -1
        while (m := _YAML_MARK.match(text, at, n)) and (text[at] != ":" or out and at == begin + width):
            if not place({"-": "L", "?": "E", ":": "W"}[text[at]], at - begin):
                return False
            parent, at = at - begin, m.end()
        if at >= n:
            at = n + 1
            continue
        tokens, end = _yaml_line(text, at)
        column = at - begin
        if tokens:
            kind = known.get(tokens)
            if kind is None:
                if len(known) > MEMORY:
                    known.clear()
                kind = known[tokens] = min(lines.accepted(tokens, ["K", "V", "H", "X", "Q", "G"], lambda c: (c,)), default="")
            if not kind or not place(kind, column):
                return False
            if parent < 0 and len(stack) > 1:
                parent = stack[-2]
            if tokens[-1] == "p":
                runs_on = column if kind == "V" else parent
            elif tokens[-1] == "h":
                skip = column if kind == "H" else parent
        n = text.find("\n", end)
        at = len(text) if n < 0 else n + 1
    out.extend("}" * (len(stack) - 1))
    rows = re.sub(r"V{2,}", "V", "".join(out))
    labels = Labels()
    n = 1
    while n:
        rows, n = re.subn(r"\{([^{}]*)\}", lambda m: labels.char("B", blocks.accepted(m[1], ["Node"], labels)), rows)
    return bool(blocks.accepted(rows, ["File"], labels))


_HEX = str.maketrans(dict.fromkeys("0123456789abcdefABCDEF", "f"))


@lru_cache(maxsize=1)
def _properties_grammar() -> tuple[Grammar, dict[str, bool]]:
    return Grammar(grammars.PROPERTIES, lambda w: w), {}


def properties_valid(text: str) -> bool:
    """Whether each line with escapes derives one; all others do."""
    grammar, known = _properties_grammar()
    for line in text.split("\n"):
        if "\\" not in line:
            continue
        # The five characters after each backslash tell all.
        tokens = re.sub(r"[^\\uf]+", "c", line.translate(_HEX))
        tokens = re.sub(r"(?<![\\u])(?<!\\uf)(?<!\\uff)(?<!\\ufff)[cfu]+(?=[cfu])", "", tokens) if len(tokens) > 64 else tokens
        ok = known.get(tokens)
        if ok is None:
            if len(known) > MEMORY:
                known.clear()
            ok = known[tokens] = bool(grammar.accepted(tokens, ["Line"], lambda c: (c,)))
        if not ok:
            return False
    return True


_JSON_STRICT = re.compile(r'\\(?!["\\/bfnrtu])|\\u(?![0-9a-fA-F]{4})')


_PY_STRING = re.compile(r"#[^\n]*|(?<!\w)([A-Za-z]{0,2})('''|\"\"\"|'|\")")


def _string_end(t: str, at: int, quote: str, formatted: bool) -> int:
    """Where a Python string whose content begins there ends; -1 where it does not."""
    while at < len(t):
        c = t[at]
        if c == "\\":
            if formatted and t.startswith("N{", at + 1):
                at = t.find("}", at)
                if at < 0:
                    return -1
            at += 1 if formatted and t[at + 1 : at + 2] == "{" else 2
        elif t.startswith(quote, at):
            return at + len(quote)
        elif formatted and c == "{":
            at = at + 2 if t[at + 1 : at + 2] == "{" else _field_end(t, at + 1, quote)
            if at < 0:
                return -1
        elif c == "\n" and len(quote) == 1:
            return -1
        else:
            at += 1
    return -1


def _field_end(t: str, at: int, quote: str) -> int:
    """Where a replacement field of a formatted string ends, over strings of any quote inside."""
    depth, spec = 0, False
    while at < len(t):
        c = t[at]
        m = None if spec else _PY_STRING.match(t, at)
        if m:
            at = m.end() if m[0][0] == "#" else _string_end(t, m.end(), m[2], bool(set(m[1]) & set("fFtT")))
            if at < 0:
                return -1
            continue
        if spec and t.startswith(quote, at):
            return -1
        if spec and c == "{":
            at = _field_end(t, at + 1, quote)
            if at < 0:
                return -1
            continue
        if c in ")]}" and not depth:
            return at + 1 if c == "}" else -1
        depth += (c in "([{") - (c in ")]}") if not spec else 0
        spec |= c == ":" and not depth
        at += 1
    return -1


def plain_strings(t: str) -> str:
    """A Python text with formatted strings as empty ones, so that quotes nested in their fields do not matter."""
    out, done, at = [], 0, 0
    while True:
        m = _PY_STRING.search(t, at)
        if not m:
            return "".join([*out, t[done:]])
        if m[0][0] == "#":
            at = m.end()
            continue
        formatted = bool(set(m[1]) & set("fFtT"))
        end = _string_end(t, m.end(), m[2], formatted)
        if end < 0:
            return t
        if formatted:
            out += [t[done : m.start()], m[2], m[2]]
            done = end
        at = end


_FORMATTED = re.compile(r"[fFtT][rR]?[\"']")


def valid(texts: pa.Array, lang: str) -> np.ndarray:
    """Whether each text parses in the language; empty texts do, unknown languages are not judged."""
    n = len(texts)
    if lang == "yaml":
        return np.array([yaml_valid(t or "") for t in texts.to_pylist()], dtype=bool)
    if lang == "properties":
        return np.array([properties_valid(t or "") for t in texts.to_pylist()], dtype=bool)
    if lang not in grammars.CONTEXTUAL:
        return np.ones(n, dtype=bool)
    s = lexmask.spans(texts, lang)
    ok = np.array(parser(lang).valid(skeletons(s)), dtype=bool) if n else np.ones(0, dtype=bool)
    ok &= ~s.broken
    if lang == "python" and not ok.all():
        again = {i: t for i in np.flatnonzero(~ok).tolist() if _FORMATTED.search(t := texts[i].as_py() or "")}
        again = {i: p for i, t in again.items() if (p := plain_strings(t)) != t}
        if again:
            s = lexmask.spans(pa.array(list(again.values())), lang)
            ok[list(again)] = np.array(parser(lang).valid(skeletons(s)), dtype=bool) & ~s.broken
    return ok
