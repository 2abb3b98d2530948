"""Comment and string masks by a table-driven automaton over Arrow buffers.

Bytes are classed by table lookup, the few that can change the state (quotes, slashes,
newlines and the like) become events, and the automaton of a language steps through the
events of all files of a batch in lock-step: step t advances every file that has more than t
events. Work is linear in the bytes, and no Python code runs for single characters.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: File extension to language.
LANGUAGE_OF = {
    "py": "python", "pyi": "python", "go": "go", "java": "java", "js": "javascript", "mjs": "javascript", "cjs": "javascript",
    "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "json": "json", "yaml": "yaml", "yml": "yaml", "properties": "properties",
    "c": "c", "h": "c", "cc": "c", "cpp": "c", "hpp": "c", "cs": "c", "rs": "c", "kt": "java", "scala": "java", "sh": "shell", "rb": "shell",
    "toml": "shell", "ini": "properties", "cfg": "properties", "env": "properties",
}

CODE, COMMENT, STRING, REGEX, KEY, TEMPLATE = range(6)

#: Event classes.
(NONE, NL, DQ, DQ3, SQ, SQ3, BT, BSX, BSE, SL, SS, SM, RX, MS, MS0, HS, DB, LB, RB, LK, RK, SEP) = range(22)


def language_of(path: str | None) -> str:
    """The language that the extension of the path stands for; '' where it stands for none."""
    return LANGUAGE_OF.get((path or "").rsplit("/", 1)[-1].rsplit("\\", 1)[-1].rpartition(".")[2].lower(), "")


@dataclass(frozen=True)
class Table:
    step: np.ndarray
    kind: np.ndarray
    #: States in which the end of a line or of the file is an error.
    line_error: np.ndarray
    file_error: np.ndarray
    #: States of texts that nest deeper than the table counts.
    deep: np.ndarray


def _c_like(lang: str, exact: bool = False):
    """The automaton; unless exact, what its table does not count ends in the state `deep`."""
    triple = lang in ("java", "python")
    js = lang in ("javascript", "typescript")
    raw_bt = lang == "go"
    python = lang == "python"
    shell = lang == "shell"

    def step(s: tuple, c: int) -> tuple:
        m, stack = s
        if m == "code":
            if c in (DQ, DQ3) and not (c == DQ3 and triple):
                return "dq", stack
            if c == DQ3:
                return "dqo2", stack
            if c in (SQ, SQ3) and not (c == SQ3 and python):
                return "sq", stack
            if c == SQ3:
                return "sqo2", stack
            if c == BT and (raw_bt or js):
                return "raw" if raw_bt else "tpl", stack
            if c == SS and not python and not shell:
                return "lc", stack
            if c == SM and not python and not shell:
                return "bcs", stack
            if c == RX and js:
                return "re", stack
            if c == HS and (python or shell):
                return "lc", stack
            if js and stack and c == LB:
                return (m, stack[:-1] + (stack[-1] + 1,)) if exact or stack[-1] < 3 else ("deep", ())
            if js and stack and c == RB:
                return (m, stack[:-1] + (stack[-1] - 1,)) if stack[-1] else ("tpl", stack[:-1])
            return s
        if m == "lc":
            return ("code", stack) if c == NL else s
        if m == "bcs":
            return ("bc", stack) if c != MS else ("bce", stack)
        if m == "bc":
            return ("bce", stack) if c in (MS, MS0) else s
        if m == "bce":
            return "code", stack
        if m in ("dq", "sq"):
            if c == BSX:
                return m + "e", stack
            if c == NL and not shell or c in ((DQ, DQ3) if m == "dq" else (SQ, SQ3)):
                return "code", stack
            return s
        if m in ("dqe", "sqe", "tqde", "tqse", "tple", "ree", "rce"):
            return {"dqe": "dq", "sqe": "sq", "tqde": "tqd", "tqse": "tqs", "tple": "tpl", "ree": "re", "rce": "rc"}[m], stack
        if m in ("dqo2", "sqo2"):
            return m[:2] + "o1", stack
        if m in ("dqo1", "sqo1"):
            return "tq" + m[0], stack
        if m in ("tqd", "tqs"):
            if c == BSX:
                return m + "e", stack
            return (m + "c2", stack) if c == (DQ3 if m == "tqd" else SQ3) else s
        if m in ("tqdc2", "tqsc2"):
            return m[:3] + "c1", stack
        if m in ("tqdc1", "tqsc1"):
            return "code", stack
        if m == "raw":
            return ("code", stack) if c == BT else s
        if m == "tpl":
            if c == BSX:
                return "tple", stack
            if c == BT:
                return "code", stack
            return s if c != DB else ("sub", stack) if exact or len(stack) < 2 else ("deep", ())
        if m == "sub":
            return "code", stack + (0,)
        if m == "deep":
            return s
        if m in ("re", "rc"):
            if c == BSX:
                return m + "e", stack
            if c == NL or m == "re" and c in (SL, SS, SM, RX):
                return "code", stack
            return {LK: "rc", RK: "re"}.get(c, m), stack
        raise AssertionError(m)

    def kind(s: tuple) -> int:
        m = s[0]
        if m in ("code", "sub", "deep"):
            return CODE
        if m in ("lc", "bcs", "bc", "bce"):
            return COMMENT
        if m in ("tpl", "tple"):
            return TEMPLATE
        return REGEX if m in ("re", "rc", "ree", "rce") else STRING

    return ("code", ()), step, kind, ("dq", "sq", "re", "rc"), ("dq", "sq", "dqe", "sqe", "re", "rc", "bc", "bcs", "tqd", "tqs", "raw", "tpl", "tple")


def _json():
    def step(s: tuple, c: int) -> tuple:
        if s[0] == "code":
            return ("dq",) if c in (DQ, DQ3) else s
        if s[0] == "dqe":
            return ("dq",)
        return ("dqe",) if c == BSX else ("code",) if c in (DQ, DQ3, NL) else s

    return ("code",), step, lambda s: CODE if s[0] == "code" else STRING, ("dq",), ("dq", "dqe")


def _config(lang: str):
    """Keys up to the separator, then values; comments where HS was classed so."""

    def step(s: tuple, c: int) -> tuple:
        m = s[0]
        if m == "key":
            return ("val",) if c == SEP else ("lc",) if c == HS else ("nl",) if c == NL else ("ql",) if c == DQ and lang == "yaml" else ("qs",) if c == SQ and lang == "yaml" else s
        if m == "nl":
            return ("lc",) if c == HS else ("val",) if c == SEP else ("nl",) if c == NL else ("ql",) if c == DQ and lang == "yaml" else ("qs",) if c == SQ and lang == "yaml" else ("key",)
        if m == "lc":
            return ("nl",) if c == NL else s
        if m == "val":
            return ("vale",) if c == BSX and lang == "properties" else ("nl",) if c == NL else ("lc",) if c == HS and lang == "yaml" else ("vq",) if c == DQ and lang == "yaml" else ("vs",) if c == SQ and lang == "yaml" else s
        if m == "vale":
            return ("val",)
        if m in ("vq", "ql"):
            return (m + "e",) if c == BSX else ("val",) if c in (DQ, DQ3) else s
        if m in ("vqe", "qle"):
            return (m[:2],)
        return ("val",) if c in (SQ, SQ3) else s

    kinds = {"key": KEY, "nl": KEY, "lc": COMMENT}
    return ("nl",), step, lambda s: kinds.get(s[0], STRING), (), ("vq", "vs", "ql", "qs")


@lru_cache(maxsize=None)
def table(lang: str) -> Table:
    start, step, kind, line_error, file_error = (
        _json() if lang == "json" else _config(lang) if lang in ("yaml", "properties") else _c_like(lang)
    )
    states, todo, rows = {start: 0}, [start], []
    while todo:
        s = todo.pop(0)
        row = [states[s]]
        for c in range(1, 22):
            t = step(s, c)
            if t not in states:
                states[t] = len(states)
                todo.append(t)
            row.append(states[t])
        rows.append(row)
    order = list(states)
    at = lambda f: np.array([f(s) for s in order])
    return Table(
        np.array(rows, dtype=np.uint16), at(kind).astype(np.uint8), at(lambda s: s[0] in line_error), at(lambda s: s[0] in file_error), at(lambda s: s[0] == "deep")
    )


_BYTES = {"\n": NL, '"': DQ, "'": SQ, "`": BT, "\\": BSX, "/": SL, "*": MS, "#": HS, "$": DB, "{": LB, "}": RB, "[": LK, "]": RK}


@lru_cache(maxsize=None)
def _lut(lang: str) -> np.ndarray:
    only = {
        "json": '\n"\\', "yaml": "\n\"'\\#:", "properties": "\n\\#!=:", "python": "\n\"'\\#", "go": "\n\"'`\\/*", "java": "\n\"'\\/*",
        "c": "\n\"'\\/*", "shell": "\n\"'\\#",
    }.get(lang, "\n\"'`\\/*${}[]")
    lut = np.zeros(256, dtype=np.uint8)
    for ch in only:
        lut[ord(ch)] = _BYTES.get(ch, SEP)
    if lang == "properties":
        lut[ord("!")] = HS
    return lut


def running(mask: np.ndarray) -> np.ndarray:
    """Counts of true values before each position and at the end, in as few bytes as fit."""
    out = np.zeros(len(mask) + 1, dtype=np.int32 if len(mask) < 1 << 31 else np.int64)
    np.cumsum(mask, out=out[1:])
    return out


@dataclass
class Spans:
    """Spans that are not code, in order: file index, byte range, kind; buffers of the batch."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    file: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    kind: np.ndarray
    #: Files with a string cut by the end of its line, or a string or comment open at the end.
    broken: np.ndarray
    #: Spans that the end of the file closes.
    open: np.ndarray


_REGEX_AFTER = np.zeros(256, dtype=bool)
_REGEX_AFTER[[ord(x) for x in "(,=:[!&|?{;+-*%~^<>\n\0"]] = True
_KEYWORD_BEFORE_REGEX = ("return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "yield", "await")
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 13, 32]] = True


#: A slash behind these brackets begins a regular expression: a condition, or a block that ended on an earlier line.
_HEAD = re.compile(rb"(?<![\w$.])(?:if|while|for|with)\s*(?:await\s*)?\Z")


def _after_condition(data: np.ndarray, begin: int, close: int) -> bool:
    """Whether the round bracket that closes there ends the head of a statement."""
    depth, at = 1, close
    blob = data[begin:close].tobytes()
    at -= begin
    while depth:
        a, b = blob.rfind(b"(", 0, at), blob.rfind(b")", 0, at)
        if a < 0:
            return False
        at = max(a, b)
        depth += 1 if b > a else -1
    return bool(_HEAD.search(blob[max(0, at - 24) : at]))


def _mark_regex(data: np.ndarray, pos: np.ndarray, begin: np.ndarray) -> np.ndarray:
    p = pos - 1
    while True:
        on = (p >= begin) & _SPACE[data[np.maximum(p, 0)]]
        if not on.any():
            break
        p = np.where(on, p - 1, p)
    prev = np.where(p >= begin, data[np.maximum(p, 0)], 0)
    for i in ((prev == 47) & (data[np.maximum(p - 1, 0)] == 42)).nonzero()[0]:
        # What stands before a comment decides.
        p[i] = data[begin[i] : p[i]].tobytes().rfind(b"/*") + begin[i] - 1
        while p[i] >= begin[i] and _SPACE[data[p[i]]]:
            p[i] -= 1
        prev[i] = data[p[i]] if p[i] >= begin[i] else 0
    out = _REGEX_AFTER[prev]
    for i in (prev == 41).nonzero()[0]:
        out[i] = _after_condition(data, int(begin[i]), int(p[i]))
    for i in (prev == 125).nonzero()[0]:
        out[i] = 10 in data[p[i] + 1 : pos[i]] and b"/" in data[pos[i] + 1 : pos[i] + 500].tobytes().split(b"\n", 1)[0]
    letter = ((prev >= 97) & (prev <= 122)).nonzero()[0]
    for i in letter:
        tail = bytes(data[max(begin[i], p[i] - 9) : p[i] + 1])
        word = tail.rsplit(b" ", 1)[-1]
        k = len(word)
        while k and (word[k - 1 : k].isalnum() or word[k - 1 : k] in b"_$."):
            k -= 1
        out[i] = word[k:].decode("latin-1") in _KEYWORD_BEFORE_REGEX
    return out


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, start and end of each text; nulls are empty. The array may be string or binary."""
    if not pa.types.is_large_binary(texts.type) and not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string() if pa.types.is_string(texts.type) else pa.large_binary())
    _, offsets, values = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, dtype=np.uint8)
    return data, off[:-1].copy(), off[1:].copy()


def shebang_end(data: np.ndarray, begin: int, end: int) -> int:
    """Where a first line that names an interpreter ends; `begin` where there is none."""
    if data[begin : begin + 2].tobytes() != b"#!":
        return begin
    n = data[begin:end].tobytes().find(b"\n")
    return end if n < 0 else begin + n


def no_spans(texts: pa.Array) -> Spans:
    """Texts of no known language: buffers without any span."""
    data, starts, ends = buffers(texts)
    none = np.zeros(0, dtype=np.int64)
    return Spans(data, starts, ends, none, none, none, np.zeros(0, dtype=np.uint8), np.zeros(len(starts), dtype=bool), np.zeros(0, dtype=bool))


def spans(texts: pa.Array, lang: str) -> Spans:
    """The spans of texts that all have one language."""
    data, starts, ends = buffers(texts)
    n = len(starts)
    t = table(lang)
    low, high = (int(starts[0]), int(ends[-1])) if n else (0, 0)
    ev = np.flatnonzero(_lut(lang)[data[low:high]]).astype(np.int64) + low
    lo, hi = np.searchsorted(ev, starts), np.searchsorted(ev, ends)
    of = np.repeat(np.arange(n), hi - lo)
    cls = _lut(lang)[data[ev]]
    if len(ev):
        end, begin = ends[of], starts[of]
        at = lambda k: np.where((ev + k < end) & (ev + k >= begin), data[np.clip(ev + k, 0, len(data) - 1)], 0)
        n1, n2, p1 = at(1), at(2), at(-1)
        byte = data[ev]
        same = (n1 == byte) & (n2 == byte)
        cls = np.where((cls == DQ) & same, DQ3, cls)
        cls = np.where((cls == SQ) & same, SQ3, cls)
        cls = np.where((cls == BSX) & (_lut(lang)[n1] == NONE), BSE, cls)
        cls = np.where((cls == DB) & (n1 != ord("{")), NONE, cls)
        if lang in ("go", "java", "javascript", "typescript", "c"):
            slash = byte == ord("/")
            cls = np.where(slash & (n1 == ord("/")), SS, cls)
            cls = np.where(slash & (n1 == ord("*")), SM, cls)
            star = byte == ord("*")
            cls = np.where(star & (n1 != ord("/")), NONE, cls)
            cls = np.where(star & (n1 == ord("/")) & (p1 == ord("/")), MS0, cls)
            if lang in ("javascript", "typescript"):
                for f in np.flatnonzero(data[np.minimum(starts, max(len(data) - 1, 0))] == 35).tolist():
                    cls[int(lo[f]) : int(np.searchsorted(ev, shebang_end(data, int(starts[f]), int(ends[f]))))] = NONE
                plain = np.flatnonzero(cls == SL)
                cls[plain[_mark_regex(data, ev[plain], begin[plain])]] = RX
        elif lang in ("yaml", "properties"):
            # A mark counts as a comment only at the start of its line or (YAML) after a blank.
            bol = _line_start(data, ev, begin)
            mark = cls == HS
            cls = np.where(mark & ~(bol | ((lang == "yaml") & ((p1 == 32) | (p1 == 9)))), NONE, cls)
            if lang == "yaml":
                sep = (n1 == 32) | (n1 == 10) | (n1 == 13) | (n1 == 0)
                cls = np.where((cls == SEP) & ~sep, NONE, cls)
                quote = (cls == DQ) | (cls == SQ) | (cls == DQ3) | (cls == SQ3)
                # Quotes open only where a scalar begins; inside quotes any of them counts.
                inner = quote & ~(bol | ((p1 == 32) | (p1 == 9) | np.isin(p1, [ord(x) for x in ":,[{-("])))
                cls = np.where(inner & (byte == 34), DQ3, np.where(inner & (byte == 39), SQ3, np.where(quote, np.where(byte == 34, DQ, SQ), cls)))
    if len(ev) > 1:
        # An escaped character that is no event after all ends its escape at once.
        cls[:-1] = np.where((cls[:-1] == BSX) & (np.diff(ev) == 1) & (cls[1:] == NONE), BSE, cls[:-1])
    before = np.zeros(len(ev), dtype=np.uint16)
    after = np.zeros(len(ev), dtype=np.uint16)
    counts = hi - lo
    order = np.argsort(-counts, kind="stable")
    sorted_lo, sorted_n = lo[order], counts[order]
    state = np.zeros(n, dtype=np.uint16)
    active = n
    flat, width = t.step.ravel(), t.step.shape[1]
    for k in range(int(sorted_n[0]) if n else 0):
        while sorted_n[active - 1] <= k:
            active -= 1
        at_k = sorted_lo[:active] + k
        s = state[:active]
        before[at_k] = s
        s = flat[s.astype(np.intp) * width + cls[at_k]]
        after[at_k] = s
        state[:active] = s
    last = np.zeros(n, dtype=np.uint16)
    last[order] = state
    kb, ka, kl = t.kind[before], t.kind[after], t.kind[last]
    cut, file_cut = t.line_error[before], t.file_error[last]
    for f in np.flatnonzero(t.deep[last]).tolist():
        _exact(lang, slice(int(lo[f]), int(hi[f])), f, cls, kb, ka, kl, cut, file_cut)
    broken = np.zeros(n, dtype=bool)
    broken[of[(cls == NL) & cut]] = True
    broken |= file_cut
    change = kb != ka
    # A line's end belongs to what follows; the brace after a template's expression is code.
    skip = ((cls == NL) & (ka != kb)) | ((cls == RB) & (ka == TEMPLATE))
    open_at = change & (ka != CODE)
    close_at = change & (kb != CODE)
    s_pos = ev[open_at] + np.where(skip[open_at], 1, 0)
    e_pos = ev[close_at] + np.where((cls[close_at] == NL) | (ka[close_at] != CODE), 0, 1)
    s_file, s_kind, e_file = of[open_at], ka[open_at], of[close_at]
    first = t.kind[0]
    if first != CODE:
        s_pos, s_file = np.concatenate([starts, s_pos]), np.concatenate([np.arange(n), s_file])
        s_kind = np.concatenate([np.full(n, first, dtype=np.uint8), s_kind])
    still = np.flatnonzero(kl != CODE)
    is_open = np.concatenate([np.zeros(len(e_pos), dtype=bool), np.ones(len(still), dtype=bool)])
    e_pos, e_file = np.concatenate([e_pos, ends[still]]), np.concatenate([e_file, still])
    so, eo = np.lexsort((s_pos, s_file)), np.lexsort((e_pos, e_file))
    return Spans(data, starts, ends, s_file[so], s_pos[so], e_pos[eo], s_kind[so], broken, is_open[eo])


def _exact(lang: str, events: slice, f: int, cls: np.ndarray, kb: np.ndarray, ka: np.ndarray, kl: np.ndarray, cut: np.ndarray, file_cut: np.ndarray) -> None:
    """Kinds and errors of one text by the automaton with its stack, for nesting of any depth."""
    s, step, kind, line_error, file_error = _c_like(lang, exact=True)
    for i in range(events.start, events.stop):
        kb[i], cut[i] = kind(s), s[0] in line_error
        # As in the table, class 0 changes nothing.
        s = step(s, int(cls[i])) if cls[i] else s
        ka[i] = kind(s)
    kl[f], file_cut[f] = kind(s), s[0] in file_error


def _line_start(data: np.ndarray, pos: np.ndarray, begin: np.ndarray) -> np.ndarray:
    p = pos - 1
    while True:
        ch = data[np.maximum(p, 0)]
        on = (p >= begin) & ((ch == 32) | (ch == 9) | (ch == 0xEF) | (ch == 0xBB) | (ch == 0xBF))
        if not on.any():
            return (p < begin) | (ch == 10)
        p = np.where(on, p - 1, p)
