"""Credentials embedded in source code (problem 6).

Method: files are tokenised lexically by the byte automaton; a literal is a secret where it is
assigned or passed to an identifier named like a credential and is no placeholder, reference
or name, or where its own form gives it away (issued tokens, logins in URLs and connection
texts, private keys). Only the contents of literals are replaced; delimiters and escapes stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codequarry.llm import batches, lexmask

#: Words that name a credential, as the last word of an identifier.
_WORDS = set(
    "password passwd pass pwd passphrase passcode secret secrets token credential credentials cred creds kennwort passwort geheimnis clave contrasena contraseña "
    "motdepasse mdp senha parola пароль ключ токен 密码 密钥 口令 パスワード apikey accesskey secretkey privatekey authtoken accesstoken refreshtoken "
    "apitoken clientsecret userpass dbpass dbpassword smtppass authkey signingkey encryptionkey masterkey pin pem auth authorization bearer jwt "
    "accountkey sharedaccesskey hmac salt pat".split()
) - {"salt", "auth", "pin", "ключ"}
#: Words before `key` (and `pem`, `auth`) that make it a credential.
_BEFORE_KEY = set("api access secret private signing encryption encrypt decryption auth master service account storage ssh tls ssl client consumer app hmac jwt session license deploy shared aes rsa".split())
_TAIL = set("value val str string text raw b64 base64 hex prod dev live default old new current env main backup test".split())
_SPLIT = re.compile(r"[^\w]+|_+|(?<=[a-zà-ÿ0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=\D)(?=\d)")
_NAME = r"[A-Za-z_$\u00c0-\u024f\u0400-\u04ff\u3040-\u30ff\u4e00-\u9fff][\w$.\-]*"
#: The name that the literal after this text is assigned or passed to.
_ASSIGNED = re.compile(
    rf"(?:[\"'`]?(?<![\w$])({_NAME})[\"'`]?\]?\)?\s*(?::\s*[\w.]+(?:<[^<>]*>)?(?:\[\])*\??\s*(?==))?(?::=|=>|===?|!==?|=|:)|\b({_NAME})\s*\(|[\"'`]({_NAME})[\"'`]\s*,)\s*[brufBRUF]{{0,2}}$"
)
_LEFT = re.compile(rf"^\s*(?:(?:public|private|protected|static|final|readonly|export|const|let|var|val|String|string|char|auto|self\.|this\.|{_NAME})\s+|self\.|this\.)*[\"'`]?({_NAME})[\"'`]?\s*(?::\s*[\w<>\[\], .|?*]+?\s*)?(?::=|=)(?!=)")
#: Fixed patterns: values that stand for a secret kept elsewhere or not filled in.
_PLACEHOLDER = re.compile(
    r"(?i)^(?:\*+|x+|\.+|-+|_+|•+|#+|\?+|0+|none|null|nil|undefined|todo|tbd|n/?a|empty|unset|redacted|\[?redacted\]?|<[^<>]*>|\[[^\]]*\]|%[\w]+%|\$\w+|\$\{.*|\$\(.*|#\{.*|\{\{.*|\{%.*|\{\w*\}|@\w+@|__\w+__)$"
    r"|change[_\- ]?me|replace[_\- ]?(?:me|this|with)|your[_\-]|^your|<your|insert|placeholder|example|dummy|sample|fake[_\-]|todo|fixme|redacted|not[_\- ]?set|fill[_\- ]?in|put[_\- ]?|enter[_\- ]|x{4,}|\*{4,}|\.{3}$"
)
_REFERENCE = re.compile(
    r"(?i)\$\{|\$\(|\{\{|\}\}|<%|%\([\w.]+\)s|^%s$|^(?:env|vault|ssm|secret|secrets|secretsmanager|keyring|keychain|op|sm|aws|gcp|azure|kms|file|ref|arn|config|param|awssm|k8s|consul|doppler|pass)[:+]|os\.environ|process\.env|getenv|^[\w.-]+\.(?:pem|key|crt|txt|json|ya?ml)$|^sha(?:1|256|384|512)[:\-]|^md5:"
)
_ALPHA = re.compile(r"^[A-Za-z\u00c0-\u024f]+(?:[_\-.: /][A-Za-z\u00c0-\u024f]+)*$")
#: A name with a number, as of fields and variables: words and one short number.
_FIELD = re.compile(r"^(?:[A-Z]?[a-z]{2,}|[A-Z]{2,})(?:[_\-. ](?:[A-Z]?[a-z]{2,}|[A-Z]{2,})|[A-Z][a-z]{2,})*[_\-.]?v?\d{1,3}$")
_PATH = re.compile(r"^(?:[.~]{0,2}/[a-z][a-z0-9_.\-]*)+/?$")
_OPAQUE = re.compile(r"[^\s]{6,}\Z")
#: Fixed patterns: forms of issued tokens.
_ISSUED = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA|AGPA|AIDA|AROA)[0-9A-Z]{16}(?![0-9A-Za-z])|gh[opusr]_[A-Za-z0-9]{20,}|github_pat_\w{22,}|glpat-[\w\-]{16,}|xox[abeoprs]-[\w\-]{10,}|AIza[\w\-]{30,}"
    r"|[sr]k_(?:live|test)_[A-Za-z0-9]{10,}|eyJ[\w\-]{6,}\.eyJ[\w\-]{6,}\.[\w\-]{6,}|SG\.[\w\-]{16,}\.[\w\-]{16,}|npm_[A-Za-z0-9]{30,}|pypi-[\w\-]{30,}|dop_v1_[a-f0-9]{40,}|sk-(?:ant-|proj-)?[A-Za-z0-9_\-]{20,})"
)
#: Issued prefixes with which a literal may begin that is glued from several.
_SCHEME = re.compile(r"^\s*(?:Bearer|Basic|Token)\s+([A-Za-z0-9+/=_.\-]{8,})\s*$")
#: Begins at the marks after the scheme, so long words without any are passed over at once.
_URL = re.compile(r"(?<=[\w+.\-])://([^\s:/@\"'<>?#]*):([^\s/\"'<>]+?)@[\w.\-\[{$%]")
_CONNECTION = re.compile(r"(?i)(?:^|[;&?\s,\"'])(?:password|passwd|pwd|pass|secret|accountkey|account_key|sharedaccesskey|sharedsecret|auth_?token|access_?key)\s*=\s*([^;&\"'\s]+)")
_KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_KEY_BODY = re.compile(r"(?:\\[nr]|\\?\r?\n|[\s\"'`+,;|>#*/\\]|\w+-\w+: [^\n]*)*[A-Za-z0-9+/=]{8,}(?:\\[nr]|[\s\"'`+,;\\]|[A-Za-z0-9+/=]){8,}")
_KEY_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: What issued tokens, logins and headers begin with or hold, in lower case.
_FORMS = (
    "pass pwd secret token key cred motde auth bearer basic jwt akia asia agpa aida aroa gho_ ghp_ ghu_ ghs_ ghr_ github_pat_ glpat xoxa xoxb xoxe xoxo xoxp xoxr xoxs aiza k_live k_test "
    "eyj sg. npm_ pypi- dop_v1 sk- ://"
).split()


def _hints() -> list[bytes]:
    """Parts, in lower case, of which any line with a secret has one, or a match of _HINT.

    A word of _WORDS is left out where a shorter part is in it, or where _HINT stands for it.
    The last two are the letters beyond ASCII that fold to k and s.
    """
    parts: list[str] = list(_FORMS)
    for w in sorted(_WORDS, key=lambda w: (len(w), w)):
        if w != "pat" and w.upper().isascii() | (w.upper() == w) and not any(p in w for p in parts):
            parts.append(w)
    return [p.encode() for p in parts] + ["\u212a".encode(), "\u017f".encode()]


def _any_case(word: str) -> bytes:
    return b"".join(b"(?:" + b"|".join(re.escape(x.encode()) for x in sorted({c, c.upper()})) + b")" for c in word)


_HINTS = _hints()
#: Hints that are no plain parts: words with letters beyond ASCII in any case, pat only as a word of
#: its own (not path, pattern), one-time, and places where literals are glued.
_HINT = [
    re.compile(b"|".join(_any_case(w) for w in sorted(_WORDS) if not w.isascii() and w.upper() != w)),
    re.compile(rb"[pP][aA][tT](?![a-z])"),
    re.compile(rb"[oO][nN][eE][^A-Za-z\s]*[tT][iI][mM][eE]"),
    re.compile(rb"[\"'`][^\S\n]*(?:\+|\.\.?)?[^\S\n]*[brufBRUF]{0,2}[\"'`]"),
]


@dataclass(frozen=True)
class Secret:
    file: int
    line: int
    kind: str
    name: str
    #: Byte ranges of the contents to redact.
    ranges: tuple[tuple[int, int], ...]


def credential_name(name: str | None) -> bool:
    """Whether an identifier names a credential: its last word does, as in db_passwd2 or authToken."""
    if not name:
        return False
    words = [w.lower() for w in _SPLIT.split(name) if w and not w.isdigit()]
    words = [re.sub(r"\d+$", "", w) or w for w in words]
    while len(words) > 1 and words[-1] in _TAIL:
        words.pop()
    if not words or "public" in words or "pub" in words:
        return False
    last = words[-1]
    if last in ("key", "keys", "pem"):
        return last == "pem" and len(words) == 1 or len(words) > 1 and words[-2] in _BEFORE_KEY
    return last in _WORDS or words[-3:] == ["mot", "de", "passe"] or words[-2:] == ["one", "time"]


def name_like(value: str) -> bool:
    """Whether letters alone read as words or as an identifier and not as a random string."""
    if not _ALPHA.match(value):
        return False
    words = [w for w in _SPLIT.split(value) if w]
    if re.search(r"[_\-.: /]", value) and all(w.islower() or w.isupper() or w.istitle() for w in re.split(r"[_\-.: /]", value)):
        return True
    return sum(map(len, words)) >= 3.5 * len(words)


def usable(value: str) -> bool:
    """Whether a value can be a secret: opaque, no placeholder, reference, name or number."""
    v = value.strip()
    if len(v) < 6 or _PLACEHOLDER.search(v) or _REFERENCE.search(v) or name_like(v) or _FIELD.match(v):
        return False
    if _PATH.match(v) or not _OPAQUE.match(v) or re.fullmatch(r"[\d.,:\-/]+", v):
        return False
    if re.match(r"[a-z][\w+.\-]*://", v, re.I):
        return False
    if re.search(r"[%{][sdvq}]|^\w+\(.*\)$|^[\w.\-]+/[\w.\-+]+$", v) and not re.search(r"[A-Z].*\d|\d.*[A-Z]", v):
        return False
    return len(set(v)) > 3


def _scheme_before(value: str, at: int) -> bool:
    """Whether a letter is in the word that ends at a position."""
    at -= 1
    while at >= 0 and (value[at].isalnum() or value[at] in "_+.-"):
        if value[at].isascii() and value[at].isalpha():
            return True
        at -= 1
    return False


def inside(value: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of secrets that a text shows by its own form."""
    out = []
    for m in _ISSUED.finditer(value):
        if not re.search(r"EXAMPLE|example|x{6,}|X{6,}", m[0]):
            out.append((*m.span(), "issued token"))
    if "@" in value:
        for m in _URL.finditer(value):
            if _scheme_before(value, m.start()) and len(m[2]) >= 3 and not _PLACEHOLDER.search(m[2]) and not _REFERENCE.search(m[2]) and not re.match(r"[<{$%]", m[2]) and m[2].lower() not in ("password", "pass", "passwd", "pwd", "secret", "token"):
                out.append((*m.span(2), "login in a URL"))
    if "=" in value:
        several = None
        for m in _CONNECTION.finditer(value):
            if not usable(m[1]):
                continue
            if several is None:
                several = ";" in value or "&" in value or "?" in value or bool(re.search(r"(?:user|uid|host|server|dbname)\s*\w*\s*=", value, re.I))
            if several:
                out.append((*m.span(1), "connection text"))
    return out


def _content(raw: str) -> tuple[int, int]:
    """The range of a literal's content, without prefix and delimiters."""
    m = re.match(r"[rRbBuUfF]{0,2}(\"\"\"|'''|[\"'`])", raw)
    if not m:
        return 0, len(raw)
    end = len(raw) - len(m[1]) if raw.endswith(m[1]) and len(raw) >= m.end() + len(m[1]) else len(raw)
    return m.end(), end


_KEY_MARK = re.compile(rb"-----(BEGIN|END) (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: A line of a key in a literal or text, with the marks that may stand around; its end ends a key without END.
_KEY_ROW = re.compile(rb"(?:[\s\"'`+,;|>#*/\\]|\\[nr])*(?:\w+-\w+: [^\n]*|(?![a-z]{3,}\b)[A-Za-z0-9+/=]+(?:(?:\\[nr])+[A-Za-z0-9+/=]+)*)?[ \t\r\"'`+,;\\nr)]*\Z")
_KEY_RUN = re.compile(rb"(?:[\s+|>#*/]|\\[nr])*(?:[A-Za-z0-9+/=]|\\[nr])*")


def _key_body(blob: bytes, a: int, stop: int) -> str:
    """The text of a private key up to its END; without one, as far as lines have the form of a key."""
    mark = _KEY_MARK.search(blob, a, stop)
    if mark and mark[1] == b"END":
        return blob[a : mark.start()].decode("utf-8", "replace")
    at = a
    while at < stop:
        n = blob.find(b"\n", at, stop)
        n = stop if n < 0 else n
        row = blob[at:n]
        if not _KEY_ROW.match(row):
            # The key may end within the line, as where its literal does.
            at += len(_KEY_RUN.match(row)[0]) if at == a else 0
            break
        at = min(n + 1, stop)
    return blob[a:at].rstrip(b" \t\r\n\"'`;,)").decode("utf-8", "replace")


def find(texts: pa.Array, lang: str) -> list[Secret]:
    """The secrets of texts of one language, in order; a private key counts once, at its first line."""
    if not len(texts):
        return []
    # Files of unknown extension have no literals; their lines are looked at as text.
    s = lexmask.spans(texts, lang) if lang else lexmask.no_spans(texts)
    blob = s.data.tobytes()
    low, high = (int(s.starts[0]), int(s.ends[-1]))
    nl = np.flatnonzero(s.data == 10)
    config = lang in ("yaml", "properties")
    out: list[Secret] = []
    done_to = low
    order = np.argsort(s.lo, kind="stable")
    lo, hi, kind = s.lo[order], s.hi[order], s.kind[order]
    lines = _hinted(blob, low, high, nl, s.starts)
    if not config and lang:
        lines = sorted({*lines, *_wrapped(blob, lines, nl, s.ends, lo, hi, kind)})
    for f, k in lines:
        end = int(nl[k]) if k < len(nl) else high
        begin = max(int(nl[k - 1]) + 1 if k else 0, int(s.starts[f]))
        end = min(end, int(s.ends[f]))
        if begin < done_to or end <= begin:
            continue
        line_no = k - int(np.searchsorted(nl, s.starts[f])) + 1
        line = blob[begin:end].decode("utf-8", "replace")
        key = _KEY_BLOCK.search(line)
        if key:
            a = begin + len(line[: key.end()].encode())
            body = _key_body(blob, a, int(s.ends[f]))
            if _KEY_BODY.match(body) and not re.search(r"(?i)example|redacted|placeholder|\.\.\.|<[\w ]+>", body):
                b = a + len(body.encode())
                out.append(Secret(f, line_no, "private key", "", ((a, b),)))
                done_to = b
                continue
        if not lang:
            _free_text(out, f, line_no, blob, begin, end)
            continue
        if config:
            after = _config_block(out, f, line_no, line, blob, end, int(s.ends[f]), lang)
            if after:
                done_to = after
            else:
                _config_line(out, f, line_no, line, begin, lang)
            continue
        i, j = np.searchsorted(lo, begin), np.searchsorted(lo, end)
        # A span that began on an earlier line (a long comment or literal) is looked at as text.
        i0 = max(0, int(i) - 1)
        if i0 < i and hi[i0] > begin:
            _free_text(out, f, line_no, blob, begin, min(end, int(hi[i0])))
        spans = [(int(lo[x]), min(int(hi[x]), int(s.ends[f])), int(kind[x])) for x in range(int(i), int(j))]
        above = _above(blob, int(s.starts[f]), int(i), lo, hi, kind) if spans else ""
        _code_line(out, f, line_no, blob, begin, end, spans, above)
    return out


def _hinted(blob: bytes, low: int, high: int, nl: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
    """(file, line of the buffer) of lines that have one of the hints, in order."""
    text = blob.lower()
    # Where a text does not end with a line end, the next begins within the same line of the buffer.
    at: list[int] = [int(x) for x in starts if x > low and blob[x - 1] != 10]
    for hint in _HINTS:
        p = text.find(hint, low, high)
        while p >= 0:
            at.append(p)
            # One hit for a line is enough.
            q = text.find(b"\n", p, high)
            p = text.find(hint, q if q > 0 else high, high)
    for pattern in _HINT:
        at += [m.start() for m in pattern.finditer(blob, low, high)]
    pos = np.array(at, dtype=np.int64)
    pairs = np.unique(np.stack([np.searchsorted(starts, pos, side="right") - 1, np.searchsorted(nl, pos)]), axis=1) if at else np.zeros((2, 0), dtype=np.int64)
    return list(zip(*pairs.tolist(), strict=True))


_BLANK = re.compile(rb"[\s\\]*")


def _wrapped(blob: bytes, lines: list[tuple[int, int]], nl: np.ndarray, ends: np.ndarray, lo: np.ndarray, hi: np.ndarray, kind: np.ndarray) -> Iterator[tuple[int, int]]:
    """(file, line) of literals that follow one of the lines with nothing but blanks and comments between."""
    for f, k in lines:
        if k >= len(nl) or nl[k] >= ends[f]:
            continue
        at = int(nl[k])
        x = int(np.searchsorted(lo, at))
        if x and kind[x - 1] == lexmask.COMMENT and at < hi[x - 1] <= ends[f]:
            at = int(hi[x - 1])
        while x < len(lo) and lo[x] < ends[f] and _BLANK.match(blob, at).end() >= lo[x]:
            if kind[x] != lexmask.COMMENT:
                yield f, int(np.searchsorted(nl, lo[x]))
                break
            at = int(hi[x])
            x += 1


#: Bytes before a literal in which the name it is assigned to begins, or more where these begin within a name.
_NEAR = 300
_NAME_BYTE = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_$.-" + bytes(range(0x80, 0x100)))


def _back(blob: bytes, floor: int, end: int) -> int:
    """Where to begin to look for the name before a position."""
    a = max(floor, end - _NEAR)
    while a > floor and blob[a] in _NAME_BYTE and blob[a - 1] in _NAME_BYTE:
        a -= 1
    return a


def _above(blob: bytes, floor: int, x: int, lo: np.ndarray, hi: np.ndarray, kind: np.ndarray) -> str:
    """The end of the last line of code before the first literal of spans x, ..., without comments."""
    while x < len(lo) and kind[x] == lexmask.COMMENT:
        x += 1
    p = int(lo[x]) if x < len(lo) else len(blob)
    while True:
        while p > floor and blob[p - 1] in b" \t\r\n\\":
            p -= 1
        x -= 1
        if x < 0 or kind[x] != lexmask.COMMENT or not lo[x] < p <= hi[x]:
            break
        p = max(floor, int(lo[x]))
    a = _back(blob, max(floor, blob.rfind(b"\n", floor, p) + 1), p)
    return _OPEN.sub("=", blob[a:p].decode("utf-8", "replace")) + " "


#: Brackets that open between a name and its value.
_OPEN = re.compile(r"(?<![=!<>])=\s*\([\s(]*$")


#: A name and its value in running text, or as an element of markup.
_NAMED = re.compile(rf"({_NAME})[\"'`]?\s*(?::=|=>|=|:)\s*[\"'`]?([^\"'`\s;,<]+)|<({_NAME})>\s*([^<\s]+)\s*</")


def _free_text(out: list[Secret], f: int, line_no: int, blob: bytes, a: int, b: int) -> None:
    text = blob[a:b].decode("utf-8", "replace")
    ranges = []
    kind = name = ""
    for x, y, k in inside(text):
        p = a + len(text[:x].encode())
        ranges.append((p, p + len(text[x:y].encode())))
        kind = k
    for m in _NAMED.finditer(text):
        who, what = (1, 2) if m[1] else (3, 4)
        if credential_name(m[who]) and usable(m[what]):
            p = a + len(text[: m.start(what)].encode())
            ranges.append((p, p + len(m[what].encode())))
            kind, name = "assigned", m[who]
    if ranges:
        out.append(Secret(f, line_no, kind, name, tuple(dict.fromkeys(ranges))))


def _code_before(blob: bytes, begin: int, end: int, spans: list[tuple[int, int, int]]) -> bytes:
    """What stands in a line before a literal besides blanks and comments."""
    at, kept = begin, b""
    for a, b, _ in spans:
        if a >= end:
            break
        kept, at = kept + blob[at:a], b
    return (kept + blob[at:end]).strip()


def _code_line(out: list[Secret], f: int, line_no: int, blob: bytes, begin: int, end: int, spans: list[tuple[int, int, int]], above: str) -> None:
    literals = [x for x in spans if x[2] in (lexmask.STRING, lexmask.TEMPLATE)]
    for a, b, k in spans:
        if k == lexmask.COMMENT:
            _free_text(out, f, line_no, blob, a, min(b, end))
    if not literals:
        return
    # Literals that are joined by + or stand side by side are one value.
    chains: list[list[tuple[int, int, int]]] = []
    for x in literals:
        if chains:
            gap = blob[chains[-1][-1][1] : x[0]].strip()
            if gap in (b"", b"+", b".", b"..") and blob[chains[-1][-1][1] : x[0]].find(b"\n") < 0:
                chains[-1].append(x)
                continue
        chains.append([x])
    left = None
    for chain in chains:
        raws = [blob[a:b].decode("utf-8", "replace") for a, b, _ in chain]
        parts = [_content(r) for r in raws]
        value = "".join(r[x:y] for r, (x, y) in zip(raws, parts, strict=True))
        if not value:
            continue
        spot = lambda q, x, y: (chain[q][0] + len(raws[q][:x].encode()), chain[q][0] + len(raws[q][:y].encode()))  # noqa: B023, E731
        whole = tuple(spot(q, *parts[q]) for q in range(len(chain)) if parts[q][0] < parts[q][1])
        name = kind = ""
        ranges: list[tuple[int, int]] = []
        before = blob[_back(blob, begin, chain[0][0]) : chain[0][0]].decode("utf-8", "replace")
        m = _ASSIGNED.search(before)
        if not m and chain is chains[0] and not _code_before(blob, begin, chain[0][0], spans):
            m = _ASSIGNED.search(above)
        name = next((g for g in m.groups() if g), "") if m else ""
        scheme = _SCHEME.match(value)
        # Later lines of a literal are looked at as text, each by itself.
        inner = inside(value.split("\n", 1)[0])
        if credential_name(name) or name.lower() == "authorization":
            if scheme and usable(scheme[1]) or usable(value) or inner:
                kind = "assigned"
        if not kind and not inner:
            if left is None:
                row = blob[begin:end].decode("utf-8", "replace")
                lm = _LEFT.match(row)
                left = lm[1] if lm and begin + len(row[: lm.end()].encode()) <= literals[0][0] else ""
            if credential_name(left) and chain[0][0] > begin and (scheme and usable(scheme[1]) or usable(value)):
                kind, name = "assigned", left
        if not kind and scheme and usable(scheme[1]) and re.search(r"\d", scheme[1]) and len(scheme[1]) >= 12:
            kind = "authorization"
        if inner and (not kind or any(x[2] != "issued token" for x in inner)):
            kind = inner[0][2]
            if len(chain) == 1:
                x0 = parts[0][0]
                ranges = [spot(0, x0 + x, x0 + y) for x, y, _ in inner]
        if kind:
            at = line_no
            if "\n" in value and kind == "assigned":
                # The value stands within a literal of several lines.
                lead = value[: len(value) - len(value.lstrip())]
                at += lead.count("\n")
                if len(chain) == 1:
                    x0 = parts[0][0] + len(lead)
                    ranges = [spot(0, x0, x0 + len(value.strip()))]
            out.append(Secret(f, at, kind, name, tuple(ranges) or whole))


_YAML_LINE = re.compile(rf"^\s*(?:-\s+)?[\"']?({_NAME})[\"']?\s*:\s+(.*?)\s*$")
_PROP_LINE = re.compile(rf"^\s*({_NAME})\s*[=:\s]\s*(.*?)\s*$")


#: A key whose value begins on a later line: nothing, or the head of a block scalar.
_YAML_OPEN = re.compile(rf"^(\s*(?:-\s+)*)[\"']?({_NAME})[\"']?\s*:(?:\s+[!&]\S+)*(\s+[|>][+\-\d]*)?\s*(?:\s#.*)?$")
_PROP_OPEN = re.compile(rf"^\s*({_NAME})\s*(?:[=:]|(?<=\s))\s*(.*?)(?<!\\)(?:\\\\)*\\\r?$")


def _config_block(out: list[Secret], f: int, line_no: int, line: str, blob: bytes, end: int, stop: int, lang: str) -> int:
    """A secret whose value is on the lines after its key; where it ends, 0 if there is none."""
    m = (_YAML_OPEN if lang == "yaml" else _PROP_OPEN).match(line)
    if not m or not credential_name(m[2] if lang == "yaml" else m[1]):
        return 0
    #: Line, first byte and text of the parts of the value.
    parts: list[tuple[int, int, str]] = []
    name, block, at, no = (m[2], m[3], end + 1, line_no) if lang == "yaml" else (m[1], "", end + 1, line_no)
    if lang == "properties" and m[2]:
        parts.append((line_no, end - len(line.encode()) + len(line[: m.start(2)].encode()), m[2]))
    while at < stop:
        n = blob.find(b"\n", at, stop)
        n = stop if n < 0 else n
        row = blob[at:n].decode("utf-8", "replace")
        text, begin, no, at = row.strip(), at, no + 1, n + 1
        more = False
        if lang == "yaml":
            if not text:
                continue
            if len(row) - len(row.lstrip()) <= len(m[1]):
                break
            if not block:
                if text.startswith("#"):
                    continue
                text = re.sub(r"\s+#.*$", "", text) if text[0] not in "\"'" else text
                if not parts and (text[0] in "-[{&*!|>" and not text.startswith("--") or _YAML_LINE.match(row) or text.endswith(":")):
                    return 0
        else:
            more = (len(text) - len(text.rstrip("\\"))) % 2 == 1
            text = text[:-1] if more else text
        if text:
            parts.append((no, begin + len(row[: len(row) - len(row.lstrip())].encode()), text))
        if lang == "properties" and not more:
            break
    if not parts or lang == "properties" and parts[0][0] == line_no and len(parts) == 1:
        return 0
    value = ("" if lang == "properties" else " ").join(x for _, _, x in parts)
    q = re.match(r"([\"'])(.*)\1\s*(?:#.*)?$", value) if not block and len(parts) == 1 else None
    if q:
        value, parts = q[2], [(parts[0][0], parts[0][1] + 1, q[2])]
    scheme = _SCHEME.match(value)
    inner = inside(value)
    byte = lambda a, x: a + len(x.encode())
    if not (usable(value) or scheme and usable(scheme[1]) or inner):
        return 0
    if len(parts) == 1 and inner and any(x[2] != "issued token" for x in inner):
        a = parts[0][1]
        out.append(Secret(f, parts[0][0], inner[0][2], name, tuple((byte(a, value[:x]), byte(a, value[:y])) for x, y, _ in inner)))
    else:
        out.append(Secret(f, parts[0][0], "assigned", name, tuple((a, byte(a, x)) for _, a, x in parts)))
    return byte(parts[-1][1], parts[-1][2])


def _config_line(out: list[Secret], f: int, line_no: int, line: str, begin: int, lang: str) -> None:
    remark = re.match(r"\s*[#!]" if lang == "properties" else r"\s*#", line)
    m = None if remark else (_YAML_LINE if lang == "yaml" else _PROP_LINE).match(line)
    if remark:
        line_m = re.match(rf"\s*[#!]+\s*({_NAME})\s*[=:]\s*(\S+)\s*$", line)
        m = line_m
    name, value, at = (m[1], m[2], m.start(2)) if m else ("", line, 0)
    q = re.match(r"([\"'])(.*)\1\s*(?:#.*)?$", value)
    if q:
        value, at = q[2], at + 1
    elif lang == "yaml":
        value = re.sub(r"\s+#.*$", "", value)
    byte = lambda x: begin + len(line[:x].encode())
    inner = inside(value)
    scheme = _SCHEME.match(value)
    if inner and any(x[2] != "issued token" for x in inner) or inner and not credential_name(name):
        out.append(Secret(f, line_no, inner[0][2], name, tuple((byte(at + x), byte(at + y)) for x, y, _ in inner)))
    elif credential_name(name) and (usable(value) or scheme and usable(scheme[1]) or inner):
        out.append(Secret(f, line_no, "assigned", name, ((byte(at), byte(at + len(value))),)))


_KEEP = re.compile(r"(\\(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|\r?\n|.)|[\r\n]+[ \t]*[\"'`+,\\ \t]*)", re.S)


def redact(raw: str) -> str:
    """The content with each run between escapes and line ends replaced by REDACTED."""
    return "".join(x if i % 2 else ("REDACTED" if x else "") for i, x in enumerate(_KEEP.split(raw)))


_FOUND = "file_id bigint, line_no int, kind string, name string"


#: Extensions of running text, which is no source and no configuration.
_PROSE = (".txt",)


def _searched(piece: pa.RecordBatch, rows: np.ndarray, texts: pa.Array, lang: str) -> pa.Array:
    """The texts, null where a file of no known language is running text."""
    if lang:
        return texts
    paths = piece.column("file_path").take(pa.array(rows)).to_pylist()
    return pa.array([None if (p or "").lower().endswith(_PROSE) else t for p, t in zip(paths, texts.to_pylist(), strict=True)], pa.string())


def _find(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for lang, rows, texts, piece in batches.by_language(batch, "file_path", "content"):
            found = find(_searched(piece, rows, texts, lang), lang)
            if found:
                ids = piece.column("file_id").take(pa.array(rows)).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[x.file] for x in found], pa.int64()), pa.array([x.line for x in found], pa.int32()), pa.array([x.kind for x in found], pa.string()), pa.array([x.name for x in found], pa.string())],
                    names=["file_id", "line_no", "kind", "name"],
                )


def secret_lines(parse_results: DataFrame) -> DataFrame:
    """(file_id, line_no, kind, name): one row for each secret; lines are split at LF, from 1.

    Null and empty contents hold none; in files of unknown extension each line is looked at as text,
    save for running text (.txt).
    """
    return parse_results.select("file_id", "file_path", "content").mapInArrow(_find, _FOUND)


def secret_rows(parse_results: DataFrame) -> DataFrame:
    return secret_lines(parse_results).select("file_id", "line_no").distinct()


def redact_texts(texts: pa.Array, lang: str) -> tuple[list[str | None], list[int]]:
    """The texts with their secrets redacted, and the number of secrets of each."""
    out = texts.to_pylist()
    n = [0] * len(out)
    found = find(texts, lang)
    if not found:
        return out, n
    _, starts, _ = lexmask.buffers(texts)
    cuts: dict[int, list[tuple[int, int]]] = {}
    for x in found:
        n[x.file] += 1
        cuts.setdefault(x.file, []).extend(x.ranges)
    for f, ranges in cuts.items():
        raw = out[f].encode()
        base = int(starts[f])
        done: list[bytes] = []
        at = 0
        for a, b in sorted(set(ranges)):
            a, b = a - base, b - base
            if a < at:
                continue
            done += [raw[at:a], redact(raw[a:b].decode("utf-8", "replace")).encode()]
            at = b
        out[f] = b"".join([*done, raw[at:]]).decode("utf-8", "replace")
    return out, n


def _redact(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for lang, rows, texts, piece in batches.by_language(batch, "file_path", "content"):
            clean, n = redact_texts(_searched(piece, rows, texts, lang), lang)
            clean = [t if c is None else c for c, t in zip(clean, texts.to_pylist(), strict=True)]
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [piece.column("file_id").take(at), piece.column("file_path").take(at), pa.array(clean, pa.string()), pa.array(n, pa.int32())],
                names=["file_id", "file_path", "content", "secrets"],
            )


def redacted_files(parse_results: DataFrame) -> DataFrame:
    """(file_id, file_path, content, secrets): every delivered file, redacted and otherwise intact."""
    return parse_results.select("file_id", "file_path", "content").mapInArrow(
        _redact, "file_id bigint, file_path string, content string, secrets int"
    )
