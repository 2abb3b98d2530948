"""Entities, imports, calls and endpoints of source files, by light parsers.

Python goes through the standard library's syntax tree, so files with syntax errors give no
rows. Go, Java and JavaScript (also TypeScript) go through a scanner that blanks comments and
literals and follows braces; it sees declarations and call sites, not a whole grammar.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions.text import ANNOTATIONS, EXTENSIONS, FRAMEWORKS, HTTP_METHODS

_LITERAL = {
    "go": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|`[^`]*`?|'(?:\\.|[^'\\\n])*'?", re.S),
    "java": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"\"\".*?(?:\"\"\"|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?", re.S),
    "javascript": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?|(?<=[(,=:\[!&|?{};\n])\s*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/", re.S),
}
_KEYWORDS = set(
    "if for while switch catch return func function new class else do try throw typeof super this await async case select go defer range interface struct map chan "
    "import package synchronized assert instanceof in of delete void".split()
)
_CALL = re.compile(r"(?<![\w$.@])([A-Za-z_$][\w$]*(?:\s*\.\s*[A-Za-z_$][\w$]*)*)\s*\(")


def _blank(text: str, lang: str) -> str:
    """Comments and literals as blanks of the same length, lines kept."""
    keep = lambda m: re.sub(r"[^\n]", " ", m[0])
    return _LITERAL[lang].sub(keep, text)


class _File:
    def __init__(self, path: str, text: str, lang: str):
        self.path, self.text, self.lang = path, text, lang
        self.code = _blank(text, lang)
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.close: dict[int, int] = {}
        stack: list[int] = []
        for m in re.finditer(r"[{}]", self.code):
            if m[0] == "{":
                stack.append(m.start())
            elif stack:
                self.close[stack.pop()] = m.start()

    def at(self, pos: int) -> tuple[int, int]:
        line = bisect_right(self.starts, pos)
        return line, pos - self.starts[line - 1]

    def body(self, pos: int) -> tuple[int, int]:
        """The braces that open at or after pos, before a statement ends."""
        i = self.code.find("{", pos)
        semi = self.code.find(";", pos)
        if i < 0 or 0 <= semi < i:
            return pos, pos
        return i, self.close.get(i, len(self.code))

    def comment_above(self, pos: int) -> str:
        lines = self.text[:pos].split("\n")[:-1]
        out: list[str] = []
        block = False
        for line in reversed(lines):
            t = line.strip()
            if not out and not block and t.startswith("@"):
                continue
            if block or t.endswith("*/"):
                out.append(line)
                block = not t.startswith("/*")
                if not block:
                    break
            elif t.startswith("//"):
                out.append(line)
            else:
                break
        return "\n".join(x.strip() for x in reversed(out))


def _row(kind: str, file: str, /, **x: object) -> dict:
    return {"kind": kind, "file_path": file, **x}


def _entity(f: _File, name: str, type_: str, qn: str, a: int, b: int, sig: str, parent: str | None) -> dict:
    (l1, c1), (l2, c2) = f.at(a), f.at(b)
    return _row("entity", f.path, name=name, type=type_, qualified_name=qn, start_line=l1, end_line=l2, start_col=c1, end_col=c2, signature=sig, doc_comment=f.comment_above(a), language=f.lang, parent=parent)


def _calls(f: _File, scopes: list[tuple[int, int, str]], skip: set[int]) -> Iterator[dict]:
    scopes = sorted(scopes)
    for m in _CALL.finditer(f.code):
        text = re.sub(r"\s+", "", m[1])
        if text.split(".")[0] in _KEYWORDS - {"this", "super"} or m.start() in skip:
            continue
        inside = [n for a, b, n in scopes if a <= m.start() < b]
        if inside:
            line, col = f.at(m.start())
            yield _row("call", f.path, caller=".".join(inside), callee_text=text, line=line, col=col)


def _route(f: _File, modules: set[str], quotes: str) -> Iterator[dict]:
    known = next((FRAMEWORKS[m] for m in sorted(modules) if m in FRAMEWORKS), "")
    if not known:
        return
    for m in re.finditer(rf"\.\s*([A-Za-z_]+)\s*\(\s*([{quotes}])([^\"'`\n]*)\2\s*(?:,\s*([A-Za-z_$][\w$.]*)\s*[,)])?", f.text):
        if f.code[m.start()] != ".":
            continue
        method, path = HTTP_METHODS.get(m[1], ""), m[3]
        if method and path.startswith("/") and "\\" not in path and len(path.encode()) <= 200:
            yield _row("endpoint", f.path, method=method, path=path, handler=(m[4] or "") if f.lang == "go" else "", framework=known, line=f.at(m.start())[0])


def parse_go(path: str, text: str, compat: bool = False) -> Iterator[dict]:
    """X3, X6, X10, X14."""
    f = _File(path, text, "go")
    m = re.search(r"^\s*package\s+(\w+)", f.code, re.M)
    pkg = m[1] if m and m[1] != "main" else ""
    q = lambda n: f"{pkg}.{n}" if pkg else n
    scopes, skip = [], set()
    for m in re.finditer(r"^func\s+(\([^)]*\)\s*)?(\w+)\s*(?:\[[^\]]*\]\s*)?(\()", f.code, re.M):
        a, b = f.body(m.end())
        skip.add(m.start(2))
        sig = re.sub(r"\s+", " ", f.code[m.start() : a].strip()) if a > m.end() else f.code[m.start() : m.end()]
        name = m[2]
        if m[1]:
            recv = re.search(r"(\w+)\s*(?:\[[^\]]*\])?\s*\)\s*$", m[1])
            owner = recv[1] if recv else ""
            yield _entity(f, name, "method", q(f"{owner}.{name}"), m.start(), b, "", owner)
            scopes.append((a, b, q(f"{owner}.{name}")))
        else:
            yield _entity(f, name, "function", q(name), m.start(), b, sig, None)
            scopes.append((a, b, q(name)))
    for m in re.finditer(r"^(?:type\s+|\t)(\w+)\s+(?:struct|interface)\s*\{|^type\s+(\w+)\s+[\w*\[\]]", f.code, re.M):
        name = m[1] or m[2]
        b = f.body(m.start())[1] if "{" in m[0] else m.end()
        yield _entity(f, name, "class", q(name), m.start(), max(b, m.end()), f"type {name}", None)
    modules = set()
    for m in re.finditer(r"^import\s+(?:\(([^)]*)\)|([\w.]+\s+)?\"([^\"]+)\")", text, re.M):
        rows = re.findall(r"([\w.]+[ \t]+)?\"([^\"]+)\"", m[1]) if m[1] else [(m[2] or "", m[3])]
        for alias, module in rows:
            alias = alias.strip()
            modules.add(module)
            if alias not in (".", "_"):
                yield _row("import", path, alias=alias or module.rsplit("/", 1)[-1], module=module)
    yield from _calls(f, scopes, skip)
    yield from _route(f, modules, '"')


def parse_java(path: str, text: str, compat: bool = False) -> Iterator[dict]:
    """X4, X8, X10, X17; with compat methods are named `.name`, as if their class were unknown."""
    f = _File(path, text, "java")
    scopes, skip, classes = [], set(), []
    for m in re.finditer(r"\bclass\s+(\w+)[^;{(]*\{", f.code):
        a = m.end() - 1
        b = f.close.get(a, len(f.code))
        classes.append((a, b, m[1]))
        yield _entity(f, m[1], "class", m[1], m.start(), b, "", None)
        scopes.append((a, b, m[1]))
    for m in re.finditer(r"(?:^|[;{}])\s*((?:@\w+(?:\([^)]*\))?\s*)*)((?:(?:public|protected|private|static|final|abstract|synchronized|native|default)\s+)*)(?:<[^>]*>\s*)?([\w.]+(?:<[^;{}()]*>)?(?:\[\])*)\s+(\w+)\s*\(([^)]*)\)\s*(?:throws\s+[\w.,\s]+)?(\{)", f.code, re.M):
        if m[3] in ("new", "return", "else", "throw") or m[4] in _KEYWORDS:
            continue
        owner = [n for a, b, n in classes if a < m.start(4) < b]
        if not owner:
            continue
        a = m.start(6)
        b = f.close.get(a, len(f.code))
        skip.add(m.start(4))
        qn = f".{m[4]}" if compat else f"{owner[-1]}.{m[4]}"
        begin = m.start(2) if m[2] else m.start(3)
        yield _entity(f, m[4], "method", qn, begin, b, "", owner[-1])
        scopes.append((a, b, m[4]))
        for x in re.finditer(r"@(\w+)\s*(?:\(([^)]*)\))?", f.text[m.start(1) : m.end(1)]):
            if x[1] in ANNOTATIONS:
                p = re.search(r"\"([^\"]*)\"", x[2] or "")
                if p and p[1].startswith("/") and "\\" not in p[1] and len(p[1].encode()) <= 200:
                    yield _row("endpoint", path, method=ANNOTATIONS[x[1]], path=p[1], handler=f"{owner[-1]}.{m[4]}", framework="spring", line=f.at(begin)[0])
    for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.]+)(\.\*)?\s*;", f.code, re.M):
        if not m[2]:
            yield _row("import", path, alias=m[1].rsplit(".", 1)[-1], module=m[1])
    yield from _calls(f, scopes, skip)


def parse_js(path: str, text: str, compat: bool = False) -> Iterator[dict]:
    """Function and class declarations; methods only open scopes for calls."""
    f = _File(path, text, "javascript")
    scopes, skip = [], set()
    for m in re.finditer(r"\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)\s*\(", f.code):
        a, b = f.body(m.end())
        skip.add(m.start(1))
        yield _entity(f, m[1], "function", m[1], m.start(), b, "", None)
        scopes.append((a, b, m[1]))
    for m in re.finditer(r"\bclass\s+([A-Za-z_$][\w$]*)[^{;]*\{", f.code):
        a = m.end() - 1
        b = f.close.get(a, len(f.code))
        yield _entity(f, m[1], "class", m[1], m.start(), b, "", None)
        scopes.append((a, b, m[1]))
        for x in re.finditer(r"(?:^|[;{}])\s*(?:(?:async|static|get|set)\s+)*\*?([A-Za-z_$][\w$]*)\s*\(([^)]*)\)\s*(?::[^={]*)?\{", f.code[a:b], re.M):
            if x[1] not in _KEYWORDS:
                o = a + x.end() - 1
                skip.add(a + x.start(1))
                scopes.append((o, f.close.get(o, b), x[1]))
    modules = set()
    for m in re.finditer(r"^\s*import\s+(?:([\w$]+)\s*,?\s*)?(?:\{([^}]*)\}\s*)?(?:\*\s+as\s+([\w$]+)\s*)?(?:from\s*)?([\"'])([^\"'\n]+)\4", text, re.M):
        module = m[5]
        modules.add(module)
        yield _row("import", path, alias=module.rsplit("/", 1)[-1], module=module)
        for n in filter(None, [m[1], m[3]]):
            yield _row("import", path, alias=n, module=f"{module}.{n}")
        for part in (m[2] or "").split(","):
            w = part.split()
            if w:
                yield _row("import", path, alias=w[-1], module=f"{module}.{w[0]}")
    for m in re.finditer(r"\b(?:const|let|var)\s+([\w$]+)\s*=\s*require\(\s*[\"']([^\"'\n]+)[\"']\s*\)", text):
        modules.add(m[2])
        yield _row("import", path, alias=m[1], module=m[2])
    yield from _calls(f, scopes, skip)
    yield from _route(f, modules, "\"'`")


def parse_python(path: str, text: str, compat: bool = False) -> Iterator[dict]:
    """X2, X7, X10, X15; with compat each method is emitted a second time as a function."""
    try:
        tree = ast.parse(text.lstrip("﻿"))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    lines = text.split("\n")

    def entity(n: ast.AST, type_: str, qn: str, parent: str | None) -> dict:
        sig = f"class {n.name}" if type_ == "class" else f"def {n.name}({ast.unparse(n.args)})"
        doc = ""
        if n.body and isinstance(n.body[0], ast.Expr) and isinstance(n.body[0].value, ast.Constant) and isinstance(n.body[0].value.value, str):
            doc = ast.get_source_segment(text, n.body[0].value) or ""
        return _row("entity", path, name=n.name, type=type_, qualified_name=qn, start_line=n.lineno, end_line=n.end_lineno, start_col=n.col_offset, end_col=n.end_col_offset, signature=sig, doc_comment=doc, language="python", parent=parent)

    modules: dict[str, str] = {}
    for n in tree.body:
        if isinstance(n, ast.Import):
            for a in n.names:
                modules[a.name] = a.name
                yield _row("import", path, alias=a.asname or a.name.rsplit(".", 1)[-1], module=a.name)
        elif isinstance(n, ast.ImportFrom):
            base = "." * n.level + (n.module or "")
            modules[base] = base
            for a in n.names:
                yield _row("import", path, alias=a.asname or a.name, module=f"{base}.{a.name}")
    known = next((fw for m in sorted(modules) for fw in FRAMEWORKS.values() if m == fw or m.startswith(fw + ".")), "")
    # Node, its scope, the class it is the body of, and the scope it lies in itself, which is that of its decorators.
    todo: list[tuple[ast.AST, tuple[str, ...], ast.AST | None, tuple[str, ...]]] = [(tree, (), None, ())]
    while todo:
        node, body_scope, owner, outer = todo.pop()
        decorators = {id(x) for x in getattr(node, "decorator_list", ())}
        for child in ast.iter_child_nodes(node):
            scope = outer if id(child) in decorators else body_scope
            inner, own = scope, None
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                inner = (*scope, child.name)
                method = isinstance(owner, ast.ClassDef)
                if method and not (compat and child.decorator_list):
                    yield entity(child, "method", f"{owner.name}.{child.name}", owner.name)
                if not method or compat:
                    yield entity(child, "function", child.name, None)
                for d in child.decorator_list:
                    call = d.func if isinstance(d, ast.Call) else None
                    if known and isinstance(call, ast.Attribute) and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str):
                        method_name, p = HTTP_METHODS.get(call.attr, ""), d.args[0].value
                        if method_name and p.startswith("/") and "\\" not in p and len(p.encode()) <= 200:
                            yield _row("endpoint", path, method=method_name, path=p, handler=".".join(inner), framework=known, line=d.lineno)
                            break
            elif isinstance(child, ast.ClassDef):
                inner, own = (*scope, child.name), child
                yield entity(child, "class", child.name, None)
            elif isinstance(child, ast.Call) and scope:
                f = child.func
                parts: list[str] = []
                while isinstance(f, ast.Attribute):
                    parts.append(f.attr)
                    f = f.value
                if isinstance(f, ast.Name):
                    yield _row("call", path, caller=".".join(scope), callee_text=".".join([f.id, *reversed(parts)]), line=child.lineno, col=child.col_offset)
            todo.append((child, inner, own, scope))
    del lines


PARSERS = {"python": parse_python, "go": parse_go, "java": parse_java, "javascript": parse_js, "typescript": parse_js}
_FIELDS = {
    "kind": pa.string(), "file_path": pa.string(), "name": pa.string(), "type": pa.string(), "qualified_name": pa.string(), "start_line": pa.int32(), "end_line": pa.int32(),
    "start_col": pa.int32(), "end_col": pa.int32(), "signature": pa.string(), "doc_comment": pa.string(), "language": pa.string(), "parent": pa.string(), "alias": pa.string(),
    "module": pa.string(), "caller": pa.string(), "callee_text": pa.string(), "line": pa.int32(), "col": pa.int32(), "method": pa.string(), "path": pa.string(), "handler": pa.string(), "framework": pa.string(),
}
_SCHEMA = ", ".join(f"`{k}` {'int' if t == pa.int32() else 'string'}" for k, t in _FIELDS.items())


def parse_files(files: DataFrame, path: str = "file_path", content: str = "content", compat: bool = False) -> DataFrame:
    """Tagged rows of all kinds from one parse of each file; other languages and nulls give none."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows: list[dict] = []
            for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ext = "." + (p or "").rsplit(".", 1)[-1].lower()
                parser = PARSERS.get(EXTENSIONS.get(ext, ""))
                if parser and t:
                    rows.extend(parser(p, t, compat))
                if len(rows) > 5000:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(_FIELDS))
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(_FIELDS))

    return files.select(path, content).mapInArrow(run, _SCHEMA)


def parsed_entities(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'entity'").select("name", "type", "qualified_name", "file_path", "start_line", "end_line", "start_col", "end_col", "signature", "doc_comment", "language", "parent")


def parsed_imports(rows: DataFrame) -> DataFrame:
    """One row for each (file, alias); the last module by name wins."""
    return rows.filter("kind = 'import'").groupBy("file_path", "alias").agg(F.max("module").alias("module"))


def parsed_calls(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'call'").select("caller", "callee_text", "file_path", "line", "col")


def parsed_endpoints(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'endpoint'").select("method", "path", "handler", "framework", F.col("file_path").alias("file"), "line")
