"""Scalar expressions on text: tokens, paths, keys, routes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension to language.
EXTENSIONS = {".py": "python", ".go": "go", ".java": "java", ".js": "javascript", ".ts": "typescript", ".c": "c", ".cpp": "cpp", ".cc": "cpp", ".h": "c", ".hpp": "cpp"}
#: Call name to HTTP method; letter case counts.
HTTP_METHODS = {
    "GET": "GET", "POST": "POST", "PUT": "PUT", "DELETE": "DELETE", "PATCH": "PATCH", "HEAD": "HEAD", "OPTIONS": "OPTIONS", "ANY": "ANY",
    "get": "GET", "post": "POST", "put": "PUT", "delete": "DELETE", "patch": "PATCH", "head": "HEAD", "options": "OPTIONS",
    "HandleFunc": "ANY", "Handle": "ANY", "route": "ANY", "api_route": "ANY", "add_api_route": "ANY",
}
#: Annotation to HTTP method.
ANNOTATIONS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH", "RequestMapping": "ANY"}
#: Imported module to web framework.
FRAMEWORKS = {
    "github.com/gin-gonic/gin": "gin", "github.com/labstack/echo": "echo", "github.com/labstack/echo/v4": "echo", "github.com/go-chi/chi": "chi",
    "github.com/go-chi/chi/v5": "chi", "github.com/gorilla/mux": "mux", "net/http": "net/http", "flask": "flask", "fastapi": "fastapi",
    "django": "django", "express": "express", "koa": "koa", "hono": "hono",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(""))


def tokenize(c: Column) -> Column:
    """K0: lower-case runs of letters, digits and _, of at least two bytes; repeats stay."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{Nd}_]+"), lambda x: F.octet_length(x) >= 2)


def short_path(c: Column) -> Column:
    """the last two parts of a path."""
    return F.when(F.size(F.split(c, "/")) <= 2, c).otherwise(F.substring_index(c, "/", -2))


def language_of(path: Column) -> Column:
    """The language of the extension, '' where it is unknown."""
    return _lookup(EXTENSIONS, F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1)))


def repo_id(url: Column) -> Column:
    """the last part of a URL or path without .git, made safe; 'default' where nothing is left."""
    base = F.regexp_replace(F.regexp_extract(F.regexp_replace(url, r"/+$", ""), r"([^/]*)$", 1), r"\.git$", "")
    safe = F.regexp_replace(base, r"[^a-zA-Z0-9_\-.]", "_")
    return F.when(safe.isin("", ".", "..") | safe.isNull(), F.lit("default")).otherwise(safe)


def repo_key(repo: Column, branch: Column) -> Column:
    """id@branch, branch main where it is missing."""
    return F.concat(repo, F.lit("@"), F.when(F.coalesce(branch, F.lit("")) == "", F.lit("main")).otherwise(branch))


def parse_key(key: Column) -> tuple[Column, Column]:
    """(id, branch), cut at the last @; branch main without one."""
    has = F.contains(key, F.lit("@"))
    return F.when(has, F.regexp_extract(key, r"(?s)^(.*)@([^@]*)$", 1)).otherwise(key), F.when(has, F.regexp_extract(key, r"(?s)^(.*)@([^@]*)$", 2)).otherwise(F.lit("main"))


def stable_uuid(c: Column) -> Column:
    """a UUID-shaped prefix of the SHA-256 of an id."""
    return F.regexp_replace(F.substring(F.sha2(c, 256), 1, 32), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")


def path_spec(c: Column) -> tuple[Column, Column, Column]:
    """(path, start, end) of file:start-end or file:line at the last colon; start and end null without."""
    m = r"^(.*):(\d{1,9})(?:-(\d{1,9}))?$"
    has = c.rlike(m)
    a, b = F.regexp_extract(c, m, 2), F.regexp_extract(c, m, 3)
    return F.when(has, F.regexp_extract(c, m, 1)).otherwise(c), F.when(has, a.try_cast("int")), F.when(has, F.when(b == "", a).otherwise(b).try_cast("int"))


def http_method(c: Column) -> Column:
    """The HTTP method of a call name, '' where it is none."""
    return _lookup(HTTP_METHODS, c)


def is_route(c: Column) -> Column:
    """Not empty, begins with /, no backslash, at most 200 bytes."""
    return F.startswith(c, F.lit("/")) & ~F.contains(c, F.lit("\\")) & (F.octet_length(c) <= 200)


def framework(module: Column) -> Column:
    """The framework of a module, '' where it is none."""
    return _lookup(FRAMEWORKS, module)


def contains_any(c: Column, words: list[str]) -> Column:
    """K4: whether any of the words is part of the text."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out
