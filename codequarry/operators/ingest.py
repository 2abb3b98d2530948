"""Ingestion: file states, work lists, symbols, chunks and embedding texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions.text import EXTENSIONS
from codequarry.schema import SCHEMAS, keep_last

#: Marks of the call lists in summaries.
CALLS_LABEL, CALLED_LABEL = "调用→ ", "被调用← "
MAX_CHUNK, OVERLAP_LINES, MIN_LINES = 4096, 5, 10


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, mod_time, size, hash, content) of source files; directories that begin with a dot are skipped.

    The extensions are a filter of the source, so other files are listed but never read.
    """
    any_case = lambda e: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e)
    names = "*.{" + ",".join(any_case(e[1:]) for e in EXTENSIONS) + "}"
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(root)
    rel = F.regexp_replace(F.col("path"), r"^\w+:/*", "/")
    inside = F.substr(rel, F.lit(len(root.rstrip("/")) + 1))
    keep = ~inside.rlike(r"/\.[^/]*/")
    return df.filter(keep).select(rel.alias("path"), F.col("modificationTime").alias("mod_time"), F.col("length").alias("size"), F.sha1("content").alias("hash"), F.col("content").cast("string").alias("content"))


def file_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """S3: (path, status) of file states: new, deleted, modified or unchanged.

    Equal times and sizes are unchanged without a look at the hash; equal hashes are unchanged too.
    """
    o = old.select("path", F.col("hash").alias("_oh"), F.col("size").alias("_os"), F.col("mod_time").alias("_ot"))
    x = new.select("path", "hash", "size", "mod_time").join(o, "path", "full_outer")
    same = (F.col("mod_time").eqNullSafe(F.col("_ot")) & F.col("size").eqNullSafe(F.col("_os"))) | (F.col("hash") == F.col("_oh"))
    status = F.when(F.col("_oh").isNull() & F.col("_os").isNull(), "new").when(F.col("hash").isNull() & F.col("size").isNull(), "deleted").when(same, "unchanged").otherwise("modified")
    return x.select("path", status.alias("status"))


def work_list(diff: DataFrame) -> DataFrame:
    """S5."""
    return diff.filter(F.col("status").isin("new", "modified")).select("path")


def write_state(state: DataFrame, folder: str, version: int) -> str:
    """A snapshot beside the older ones; a reader of the former is not disturbed."""
    target = f"{folder.rstrip('/')}/v={version}"
    state.write.mode("overwrite").parquet(target)
    return target


def read_state(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The newest snapshot, or that of a version; without rows where there is none."""
    try:
        rows = spark.read.parquet(folder)
    except AnalysisException:
        return spark.createDataFrame([], SCHEMAS["file_state"])
    version = rows.agg(F.max("v")).first()[0] if version is None else version
    return rows.filter(F.col("v") == version).drop("v")


def symbols(parsed: DataFrame) -> DataFrame:
    """X11: (name, qualified_name, file_path, start_line): distinct symbols of parser rows."""
    return parsed.select("name", "qualified_name", "file_path", F.coalesce("start_line", F.lit(0)).alias("start_line")).filter("qualified_name is not null and file_path is not null").distinct()


def resolve(calls: DataFrame, table: DataFrame, imports: DataFrame) -> DataFrame:
    """calls(call_id, callee_text, file_path) with resolved and confidence.

    Every tier is an equi-join with one row for each key, so calls never multiply; the first
    tier that knows an answer wins. "First candidate" is the least (file, line, name).
    """
    first = F.min(F.struct("file_path", "start_line", "qualified_name")).alias("f")
    # A file's own symbols, by bare and by qualified name.
    own = table.select("file_path", "start_line", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("key"), "qualified_name").groupBy("file_path", "key").agg(first)
    own = own.select("file_path", F.col("key").alias("callee_text"), F.col("f.qualified_name").alias("_own"))
    qualified = table.select("qualified_name").distinct()
    bare = table.groupBy("name").agg(first).select(F.col("name").alias("_bare"), F.col("f.qualified_name").alias("_first"))
    folder = lambda c: F.regexp_replace(c, r"/?[^/]*$", "")
    near = table.withColumn("_dir", folder(F.col("file_path"))).groupBy("_dir", "name").agg(first).select("_dir", F.col("name").alias("_near_key"), F.col("f.qualified_name").alias("_near"))
    imp = imports.groupBy("file_path", "alias").agg(F.max("module").alias("_module")).select(F.col("file_path"), F.col("alias").alias("_prefix"), "_module")

    dot = F.instr("callee_text", ".")
    x = calls.withColumn("_prefix", F.when(dot > 0, F.expr("substring(callee_text, 1, instr(callee_text, '.') - 1)")))
    x = x.withColumn("_suffix", F.when(dot > 0, F.expr("substring(callee_text, instr(callee_text, '.') + 1)"))).withColumn("_dir", folder(F.col("file_path")))

    def known(df: DataFrame, key: Column, name: str) -> DataFrame:
        k = df.withColumn("_k", key)
        return k.join(qualified.select(F.col("qualified_name").alias("_k"), F.lit(True).alias(name)), "_k", "left").drop("_k")

    x = x.join(own, ["file_path", "callee_text"], "left")
    x = known(x, F.col("callee_text"), "_is_qualified")
    x = x.join(imp, ["file_path", "_prefix"], "left")
    full = F.concat("_module", F.lit("."), "_suffix")
    base = F.concat(F.regexp_extract("_module", r"([^/]*)$", 1), F.lit("."), "_suffix")
    x = known(known(x, full, "_has_full"), base, "_has_base")
    x = x.join(bare.withColumnRenamed("_bare", "_prefix").withColumnRenamed("_first", "_prefix_first"), "_prefix", "left")
    x = known(x, F.col("_prefix"), "_prefix_qualified")
    x = x.join(near.withColumnRenamed("_near_key", "callee_text"), ["_dir", "callee_text"], "left")
    x = x.join(bare.withColumnRenamed("_bare", "callee_text"), "callee_text", "left")
    tiers: list[tuple[Column, Column, float]] = [
        (F.col("_own").isNotNull(), F.col("_own"), 1.0),
        (F.col("_is_qualified"), F.col("callee_text"), 0.9),
        (F.col("_module").isNotNull() & F.col("_has_full"), full, 0.85),
        (F.col("_module").isNotNull() & F.col("_has_base"), base, 0.8),
        (F.col("_module").isNotNull(), base, 0.6),
        (F.col("_prefix_first").isNotNull(), F.concat("_prefix_first", F.lit("."), "_suffix"), 0.7),
        (F.col("_prefix_qualified"), F.col("callee_text"), 0.7),
        (F.col("_near").isNotNull(), F.col("_near"), 0.5),
        (F.col("_first").isNotNull(), F.col("_first"), 0.3),
    ]
    name, conf = F.when(F.lit(False), ""), F.when(F.lit(False), 0.0)
    for test, value, c in tiers:
        name, conf = name.when(F.coalesce(test, F.lit(False)), value), conf.when(F.coalesce(test, F.lit(False)), c)
    return x.select(*calls.columns, name.otherwise(F.col("callee_text")).alias("resolved"), conf.otherwise(0.1).alias("confidence"))


def resolve_handlers(endpoints: DataFrame, table: DataFrame, imports: DataFrame) -> DataFrame:
    """Endpoints whose handler text is replaced by the symbol it resolves to, or kept where nothing is known of it."""
    e = endpoints.withColumn("call_id", F.monotonically_increasing_id())
    asked = e.filter("handler <> ''").select("call_id", F.col("handler").alias("callee_text"), F.col("file").alias("file_path"))
    found = resolve(asked, table, imports).filter("confidence > 0.1").select("call_id", "resolved")
    return e.join(found, "call_id", "left").withColumn("handler", F.coalesce("resolved", "handler")).select(*endpoints.columns)


def line_range(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end, 1-based and inclusive, clamped; '' where nothing is left."""
    lines = F.split(text, "\n")
    a = F.greatest(start, F.lit(1))
    b = F.least(end, F.size(lines))
    return F.when((a > F.size(lines)) | (b < a), F.lit("")).otherwise(F.array_join(F.slice(lines, a, F.greatest(b - a + 1, F.lit(0))), "\n"))


def file_context(text: Column) -> Column:
    """The leading package, import and comment-title lines, up to the first other code line."""
    start = F.struct(F.lit(False).alias("done"), F.lit(False).alias("block"), F.array().cast("array<string>").alias("acc"))

    def step(s: Column, line: Column) -> Column:
        t = F.trim(F.translate(line, "\t\r", "  "))
        head = t.startswith("package ") | t.startswith("# ") | t.startswith("from ") | t.startswith("import ")
        take = ~s["done"] & (head | s["block"])
        opened = head & t.startswith("import (")
        block = ~s["done"] & (F.when(head, opened | s["block"]).otherwise(s["block"] & (t != ")")))
        quiet = (t == "") | t.startswith("//") | t.startswith("#") | t.startswith("/*") | t.startswith("*")
        return F.struct((s["done"] | (~head & ~s["block"] & ~quiet)).alias("done"), block.alias("block"), F.when(take, F.concat(s["acc"], F.array(line))).otherwise(s["acc"]).alias("acc"))

    return F.array_join(F.aggregate(F.split(text, "\n"), start, step, lambda s: s["acc"]), "\n")


def chunks(items: DataFrame, size: int = MAX_CHUNK, overlap: int = OVERLAP_LINES) -> DataFrame:
    """items(file_path, qualified_name, text, start_line, end_line) cut into windows of lines.

    One chunk where the bytes fit; else windows of size / (bytes per line) lines, at least 10,
    each beginning `overlap` lines before the end of the former.
    """
    x = items.withColumn("_body", line_range(F.col("text"), F.col("start_line"), F.col("end_line"))).filter("_body <> ''")
    total = F.col("end_line") - F.col("start_line") + 1
    per = F.greatest(F.expr("octet_length(_body) div (end_line - start_line + 1)"), F.lit(1))
    n = F.when(F.octet_length("_body") <= size, total).otherwise(F.greatest(F.lit(MIN_LINES), F.floor(F.lit(size) / per).cast("int")))
    x = x.withColumn("_n", n.cast("int"))
    begins = F.when(F.col("_n") >= total, F.array("start_line")).otherwise(
        F.filter(F.sequence(F.col("start_line"), F.col("end_line"), F.col("_n") - overlap), lambda s: (s == F.col("start_line")) | (s + overlap <= F.col("end_line")))
    )
    x = x.withColumn("_begins", begins).select("*", F.posexplode("_begins").alias("chunk_index", "from_line"))
    to = F.least(F.col("from_line") + F.col("_n") - 1, F.col("end_line"))
    many = F.size("_begins") > 1
    name = F.concat("file_path", F.lit("::"), "qualified_name")
    return x.select(
        F.when(many, F.concat(name, F.lit("#"), F.col("chunk_index").cast("string"))).otherwise(name).alias("id"), "file_path", "qualified_name", "chunk_index", F.size("_begins").alias("total_chunks"),
        "from_line", to.alias("to_line"), (to - F.col("from_line") + 1).alias("line_count"), (to < F.col("end_line")).alias("is_truncated"), line_range(F.col("text"), F.col("from_line"), to).alias("content"),
    )


def doc_text(c: Column) -> Column:
    """Documentation without surrounding quotes and blanks; null where nothing is left."""
    t = F.regexp_replace(F.regexp_replace(c, "^[\"'`]+|[\"'`]+$", ""), r"^\s+|\s+$", "")
    return F.nullif(t, F.lit(""))


def repomap_text(type_: Column, name: Column, path: Column, start: Column, end: Column, signature: Column, doc: Column, callees: Column, callers: Column) -> Column:
    """The summary of an entity that is embedded."""
    some = lambda c: F.nullif(c, F.lit(""))
    place = F.concat(F.lit("File: "), path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))
    return F.concat_ws("\n", F.concat(F.lit("["), type_, F.lit("] "), name), place, some(signature), doc_text(doc), F.concat(F.lit(CALLS_LABEL), some(callees)), F.concat(F.lit(CALLED_LABEL), some(callers)))


def chunk_text(context: Column, type_: Column, name: Column, index: Column, total: Column, path: Column, signature: Column, doc: Column, content: Column) -> Column:
    """The full text of a chunk that may be embedded."""
    some = lambda c: F.nullif(c, F.lit(""))
    part = F.when(total > 1, F.concat(F.lit(" (part "), (index + 1).cast("string"), F.lit("/"), total.cast("string"), F.lit(")"))).otherwise("")
    return F.concat_ws("\n\n", some(context), F.concat(F.lit("["), type_, F.lit("] "), name, part), F.concat(F.lit("File: "), path), some(signature), doc_text(doc), content)


def vector_document(type_: Column, name: Column, path: Column, start: Column, end: Column, signature: Column) -> Column:
    """The stored content of a vector document: title, place and signature."""
    place = F.concat(F.lit("File: "), path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))
    return F.concat_ws("\n", F.concat(F.lit("["), type_, F.lit("] "), name), place, F.nullif(signature, F.lit("")))


def keep_newest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Upsert by id."""
    return keep_last(df, [key], order)


def delete_vectors(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """S17."""
    return vectors.join(ids.select("id").distinct(), "id", "left_anti")


Transform = Callable[[DataFrame], DataFrame]
