"""One index of a folder of source: scan, diff, parse, resolve, embed, write.

An index is a folder with one sub-folder for each table and version. Rows that come from a file
are kept with it, so a new version takes over the rows of unchanged files, replaces those of
changed ones and drops those of removed ones. Calls are resolved anew against all symbols, so
calls into unchanged files keep their targets. The files' states are written last: a version
without them does not count, and one that is written again replaces itself.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators import ingest, retrieval, summary
from codequarry.schema import SCHEMAS, conform, keep_last
from codequarry.sources import parsers

#: Tables of rows that belong to a file, with the column of its path.
BY_FILE = {"parsed": "file_path", "imports": "file_path", "calls": "file_path", "routes": "file", "file_state": "path"}
_SCHEMAS = {**SCHEMAS, "routes": SCHEMAS["api_endpoints"], "embedded": "text_hash string, embedding array<float>"}


def latest(spark: SparkSession, target: str, before: int | None = None) -> int | None:
    """The newest whole version of an index, or the newest below a number; None where there is none."""
    try:
        v = spark.read.parquet(f"{target}/file_state").select(F.col("v").cast("bigint").alias("v"))
    except AnalysisException:
        return None
    return (v if before is None else v.filter(F.col("v") < before)).agg(F.max("v")).first()[0]


def table(spark: SparkSession, target: str, name: str, version: int | None = None) -> DataFrame:
    """A table of a version (the newest by default); without rows where there is no index."""
    version = latest(spark, target) if version is None else version
    if version is None:
        return spark.createDataFrame([], _SCHEMAS[name])
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{target}/{name}/v={version}")


def index(spark: SparkSession, source: str, target: str, embedder: retrieval.Embedder | None = None) -> int:
    """Bring the index under target up to date with the files under source; returns its version.

    Files with the time and size, or with the hash, of the former version are not parsed again.
    """
    files = ingest.scan_files(spark, source)
    diff = ingest.file_diff(table(spark, target, "file_state"), files)
    changed = files.join(ingest.work_list(diff), "path", "left_semi")
    removed = diff.filter("status = 'deleted'").select("path")
    return update(spark, target, changed, removed, embedder)


def update(spark: SparkSession, target: str, changed: DataFrame, removed: DataFrame, embedder: retrieval.Embedder | None = None, version: int | None = None) -> int:
    """A new version with changed(path, content, mod_time, size, hash) files replaced and removed(path) dropped."""
    old = latest(spark, target, version)
    version = (0 if old is None else old + 1) if version is None else version

    def before(name: str) -> DataFrame:
        return spark.createDataFrame([], _SCHEMAS[name]) if old is None else table(spark, target, name, old)

    def store(name: str, rows: DataFrame) -> DataFrame:
        conform(rows, name).write.mode("overwrite").parquet(f"{target}/{name}/v={version}") if name in SCHEMAS else rows.write.mode("overwrite").parquet(f"{target}/{name}/v={version}")
        return spark.read.schema(_SCHEMAS[name]).parquet(f"{target}/{name}/v={version}")

    touched = changed.select("path").unionByName(removed.select("path")).distinct()

    def merged(name: str, fresh: DataFrame) -> DataFrame:
        path = BY_FILE[name]
        kept = before(name).join(touched.withColumnRenamed("path", path), path, "left_anti")
        names = [f.name for f in spark.createDataFrame([], _SCHEMAS[name]).schema]
        return kept.select(*names).unionByName(fresh.select(*names))

    # Written first, so that files are read and parsed once.
    rows = f"{target}/_rows/v={version}"
    parsers.parse_files(changed, "path", "content").write.mode("overwrite").parquet(rows)
    fresh = spark.read.parquet(rows)
    parsed = store("parsed", merged("parsed", parsers.parsed_entities(fresh)))
    imports = store("imports", merged("imports", parsers.parsed_imports(fresh)))
    calls = store("calls", merged("calls", parsers.parsed_calls(fresh)))
    routes = merged("routes", parsers.parsed_endpoints(fresh)).select(*[f.name for f in spark.createDataFrame([], _SCHEMAS["routes"]).schema])
    routes = store("routes", routes)

    nodes = parsed.select(F.col("qualified_name").alias("id"), "name", "type", "file_path", "start_line", "end_line", "signature", "language", "doc_comment")
    nodes = keep_last(nodes, ["id"], [F.col("file_path"), F.col("start_line"), F.col("type"), F.col("end_line")])
    docs = nodes.select("id", "doc_comment")
    nodes = store("nodes", nodes)
    symbols = ingest.symbols(parsed)
    asked = calls.withColumn("call_id", F.concat_ws("|", "file_path", "line", "col", "caller", "callee_text")).distinct()
    found = ingest.resolve(asked, symbols, imports)
    edges = found.select(F.col("caller").alias("source"), F.col("resolved").alias("target"), F.lit("calls").alias("type"), F.col("file_path").alias("source_file"), "line", "confidence")
    edges = store("edges", keep_last(edges, ["source", "target", "type", "source_file", "line"], [F.col("confidence").desc()]))
    store("api_endpoints", ingest.resolve_handlers(routes, symbols, imports))

    named = nodes.join(summary.caller_callee_names(nodes, edges), "id").join(docs, "id")
    text = ingest.repomap_text(F.col("type"), F.col("id"), F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("signature"), F.col("doc_comment"), F.col("callees"), F.col("callers"))
    texts = named.select("id", text.alias("text")).withColumn("text_hash", F.sha2("text", 256))
    # Only texts that no former version had are embedded.
    known = before("embedded").dropDuplicates(["text_hash"])
    wanted = texts.groupBy("text_hash").agg(F.max("text").alias("text"))
    new = wanted.join(known, "text_hash", "left_anti")
    new = retrieval.embed(new, "text", embedder or retrieval.HashEmbedder()).select("text_hash", "embedding")
    embedded = store("embedded", known.join(wanted, "text_hash", "left_semi").select("text_hash", "embedding").unionByName(new))
    content = ingest.vector_document(F.col("type"), F.col("id"), F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("signature"))
    store("vectors", nodes.withColumn("content", content).join(texts.select("id", "text_hash"), "id").join(embedded, "text_hash"))
    store("file_state", merged("file_state", conform(changed, "file_state")))
    return version
