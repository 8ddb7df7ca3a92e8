"""Workspace scans, JSON Lines, session logs and event-stream text as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders that no walk enters, and what counts as text and as code; each walk has its own.
SKIPPED = (".git", "target", "node_modules", "__pycache__")
CODE_SKIPPED = (".git", "node_modules", "vendor", "third_party", "build", "dist", "target", "__pycache__", ".pytest_cache", ".mypy_cache", ".tox", "site-packages", "venv", ".venv", "env", ".env")
TEXT_EXTENSIONS = ("rs", "md", "toml", "txt", "json", "yaml", "yml", "js", "ts", "tsx", "jsx", "py", "go", "c", "h", "cpp", "hpp", "cs", "java", "kt", "swift", "rb", "php", "sh", "ps1", "html", "css", "sql")
CODE_EXTENSIONS = ("py", "pyx", "rs", "ts", "tsx", "js", "jsx", "mjs", "go", "java", "kt", "scala", "rb", "c", "cc", "cpp", "cxx", "h", "hpp", "cs", "swift", "m", "mm")


def listed_files(files: DataFrame, extensions: tuple[str, ...] = TEXT_EXTENSIONS, max_bytes: int = 2 << 20, max_depth: int | None = None, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """The rows of a table of files (path, size_bytes, ...) that a walk would list: by extension, size and depth, outside skipped folders.

    Paths are relative with slashes; letters' case doesn't matter in an extension. A null path or size is left out.
    """
    parts = F.split("path", "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    keep = (F.col("size_bytes") <= max_bytes) & F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions) & ~F.arrays_overlap(folders, F.array(*map(F.lit, skipped)))
    if max_depth is not None:
        keep = keep & (F.size(parts) <= max_depth)
    return files.where(keep)


def scan_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = TEXT_EXTENSIONS, max_bytes: int = 2 << 20, max_depth: int | None = None, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(path, size_bytes, modified, text) of a folder's files by extension, size and depth; skipped folders are left out.

    The size limit is pushed to the file listing, so a larger file is never read. A tool's own
    folder, such as that of its index, is the caller's to add to `skipped`.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= max_bytes)
    rel = F.split(F.regexp_replace("path", "^[a-z]+:/*", "/"), "/")
    parts = F.slice(rel, len([p for p in root.removeprefix("file://").split("/") if p]) + 2, 1 << 20)
    f = f.select(F.array_join(parts, "/").alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), "content")
    return listed_files(f, extensions, max_bytes, max_depth, skipped).withColumn("content", F.decode("content", "UTF-8")).withColumnRenamed("content", "text")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON Lines; blank lines are skipped and the first bad one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


SESSION = "type string, session_id string, role string, text string, summary string"


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Session logs by line: (line_number, type, session_id, role, text, summary, error), an unknown type or bad JSON is an error with its line."""
    lines = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", "\n")).alias("p", "line")).where(F.trim("line") != "")
    x = lines.select((F.col("p") + 1).alias("line_number"), F.from_json("line", SESSION).alias("r"))
    known = F.coalesce(F.col("r.type").isin("session_meta", "message", "compaction", "prompt_history"), F.lit(False))
    return x.select("line_number", "r.*", F.when(~known, F.concat(F.lit("line "), F.col("line_number").cast("string"), F.lit(": bad record"))).alias("error"))


def parse_sse(streams: DataFrame) -> DataFrame:
    """Event-stream text (id, text) as events (id, ordinal, event, data): fields by line, comments skipped, a blank line ends an event; several data lines join."""
    text = F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), "\n+$", "")
    frames = streams.select("id", F.posexplode(F.split(text, "\n\n")).alias("ordinal", "frame"))

    def of(name):
        found = F.filter(F.split("frame", "\n"), lambda x: F.startswith(x, F.lit(name + ":")))
        return F.transform(found, lambda x: F.regexp_replace(x, f"^{name}: ?", ""))

    out = frames.select("id", "ordinal", F.coalesce(F.try_element_at(of("event"), F.lit(-1)), F.lit("message")).alias("event"), of("data").alias("d")).where(F.size("d") > 0)
    return out.select("id", F.row_number().over(W.partitionBy("id").orderBy("ordinal")).alias("ordinal"), "event", F.array_join("d", "\n").alias("data"))
