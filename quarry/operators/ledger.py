"""An index of files that is ingested again and again: every run writes what changed, and counts only once it is committed.

A run is a folder of its own with the files that it indexed, their chunks, and the paths whose
earlier rows it replaces or drops. Its commit is one empty file, made last; what a run that
broke off has written is never read and gives way to the next attempt. The present state is,
of every path, the rows of the last committed run that names it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import CHUNK_CHARS, CHUNK_OVERLAP, chunk_chars
from quarry.operators.common import written
from quarry.operators.ingest import changed_files, stale_files

FILES = "path string, content_hash string, size_bytes long, mtime_ms long, chunks long"
CHUNKS = "path string, ordinal int, text string, embedding array<double>"
_DONE = "_committed"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def runs(spark: SparkSession, root: str) -> list[int]:
    """The committed runs in order."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    found = []
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if name.startswith("run=") and fs.exists(_fs(spark, f"{root}/{name}/{_DONE}")[1]):
            found.append(int(name[4:]))
    return sorted(found)


def _read(spark: SparkSession, root: str, kind: str, schema: str, at: list[int]) -> DataFrame:
    """One kind of rows of the runs, each with its run."""
    if not at:
        return spark.createDataFrame([], f"{schema}, run long")
    return spark.read.schema(f"{schema}, run long").option("basePath", root).parquet(*[f"{root}/run={n}/{kind}" for n in at])


def _present(spark: SparkSession, root: str, kind: str, schema: str, *columns: str | Column) -> DataFrame:
    at = runs(spark, root)
    rows = _read(spark, root, kind, schema, at)
    if columns:
        rows = rows.select("path", *columns, "run")
    gone = _read(spark, root, "gone", "path string", at)
    last = gone.groupBy("path").agg(F.max("run").alias("gone"))
    return rows.join(last, "path", "left").where("gone is null or run >= gone").drop("gone")


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content_hash, size_bytes, mtime_ms, chunks, run) of the files that the index holds."""
    return _present(spark, root, "files", FILES)


def chunks(spark: SparkSession, root: str, *columns: str | Column) -> DataFrame:
    """(path, ordinal, text, embedding, run) of all chunks that the index holds; or path, columns made of these and run, so that no more than those is shuffled."""
    return _present(spark, root, "chunks", CHUNKS, *columns)


def stats(spark: SparkSession, root: str) -> DataFrame:
    """(files, chunks, runs), one row."""
    n = files(spark, root).agg(F.count("*").alias("files"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))
    return n.withColumn("runs", F.lit(len(runs(spark, root))).cast("long"))


def ingest(scan: DataFrame, root: str, embed: Callable[[Column], Column] | None = None, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> int | None:
    """Bring the index in the folder `root` up to a scan (path, content_hash, size_bytes, mtime_ms, text) and return the run, or None where nothing changed.

    A file whose hash, size or time differs is cut into chunks again, and `embed` maps a chunk's
    text to its vector; files that the scan lacks go. Files without a chunk, null texts
    too, are not held. Null paths are left out; of a repeated path the row with the largest (mtime_ms, hash) counts. A
    second run over the same scan changes nothing, and one that broke off can simply be run again. One run at a time
    may write to a folder.
    """
    spark = scan.sparkSession
    cols = ["path", "content_hash", "size_bytes", "mtime_ms"]
    best = scan.where("path is not null").groupBy("path").agg(F.max(F.struct("mtime_ms", "content_hash", "size_bytes", F.md5("text").alias("digest"))).alias("b"))
    seen = written(best.select("path", "b.content_hash", "b.size_bytes", "b.mtime_ms", "b.digest"), "seen")
    done = runs(spark, root)
    held = files(spark, root)
    number = (done[-1] if done else 0) + 1
    at = f"{root}/run={number}"
    fresh = written(changed_files(seen, held), "changed")
    # Texts are shuffled once, by path, and only where some are needed; the rest works on paths and hashes.
    text = (scan.where("false") if fresh.isEmpty() else scan).select(*cols, "text").alias("s").join(fresh.alias("f"), "path")
    text = text.where(F.col("s.content_hash").eqNullSafe(F.col("f.content_hash")) & F.col("s.size_bytes").eqNullSafe(F.col("f.size_bytes")) & F.col("s.mtime_ms").eqNullSafe(F.col("f.mtime_ms")) & F.md5(F.col("s.text")).eqNullSafe(F.col("f.digest")))
    cut = text.select("path", F.col("s.text").alias("text")).dropDuplicates(["path"]).select("path", F.posexplode(chunk_chars(F.col("text"), size, overlap)).alias("ordinal", "text"))
    vector = embed(F.col("text")) if embed else F.lit(None)
    cut.select("path", "ordinal", "text", vector.cast("array<double>").alias("embedding")).write.mode("overwrite").parquet(f"{at}/chunks")
    counts = spark.read.schema(CHUNKS).parquet(f"{at}/chunks").groupBy("path").agg(F.count("*").alias("chunks"))
    fresh.join(counts, "path").select(*cols, "chunks").write.mode("overwrite").parquet(f"{at}/files")
    replaced = fresh.select("path").join(held.select("path"), "path", "left_semi")
    stale_files(seen, held).select("path").unionByName(replaced).write.mode("overwrite").parquet(f"{at}/gone")
    if all(spark.read.schema("path string").parquet(f"{at}/{kind}").isEmpty() for kind in ("files", "gone")):
        return None
    fs, p = _fs(spark, f"{at}/{_DONE}")
    fs.create(p, True).close()
    return number


def truncate(spark: SparkSession, root: str) -> int | None:
    """Drop all that the index holds, as a run of its own; None where it holds nothing."""
    return ingest(spark.createDataFrame([], "path string, content_hash string, size_bytes long, mtime_ms long, text string"), root)
