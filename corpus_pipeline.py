"""A training corpus from raw documents: each stage applies one operator to all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import materialize, table
from quarry.llm.nearcopies import near_copy_dedup
from quarry.llm.packing import harmonic_pack
from quarry.llm.quality import quality_rules
from quarry.llm.queries import tokenizer_path
from quarry.llm.substring import substring_dedup
from quarry.llm.toxicity import toxicity_scores

#: Near duplicates: words of a shingle, and the least Jaccard similarity of the shingle sets.
SHINGLE = 5
SIMILARITY = 0.8
WINDOW = 20
CAPACITY = 2048


def _plain(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with columns c0, c1, ... and `same`, and the columns that operators read of it.

    `same` hashes text and language, so a row is known by doc_id and `same`: rows that share
    both are judged alike, whatever their doc_id (null and repeated ones too) and however
    their table is read again. Of columns that share a name the first is read.
    """
    at = {c: f"c{i}" for i, c in reversed(list(enumerate(docs.columns)))}
    text, lang = F.col(at["text"]), F.col(at["lang"])
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).withColumn("same", F.xxhash64(F.coalesce(F.octet_length(text), F.lit(-1)), text, lang))
    return rows, rows.select(F.col(at["doc_id"]).alias("doc_id"), text.alias("text"), lang.alias("lang"), "same")


def _only(docs: DataFrame, rows: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id and `same` are in judged (doc_id, same, keep) with keep."""
    kept = materialize(judged.where("keep").select(F.col("doc_id").alias("_id"), F.col("same").alias("_same")).distinct(), "kept")
    found = rows.join(kept, rows[f"c{docs.columns.index('doc_id')}"].eqNullSafe(kept["_id"]) & (rows["same"] == kept["_same"]), "left_semi")
    return found.drop("same").toDF(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts fail them; an empty table gives an empty one."""
    rows, read = _plain(docs)
    return _only(docs, rows, quality_rules(read, keep=("doc_id", "same")).select("doc_id", "same", F.col("kept").alias("keep")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic. Every row is judged by its own text; an empty table gives an empty one."""
    rows, read = _plain(docs)
    scores = toxicity_scores(read, table(spark, sf_dir, "labels"), keep=("same",))
    return _only(docs, rows, scores.select("doc_id", "same", (F.col("predicted") == 0).alias("keep")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near duplicates; other rows that share a doc_id stay."""
    return near_copy_dedup(docs, shingle=SHINGLE, similarity=SIMILARITY)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that start earlier in the corpus; one that loses nothing keeps its text as it is.

    No row goes. Rows with a null doc_id come before all others, rows that share one in the
    order of their texts, and each is cut by itself; an empty table gives an empty one.
    """
    at = {c: f"c{i}" for i, c in reversed(list(enumerate(docs.columns)))}
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    id_, old = at["doc_id"], at["text"]
    cut = substring_dedup(rows.withColumn("key", F.col(id_)), key="key", text=old, window=WINDOW, keep=tuple(rows.columns))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col(old))
    new = {old: text}
    if "n_chars" in at:
        new[at["n_chars"]] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[new.get(c, F.col(c)).alias(c) for c in rows.columns]).toDF(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most CAPACITY ids."""
    found = harmonic_pack(docs, tokenizer_path(), capacity=CAPACITY)
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality),
    ("toxicity", toxicity),
    ("near duplicates", near_duplicates),
    ("substring dedup", substrings),
    ("packing", packing),
]

#: SQL cannot express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
