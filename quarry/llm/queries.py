"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.ann import nearest
from quarry.llm.common import table
from quarry.llm.html import extract_main_text
from quarry.llm.katz import katz_scores
from quarry.llm.packing import harmonic_pack
from quarry.llm.phrases import collocations
from quarry.llm.quality import quality_rules
from quarry.llm.segment import decode_segmentations, sample_segmentations
from quarry.llm.simhash import simhash_groups
from quarry.llm.spelling import spelling_variants, word_counts
from quarry.llm.substring import substring_dedup
from quarry.llm.toxicity import toxicity_scores
from quarry.llm.urlfilter import filter_urls, host_of
from quarry.llm.warc import warc_round_trip


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document once repeats of 20 words that start earlier are gone."""
    found = substring_dedup(table(spark, sf_dir, "documents"), window=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated toxicity of every document."""
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every vec_id divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_sampled_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct segmentations of every document, sampled without replacement, and whether each decodes to a text of its length."""
    path = tokenizer_path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents")
    found = decode_segmentations(sample_segmentations(docs, path, k=2), path)
    return found.select("doc_id", "rank", "n_pieces", "log_prob", "inclusion", F.crc32(F.array_join("ids", ",")).alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"))


def url_list(pages: DataFrame) -> DataFrame:
    """A dated list made from the pages' own hosts: md5 of a host decides whether, when and for how long it is listed.

    Hosts whose md5 starts with 0 to 3 are listed on a day of January, removed ten days later and,
    if it starts with 0 or 1, listed again after five more; every parent domain of hosts with 4 is listed from the 20th on.
    """
    h = pages.select(host_of(F.col("url")).alias("h")).where("h is not null").distinct().withColumn("m", F.md5("h"))
    day = F.lit(1704067200) + 86400 * F.pmod(F.length("h"), F.lit(14))
    first, kind = F.substring("m", 1, 1), F.when(F.substring("m", 2, 1) < "8", F.lit("adult")).otherwise(F.lit("spam"))

    def dated(where, key, ts, action):
        return h.where(where).select(F.concat(F.lit("d:"), key).alias("key"), ts.cast("long").alias("ts"), F.lit(action).alias("action"), kind.alias("category"))

    host, parent = F.col("h"), F.substring_index("h", ".", -2)
    listed, again = first.isin("0", "1", "2", "3"), first.isin("0", "1")
    return dated(listed, host, day, "add").unionAll(dated(listed, host, day + 10 * 86400, "remove")).unionAll(dated(again, host, day + 15 * 86400, "add")).unionAll(dated(first == "4", parent, F.lit(1704067200 + 19 * 86400), "add"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, fetched page_id * 977 seconds (modulo 30 days) into January, against a dated list."""
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", (F.lit(1704067200) + F.col("page_id") * 977 % (30 * 86400)).alias("fetched"))
    return filter_urls(captures, url_list(pages))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    return warc_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash fingerprint and the group that links of at most two bits make."""
    found = simhash_groups(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary lies; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of at most 2048 ids."""
    found = harmonic_pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048)
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    return quality_rules(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_main_text(table(spark, sf_dir, "pages"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 phrases of each language whose parts mostly come together."""
    return collocations(table(spark, sf_dir, "documents"), longest=4, least=30, top=2000)


def op12_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability; those whose CRC-32 of doc_id (null: empty) is divisible by 10 are held out of training."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    found = katz_scores(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of at least five letters and three occurrences, each with the commoner word it is a variant of."""
    words = word_counts(table(spark, sf_dir, "documents"), drop_every=97, min_length=5).where("n >= 3")
    return spelling_variants(words, least_ratio=2)


def queries() -> dict:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_toxicity": op2_toxicity,
        "op3_nearest_neighbours": op3_nearest_neighbours,
        "op4_sampled_segmentations": op4_sampled_segmentations,
        "op5_url_filters": op5_url_filters,
        "op6_warc": op6_warc,
        "op7_simhash_groups": op7_simhash_groups,
        "op8_harmonic_packing": op8_harmonic_packing,
        "op9_quality_rules": op9_quality_rules,
        "op10_html_extraction": op10_html_extraction,
        "op11_phrase_collocations": op11_phrase_collocations,
        "op12_katz_scores": op12_katz_scores,
        "op13_spelling_variants": op13_spelling_variants,
    }
