"""Grep, ranked and fuzzy search, and vector expressions over the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import text_lines
from quarry.functions.vectors import cosine as _cosine
from quarry.functions.vectors import l2_normalize as _normalize
from quarry.operators import index as X
from quarry.operators.common import written
from quarry.plans.common import table
from quarry.plans.text import _KEPT_SQL
from quarry.plans.text import extract_keywords as _extract

PATTERN = "tion(ed|er)"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text_lines(F.col("text"))).alias("p", "line")).select("doc_id", (F.col("p") + 1).alias("line_number"), "line")


_LINES = """(SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_number FROM (SELECT doc_id, string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10)) AS ls FROM documents WHERE text <> ''))"""


def grep_files(spark, sf_dir):
    """Documents with a matching line."""
    return _lines(spark, sf_dir).where(F.col("line").rlike(PATTERN)).select("doc_id").distinct()


def grep_content(spark, sf_dir):
    """Each matching line with one line before and after; overlaps are repeated."""
    w = W.partitionBy("doc_id").orderBy("line_number")
    x = _lines(spark, sf_dir).withColumns({"before": F.lag("line").over(w), "after": F.lead("line").over(w)})
    return x.where(F.col("line").rlike(PATTERN)).select("doc_id", "line_number", F.md5(F.concat_ws("\n", "before", "line", "after")).alias("context_md5"))


def grep_count(spark, sf_dir):
    """Matches over whole texts that do not overlap."""
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit(PATTERN)).alias("n")).where("n > 0")


def grep_literal(spark, sf_dir):
    """Lines with a literal string in document order, 500 at most."""
    return _lines(spark, sf_dir).where(F.contains("line", F.lit("thing"))).orderBy("doc_id", "line_number").limit(500).select("doc_id", "line_number")


def keyword_hits(spark, sf_dir):
    """The first five documents that hold each of the ten commonest keywords."""
    k = _extract(spark, sf_dir).groupBy("keyword").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "keyword").limit(10)
    index = X.build_index(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text"))
    return X.grep_index(written(index, "index"), k.select(F.lit(0).alias("query"), "keyword")).select("keyword", F.col("path").alias("doc_id"))


_TERMS = ("ring", "small", "economy")


def _canonical(c):
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]", ""), "tool$", "")


def ranked_search(spark, sf_dir):
    """Parts by name and type against terms; the first is required."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("name"), F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("hay"))
    score = F.lit(0)
    for t in _TERMS:
        score = score + F.when(F.contains("hay", F.lit(t)), 2).otherwise(0) + F.when(F.col("name") == t, 8).otherwise(0) + F.when(F.contains("name", F.lit(t)), 4).otherwise(0) + F.when(_canonical("name") == t, 12).otherwise(0) + F.when(F.contains(_canonical("name"), F.lit(t)), 3).otherwise(0)
    return p.withColumn("score", score).where(F.contains("hay", F.lit(_TERMS[0])) & (F.col("score") > 0)).orderBy(F.desc("score"), "name", "p_partkey").limit(20).select("p_partkey", "score")


def _canonical_sql():
    return "regexp_replace(regexp_replace(name, '[^a-z0-9]', '', 'g'), 'tool$', '')"


_SCORE = " + ".join(f"CASE WHEN contains(hay, '{t}') THEN 2 ELSE 0 END + CASE WHEN name = '{t}' THEN 8 ELSE 0 END + CASE WHEN contains(name, '{t}') THEN 4 ELSE 0 END + CASE WHEN {_canonical_sql()} = '{t}' THEN 12 ELSE 0 END + CASE WHEN contains({_canonical_sql()}, '{t}') THEN 3 ELSE 0 END" for t in _TERMS)


def fuzzy_suggest(spark, sf_dir):
    """Event types for misspelt ones: prefixes, then parts, then within two edits; by distance, length and name."""
    asked = spark.createDataFrame([("clck",), ("view",), ("sign",), ("purchas",), ("err",)], "asked string")
    names = table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).distinct()
    d = F.levenshtein("asked", "name")
    rank = F.when(F.startswith("name", "asked"), 0).when(F.contains("name", "asked"), 1).otherwise(2)
    j = names.join(F.broadcast(asked), (rank <= 1) | (d <= 2)).select("asked", "name", rank.alias("rank"), d.alias("distance"))
    return j.withColumn("place", F.row_number().over(W.partitionBy("asked").orderBy("rank", "distance", F.length("name"), "name"))).select("asked", "name", "place")


def suggest_field(spark, sf_dir):
    """The shortest name that starts alike, or else the nearest within three edits."""
    asked = spark.createDataFrame([("p_nam",), ("p_bran",), ("ptype",), ("zzzzzz",)], "asked string")
    names = spark.createDataFrame([("p_name",), ("p_brand",), ("p_type",), ("p_size",)], "name string")
    d = F.levenshtein("asked", "name")
    j = asked.join(F.broadcast(names), F.startswith("name", "asked") | (d <= 3))
    return j.groupBy("asked").agg(F.min(F.struct(F.when(F.startswith("name", "asked"), 0).otherwise(1).alias("k"), F.when(F.startswith("name", "asked"), F.length("name")).otherwise(d).alias("d"), "name")).alias("s")).select("asked", F.col("s.name").alias("suggestion"))


def route_topk(spark, sf_dir):
    """Parts by how many words of a prompt their name and type hold: the best of each brand first, then the rest; ten."""
    words = ("small", "ring", "promo", "blue")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("hay"))
    score = F.lit(0)
    for w in words:
        score = score + F.when(F.contains("hay", F.lit(w)), 1).otherwise(0)
    s = p.withColumn("score", score).where("score > 0")
    s = s.withColumn("first", F.row_number().over(W.partitionBy("p_brand").orderBy(F.desc("score"), "p_partkey")) == 1)
    return s.orderBy(F.desc("first"), F.desc("score"), "p_brand", "p_partkey").limit(10).select("p_partkey", "score")


_ROUTE = " + ".join(f"CASE WHEN contains(hay, '{w}') THEN 1 ELSE 0 END" for w in ("small", "ring", "promo", "blue"))


def glob_files(spark, sf_dir):
    """Documents of sources src1*, newest (largest id) first, 100 at most, and whether there are more."""
    d = table(spark, sf_dir, "documents").where(F.col("source").rlike("^src1.*$")).select("doc_id")
    total = d.agg((F.count("*") > 100).alias("truncated"))
    return d.orderBy(F.desc("doc_id")).limit(100).crossJoin(F.broadcast(total))


def paginate(spark, sf_dir):
    return table(spark, sf_dir, "documents").orderBy("doc_id").offset(30).limit(250).select("doc_id")


def rerank_mock(spark, sf_dir):
    """The original order of the 30 longest documents, scored 1 - i / n."""
    d = table(spark, sf_dir, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(30).select("doc_id", "n_chars")
    return d.withColumn("i", F.row_number().over(W.orderBy(F.desc("n_chars"), "doc_id")) - 1).select("doc_id", F.round(1 - F.col("i") / 30.0, 6).alias("score"))


def domain_filter(spark, sf_dir):
    """Pages whose host is example.com or below it."""
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/:?#]*)", 1))
    return table(spark, sf_dir, "pages").select("page_id", ((host == "example.com") | F.endswith(host, F.lit(".example.com"))).alias("listed"))


def dedupe_urls(spark, sf_dir):
    """The first page of each address without its query and fragment."""
    return table(spark, sf_dir, "pages").groupBy(F.regexp_replace("url", "[?#].*$", "").alias("address")).agg(F.min("page_id").alias("page_id"))


def cosine(spark, sf_dir):
    """Each vector against the first of its label."""
    e = table(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))
    return e.join(first, "label").select("vec_id", F.round(_cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))


def l2_normalize(spark, sf_dir):
    n = _normalize(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(n[0], 6).alias("first"), F.round(n[63], 6).alias("last"))


def vector_topn(spark, sf_dir):
    """Twelve nearest of vec_id 7, by inner product of normalised vectors; other lengths find nothing."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 7").select(F.col("embedding").alias("q"))
    j = e.crossJoin(F.broadcast(q)).where(F.size("embedding") == F.size("q"))
    return j.select("vec_id", F.round(_cosine(F.col("embedding"), F.col("q")), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(12)


def mock_embed(spark, sf_dir):
    """Sixteen sums of the first 64 bytes (byte i to slot i modulo 16), divided by 255 and normalised; the first slot and the fullest."""
    b = F.encode("text", "UTF-8")
    n = F.least(F.octet_length("text"), F.lit(64))
    at = F.transform(F.sequence(F.lit(1), n), lambda i: F.conv(F.hex(F.substring(b, i, F.lit(1))), 16, 10).cast("int"))
    d = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", at.alias("bs"))
    v = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.aggregate(F.filter("bs", lambda x, i: F.pmod(i, F.lit(16)) == k), F.lit(0.0), lambda t, x: t + x / 255.0))
    d = d.select("doc_id", _normalize(v).alias("v"))
    return d.select("doc_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.array_max("v"), 6).alias("largest"))


QUERIES = {
    "grep_files": (grep_files, f"SELECT DISTINCT doc_id FROM {_LINES} WHERE regexp_matches(line, '{PATTERN}')"),
    "grep_content": (grep_content, f"""
        SELECT doc_id, line_number, md5(concat_ws(chr(10), before, line, after)) AS context_md5 FROM (SELECT *, lag(line) OVER w AS before, lead(line) OVER w AS after FROM {_LINES} WINDOW w AS (PARTITION BY doc_id ORDER BY line_number)) WHERE regexp_matches(line, '{PATTERN}')"""),
    "grep_count": (grep_count, f"SELECT doc_id, len(regexp_extract_all(text, '{PATTERN}')) AS n FROM documents WHERE regexp_matches(text, '{PATTERN}')"),
    "grep_literal": (grep_literal, f"SELECT doc_id, line_number FROM {_LINES} WHERE contains(line, 'thing') ORDER BY doc_id, line_number LIMIT 500"),
    "keyword_hits": (keyword_hits, f"""
        WITH k AS (SELECT keyword FROM (SELECT * FROM ({_KEPT_SQL}) WHERE rank < 8) GROUP BY keyword ORDER BY count(*) DESC, keyword LIMIT 10)
        SELECT keyword, doc_id FROM (SELECT keyword, doc_id, row_number() OVER (PARTITION BY keyword ORDER BY doc_id) AS r FROM documents JOIN k ON contains(text, keyword)) WHERE r <= 5"""),
    "ranked_search": (ranked_search, f"""
        SELECT p_partkey, score::BIGINT AS score FROM (SELECT *, {_SCORE} AS score FROM (SELECT p_partkey, lower(p_name) AS name, lower(p_name || ' ' || p_type) AS hay FROM part)) WHERE contains(hay, '{_TERMS[0]}') AND score > 0 ORDER BY score DESC, name, p_partkey LIMIT 20"""),
    "fuzzy_suggest": (fuzzy_suggest, """
        WITH a(asked) AS (VALUES ('clck'), ('view'), ('sign'), ('purchas'), ('err')), n AS (SELECT DISTINCT event_type AS name FROM events),
        j AS (SELECT asked, name, CASE WHEN starts_with(name, asked) THEN 0 WHEN contains(name, asked) THEN 1 ELSE 2 END AS rank, levenshtein(asked, name) AS d FROM a, n)
        SELECT asked, name, row_number() OVER (PARTITION BY asked ORDER BY rank, d, length(name), name) AS place FROM j WHERE rank <= 1 OR d <= 2"""),
    "suggest_field": (suggest_field, """
        WITH a(asked) AS (VALUES ('p_nam'), ('p_bran'), ('ptype'), ('zzzzzz')), n(name) AS (VALUES ('p_name'), ('p_brand'), ('p_type'), ('p_size'))
        SELECT asked, first(name ORDER BY NOT starts_with(name, asked), CASE WHEN starts_with(name, asked) THEN length(name) ELSE levenshtein(asked, name) END, name) AS suggestion FROM a, n WHERE starts_with(name, asked) OR levenshtein(asked, name) <= 3 GROUP BY asked"""),
    "route_topk": (route_topk, f"""
        SELECT p_partkey, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) = 1 AS first FROM (SELECT *, {_ROUTE} AS score FROM (SELECT p_partkey, p_brand, lower(p_name || ' ' || p_type) AS hay FROM part)) WHERE score > 0)
        ORDER BY first DESC, score DESC, p_brand, p_partkey LIMIT 10"""),
    "glob_files": (glob_files, "SELECT doc_id, (SELECT count(*) > 100 FROM documents WHERE source LIKE 'src1%') AS truncated FROM documents WHERE source LIKE 'src1%' ORDER BY doc_id DESC LIMIT 100"),
    "paginate": (paginate, "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 250 OFFSET 30"),
    "rerank_mock": (rerank_mock, "SELECT doc_id, round(1 - (row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1) / 30.0, 6) AS score FROM (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 30)"),
    "domain_filter": (domain_filter, "SELECT page_id, h = 'example.com' OR ends_with(h, '.example.com') AS listed FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)) AS h FROM pages)"),
    "dedupe_urls": (dedupe_urls, "SELECT regexp_replace(url, '[?#].*$', '') AS address, min(page_id) AS page_id FROM pages GROUP BY 1"),
    "cosine": (cosine, "SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q::DOUBLE[]), 6) AS similarity FROM embeddings e JOIN (SELECT label, arg_min(embedding, vec_id) AS q FROM embeddings GROUP BY label) f ON e.label = f.label"),
    "l2_normalize": (l2_normalize, "SELECT vec_id, round(v[1] / n, 6) AS first, round(v[64] / n, 6) AS last FROM (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))"),
    "vector_topn": (vector_topn, "SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY score DESC, vec_id LIMIT 12"),
    "mock_embed": (mock_embed, """
        WITH h AS (SELECT doc_id, hex(encode(text)) AS x, least(strlen(text), 64) AS n FROM documents WHERE text <> ''),
        b AS (SELECT doc_id, [('0x' || x[2 * i - 1:2 * i])::INTEGER for i in range(1, n + 1)] AS bs FROM h),
        v AS (SELECT doc_id, [coalesce(list_sum([bs[i] / 255.0 for i in range(k, len(bs) + 1, 16)]), 0) for k in range(1, 17)] AS v FROM b)
        SELECT doc_id, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first, round(list_max(v) / sqrt(list_inner_product(v, v)), 6) AS largest FROM v"""),
}
