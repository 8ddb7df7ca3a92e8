"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from quarry.llm import quality


def _list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def _quality() -> str:
    case = " ".join(f"WHEN '{k}' THEN {_list(v)}" for k, v in quality.COMMON.items())
    langs = ", ".join(f"'{k}'" for k in quality.COMMON)
    classes = ", ".join(f"length(regexp_replace(chars, '{v}', '', 'g'))" for v in quality.CLASSES.values())
    jsd = "sqrt(greatest(0.0, list_sum([{e} for x, i in {p}]) / 2))"
    term = "(CASE WHEN x > 0 THEN x * log2(x / ((x + {q}[i]) / 2)) ELSE 0.0 END + CASE WHEN {q}[i] > 0 THEN {q}[i] * log2({q}[i] / ((x + {q}[i]) / 2)) ELSE 0.0 END)"

    def distance(p, q):
        return jsd.format(e=term.format(q=q), p=p)

    return rf"""
WITH a AS (
  SELECT doc_id, coalesce(text, '') AS text, CASE WHEN lang IN ({langs}) THEN lang ELSE '*' END AS ref_lang,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (
  SELECT *, len(w) AS n_words, array_to_string(w, '') AS chars,
         [array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)] AS g,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         CASE ref_lang {case} ELSE {_list(quality.POOLED)} END AS listed FROM a),
win AS (SELECT doc_id, unnest(g) AS s, unnest(range(1, len(g) + 1)) AS i FROM b),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
c AS (
  SELECT b.doc_id, ref_lang, n_words, length(chars) AS word_chars, length(regexp_replace(chars, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         [{classes}] AS cls0, [len(list_filter(w, lambda x: x = y)) for y in listed] AS com0
  FROM b LEFT JOIN cov ON b.doc_id = cov.doc_id),
d AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED_PCT} * n_words AS base_failed,
         list_append(cls0, word_chars - list_sum(cls0)) AS cls, list_append(com0, n_words - list_sum(com0)) AS com FROM c),
rc AS (SELECT ref_lang, i, sum(x) AS x FROM (SELECT ref_lang, unnest(cls) AS x, unnest(range(1, len(cls) + 1)) AS i FROM d WHERE NOT base_failed) GROUP BY ALL),
rw AS (SELECT ref_lang, i, sum(x) AS x FROM (SELECT ref_lang, unnest(com) AS x, unnest(range(1, len(com) + 1)) AS i FROM d WHERE NOT base_failed) GROUP BY ALL),
qc AS (SELECT ref_lang, list(x::DOUBLE / t ORDER BY i) AS qc FROM (SELECT *, sum(x) OVER (PARTITION BY ref_lang) AS t FROM rc) GROUP BY ref_lang),
qw AS (SELECT ref_lang, list(x::DOUBLE / t ORDER BY i) AS qw FROM (SELECT *, sum(x) OVER (PARTITION BY ref_lang) AS t FROM rw) GROUP BY ref_lang),
e AS (
  SELECT d.*, qc, qw, [x::DOUBLE / word_chars for x in cls] AS pc, [x::DOUBLE / n_words for x in com] AS pw
  FROM d LEFT JOIN qc ON d.ref_lang = qc.ref_lang LEFT JOIN qw ON d.ref_lang = qw.ref_lang),
f AS (
  SELECT *, CASE WHEN word_chars > 0 AND qc IS NOT NULL THEN {distance("pc", "qc")} ELSE 0.0 END AS char_distance,
         CASE WHEN n_words > 0 AND qw IS NOT NULL THEN {distance("pw", "qw")} ELSE 0.0 END AS word_distance FROM e)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (word_chars >= {quality.MIN_CHARS} AND char_distance > {quality.MAX_CHAR_DISTANCE}
         OR n_words >= {quality.MIN_COMMON_WORDS} AND word_distance > {quality.MAX_WORD_DISTANCE}) AS kept,
       round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance
FROM f"""


_SUBSTRING = r"""
WITH a AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, unnest([array_to_string(w[j:j + 19], ' ') for j in range(1, len(w) - 18)]) AS s FROM a),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM late, (SELECT unnest(range(20)) AS k)),
g AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
k AS (
  SELECT a.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
         CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END AS kept
  FROM a LEFT JOIN g ON a.doc_id = g.doc_id)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k"""


_WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest, max(page_id) OVER (PARTITION BY sha1(b)) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < first THEN first END AS refers_to FROM d"""


_URLS = r"""
WITH p AS (SELECT page_id, url, 1704067200 + page_id * 977 % (30 * 86400) AS t,
  nullif(regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '\.$', ''), '') AS h FROM pages),
x AS (SELECT DISTINCT h, md5(h) AS m, 1704067200 + 86400 * (length(h) % 14) AS day FROM p WHERE h IS NOT NULL),
y AS (SELECT *, substr(m, 1, 1) AS f, CASE WHEN substr(m, 2, 1) < '8' THEN 'adult' ELSE 'spam' END AS category FROM x),
iv AS (
  SELECT h AS key, category, day AS s, day + 864000 AS e FROM y WHERE f IN ('0', '1', '2', '3') AND h NOT IN (SELECT array_to_string(string_split(h, '.')[-2:], '.') FROM y WHERE f = '4')
  UNION ALL SELECT h, category, day + 15 * 86400, NULL FROM y WHERE f IN ('0', '1') AND h NOT IN (SELECT array_to_string(string_split(h, '.')[-2:], '.') FROM y WHERE f = '4')
  UNION ALL SELECT DISTINCT array_to_string(string_split(h, '.')[-2:], '.'), category, 1704067200 + 19 * 86400, NULL FROM y WHERE f = '4'),
k AS (SELECT page_id, t, unnest([array_to_string(string_split(h, '.')[-i:], '.') for i in range(1, len(string_split(h, '.')) + 1)]) AS key FROM p WHERE h IS NOT NULL),
hit AS (SELECT page_id, k.key, category FROM k JOIN iv ON k.key = iv.key WHERE s <= t AND (e IS NULL OR t < e)),
best AS (SELECT page_id, count(*) AS n, first(key ORDER BY length(key) DESC, key, category) AS key, first(category ORDER BY length(key) DESC, key, category) AS category FROM hit GROUP BY page_id)
SELECT p.page_id, url, best.page_id IS NOT NULL AS blocked, coalesce(n, 0) AS n_matches, key AS matched_key, category
FROM p LEFT JOIN best ON p.page_id = best.page_id"""


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_PHRASES = rf"""
WITH piece AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_LETTERS}), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, phrase, k, count(*) AS f FROM (
    SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k))
  GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (SELECT lang, phrase, f AS a, w, unnest(range(1, k)) AS i FROM c),
s AS (
  SELECT cut.lang, cut.phrase, a, i, x.f AS l, y.f AS r, 2000000::HUGEINT * a // (x.f::HUGEINT + y.f) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(w[1:i], ' ') JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(w[i + 1:], ' ')),
low AS (SELECT lang, phrase, a, l, r, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
part AS (
  SELECT lang, f, unnest(list_concat([array_to_string(w[i:i + 1], ' ') for i in range(1, len(w))], CASE WHEN len(w) = 4 THEN [array_to_string(w[1:3], ' '), array_to_string(w[2:4], ' ')] ELSE [] END)) AS phrase
  FROM c WHERE k > 2),
held AS (SELECT lang, phrase, max(f) AS longer FROM part GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN held ON held.lang = low.lang AND held.phrase = low.phrase WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN total ON total.lang = kept.lang QUALIFY rank <= 2000"""

#: Words as op13 counts them; CRC-32 over the UTF-8 bytes, with its table made by the rule of its polynomial.
_VARIANTS = rf"""
WITH RECURSIVE step AS (
  SELECT range AS i, range::BIGINT AS v, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM step WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS tab FROM step WHERE k = 8),
run AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents) WHERE length(w) >= 5 GROUP BY ALL),
raw AS (SELECT w, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM run),
hashed AS (
  SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(x, j, 2))::BIGINT for j in range(1, len(x), 2)]), lambda a, b: xor(a // 256, tab[xor(a % 256, b) + 1])), 4294967295) AS h
  FROM raw, crc),
word AS (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
gap AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS g FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word)),
near AS (
  SELECT DISTINCT word, near, near_n FROM (
    SELECT a.word, b.word AS near, b.n AS near_n FROM gap a JOIN gap b ON a.g = b.g AND a.i = b.i AND a.word <> b.word
    UNION ALL SELECT a.word, b.word, b.n FROM gap a JOIN word b ON a.g = b.word
    UNION ALL SELECT b.word, a.word, a.n FROM gap a JOIN word b ON a.g = b.word)),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS form, max(near_n) AS form_n FROM near GROUP BY word),
v AS (
  SELECT word.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n
  FROM word LEFT JOIN best ON best.word = word.word),
walk AS (SELECT word, coalesce(form, word) AS here, 0 AS k FROM v UNION ALL SELECT walk.word, v.form, k + 1 FROM walk JOIN v ON v.word = walk.here WHERE v.form IS NOT NULL),
root AS (SELECT word, arg_max(here, k) AS root FROM walk GROUP BY word)
SELECT v.word, form, root, n, n_near, form_n FROM v JOIN root ON root.word = v.word"""


def oracle_sql() -> dict[str, str]:
    return {"op11_phrase_collocations": _PHRASES, "op13_spelling_variants": _VARIANTS, "op1_substring_dedup": _SUBSTRING, "op5_url_filters": _URLS, "op6_warc": _WARC, "op9_quality_rules": _quality()}
