"""Chunking, extraction and classification of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import index as X
from quarry.plans.common import expand_sql, table

_TRIMMED = "trim(translate({}, chr(10) || chr(9) || chr(13), '   '))"


def chunk_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(T.chunk_chars(F.col("text"))).alias("ordinal", "chunk")).select("doc_id", "ordinal", F.md5("chunk").alias("chunk_md5"), F.length("chunk").alias("n_chars"))


def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.chunk_lines(F.col("text"))).alias("c"))
    return d.select("doc_id", "c.line_start", "c.line_end", F.md5("c.text").alias("chunk_md5"))


def line_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 3 to 6 of every document of 10 MiB at most without a NUL in its first 8 KiB."""
    d = table(spark, sf_dir, "documents").where((F.octet_length("text") <= 10 << 20) & ~F.contains(F.substring("text", 1, 8192), F.lit("\0")))
    return d.select("doc_id", F.posexplode(T.text_lines(F.col("text"))).alias("p", "line")).where(F.col("p").between(2, 5)).select("doc_id", (F.col("p") + 1).alias("line_number"), "line")


def extract_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight identifiers a document at most; a repeat next to its like goes before the cap."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.keywords(F.col("text")).alias("ks"))
    ks = F.col("ks")
    kept = F.slice(F.filter(ks, lambda k, i: (i == 0) | (k != F.get(ks, i - 1))), 1, 8)
    return d.select("doc_id", F.posexplode(kept).alias("rank", "keyword"))


def expand_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's keywords with the terms of frameworks that they name and their synonyms."""
    k = extract_keywords(spark, sf_dir).select(F.col("doc_id").alias("query"), F.col("rank").alias("pos"), "keyword")
    return X.expand_keywords(k).select(F.col("query").alias("doc_id"), F.col("pos").alias("rank"), F.col("keyword").alias("term"))


_KEYWORDS_SQL = """
  SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id ORDER BY -length(k), i) AS r FROM (
    SELECT doc_id, unnest(ks) AS k, unnest(range(len(ks))) AS i FROM (SELECT doc_id, list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]+'), lambda x: length(x) >= 3 AND regexp_matches(x, '[A-Z_]')) AS ks FROM documents))"""
_KEPT_SQL = f"""
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY r) - 1 AS rank, k AS keyword
  FROM (SELECT *, lag(k) OVER (PARTITION BY doc_id ORDER BY r) AS was FROM ({_KEYWORDS_SQL})) WHERE was IS NULL OR was <> k"""

_TRACES = ('File "src/app.py", line 12', "ValueError: bad input here", "AssertionError: left side differs", "no signal at all", 'File "lib/x.py", line 7 then KeyError: k')


def _phrase(spark: SparkSession, sf_dir: str, phrases: tuple[str, ...]) -> DataFrame:
    """Events with a text each, chosen by event_id, as no table holds such texts."""
    return table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*map(F.lit, phrases)), (F.col("event_id") % len(phrases) + 1).cast("int")).alias("text"))


def _phrase_sql(phrases: tuple[str, ...]) -> str:
    quoted = ", ".join("'" + p.replace("'", "''") + "'" for p in phrases)
    return f"(SELECT event_id, [{quoted}][event_id % {len(phrases)} + 1] AS text FROM events)"


def error_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traceback frames first, then error types whose message is new; five at most."""
    e = _phrase(spark, sf_dir, _TRACES)
    frames = F.transform(F.regexp_extract_all("text", F.lit('File\\s+"([^"]+)",\\s*line\\s+(\\d+)'), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, '"([^"]+)"', 1).alias("file_path"), F.regexp_extract(m, "line\\s+(\\d+)", 1).cast("int").alias("line"), F.lit(None).cast("string").alias("error_type"), m.alias("message")))
    types = F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit("(\\w+(?:Error|Exception|Warning))(?::|\\.|\\s)"), F.lit(0))), lambda m: F.struct(F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("int").alias("line"), F.regexp_extract(m, "(\\w+)", 1).alias("error_type"), m.alias("message")))
    return e.select("event_id", F.posexplode(F.slice(F.concat(frames, types), 1, 5)).alias("ordinal", "s")).select("event_id", "ordinal", "s.*")


_SOURCES = ("import os", "from foo.bar import baz", "x = 1", "import numpy, sys", "  from a import b", "importlib.reload(x)")


def import_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _phrase(spark, sf_dir, _SOURCES)
    t = F.trim("text")
    module = F.when(F.startswith(t, F.lit("from ")), F.regexp_extract(t, "^from ([^ \t]*)", 1)).when(F.startswith(t, F.lit("import ")), F.regexp_extract(t, "^import ([^ \t,]*)", 1))
    top = F.split_part(F.rtrim(module, F.lit(",")), F.lit("."), F.lit(1))
    m = e.select("event_id", top.alias("top")).where("top is not null and top not in ('', 'import')")
    return m.select("event_id", F.explode(F.array(F.concat("top", F.lit(".py")), F.concat("top", F.lit("/__init__.py")))).alias("target")).distinct()


_DIFFS = ("--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@", "+++ /dev/null\n", "+++ b/src/y.rs\n+++ b/z.md\n", "no patch")


def diff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _phrase(spark, sf_dir, _DIFFS).select("event_id", F.explode(T.text_lines(F.col("text"))).alias("line")).where("line like '+++ %'")
    path = F.trim(F.substring("line", 5, 4096))
    return e.select("event_id", F.regexp_replace(path, "^b/", "").alias("path")).where("path <> '/dev/null'").distinct()


def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.html_to_text(F.col("html"))).alias("text_md5"))


def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(F.nullif(T.collapse_spaces(t), F.lit("")), F.lit("untitled")).alias("title"))


def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors in page order: target and visible text."""
    p = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="[^"]*">[^<]*</a>'), F.lit(0))).alias("ordinal", "a"))
    return p.select("page_id", "ordinal", F.regexp_extract("a", 'href="([^"]*)"', 1).alias("href"), F.regexp_extract("a", ">([^<]*)<", 1).alias("label"))


def normalize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct collapsed lines (first spelling of equal ones ignoring case) cut to 160 characters with an ellipsis."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.text_lines(F.col("text"))).alias("pos", "line")).withColumn("line", T.collapse_spaces(F.col("line"))).where("line <> ''")
    first = d.groupBy("doc_id", F.lower("line").alias("low")).agg(F.min(F.struct("pos", "line")).alias("s"))
    return first.select("doc_id", F.col("s.pos").alias("pos"), F.md5(T.ellipsis(F.col("s.line"), 160)).alias("line_md5"))


def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.token_estimate(F.col("text")).cast("long").alias("by_chars"), T.byte_token_estimate(F.col("text")).cast("long").alias("by_bytes"))


_SECRETS = ("run with OPENAI_API_KEY=abc123 now", "Authorization: Bearer zz9,next", "Bearer sk-1 and XAI_API_KEY=q\"x", "nothing here", "DASHSCOPE_API_KEY=")


def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phrase(spark, sf_dir, _SECRETS).select("event_id", T.redact_secrets(F.col("text")).alias("text"))


def _redact_sql() -> str:
    t = "text"
    for m in T.SECRET_MARKERS:
        t = f"regexp_replace({t}, '{m}[^ \\t\\n\\r''\",}}\\]]*', '{m}{T.REDACTED}', 'g')"
    return f"SELECT event_id, {t} AS text FROM {_phrase_sql(_SECRETS)}"


_ARTIFACTS = ("fixed in 1a2b3c4d5e see src/lib.rs and #12", "docs/readme.md only", "commit deadbeef00 closes #7 #8", "plain words")


def artifact_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File paths, the first commit hash (7 to 40 hexadecimal digits) and item numbers of a summary."""
    e = _phrase(spark, sf_dir, _ARTIFACTS)
    def found(p):
        return F.regexp_extract_all("text", F.lit(p), F.lit(0))

    return e.select("event_id", F.array_join(found("[A-Za-z0-9_./-]+\\.[a-z]+"), ",").alias("paths"), F.regexp_extract("text", "(^|[^0-9a-z])([0-9a-f]{7,40})($|[^0-9a-z])", 2).alias("sha"), F.array_join(found("#[0-9]+"), ",").alias("items"))


_REVIEWS = ("APPROVE: looks right", "REJECT - missing tests", "blocked on review", "approved by two", "recovered after retry")


def outcome_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    out = F.when(low.rlike("^approve"), "approve").when(low.rlike("^reject"), "reject").when(F.contains(low, F.lit("blocked")), "blocked")
    return _phrase(spark, sf_dir, _REVIEWS).select("event_id", F.coalesce(out, F.lit("none")).alias("verdict"), F.contains(low, F.lit("recover")).alias("recovered"))


CONTROL_WORDS = ("commit", "push", "resume", "stop", "continue", "done", "ok")


def summary_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons against a turn's text as a summary: empty, control words only, under seven words without context."""
    c = table(spark, sf_dir, "conversations")
    ws = F.filter(F.split(F.lower("text"), "[^a-z0-9#-]+"), lambda w: w != "")
    n = F.size(ws)
    signal = F.col("text").rlike("[`/:#]")
    reasons = F.array_compact(F.array(F.when(T.collapse_spaces(F.col("text")) == "", "empty"), F.when((n > 0) & F.forall(ws, lambda w: w.isin(*CONTROL_WORDS)), "control_only"), F.when((n < 7) & ~signal, "too_short_without_context")))
    return c.select("conv_id", "turn", n.cast("long").alias("word_count"), F.array_join(reasons, ",").alias("reasons"))


_ERRORS = ("prompt was not delivered", "Trust gate open", "branch is stale", "gateway timeout", "build failed", "test x broke", "tool runtime died", "workspace path mismatch", "plugin crash", "mcp handshake", "mcp gone", "disk full", "cargo check", "branch diverged")
_COMMANDS = ("ls -la", "rm -rf x", "git status", "git -c a push", "curl http://x", "sed -i s/a/b/ f", "sed s/a/b/ f", "pip install x", "sudo reboot", "kill 3", "cp a b", "foo bar", "git diff HEAD",
    "dd if=a of=b", "shred x", "less f", "rsync a b", "apt-get update", "ps aux", 'A=1 B="x y" cat f', "A=1", "git stash", "wipefs /dev/x", "chroot d")


def failure_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phrase(spark, sf_dir, _ERRORS).select("event_id", T.failure_class(F.col("text")).alias("failure_class"))


def _failure_sql() -> str:
    def way(words):
        return " AND ".join(f"contains(lower(text), '{w}')" for w in words)

    case = " ".join(f"WHEN {' OR '.join('(' + way(ws) + ')' for ws in ways)} THEN '{name}'" for name, ways in T.FAILURES)
    return f"SELECT event_id, CASE {case} ELSE 'infra' END AS failure_class FROM {_phrase_sql(_ERRORS)}"


def command_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phrase(spark, sf_dir, _COMMANDS).select("event_id", T.command_intent(F.col("text")).alias("intent"))


def _intent_sql() -> str:
    def names(xs):
        return ", ".join(f"'{x}'" for x in xs)

    case = " ".join(f"WHEN f IN ({names(xs)}) THEN '{n}'" for n, xs in T.INTENTS)
    assigned = T.ASSIGNMENTS.replace("'", "''")
    return f"""SELECT event_id, CASE WHEN f = 'sed' AND contains(text, ' -i') THEN 'write' {case}
      WHEN f = 'git' THEN CASE WHEN list_filter(p[2:], lambda x: NOT starts_with(x, '-'))[1] IN ({names(T.GIT_READ_ONLY)}) THEN 'read_only' ELSE 'write' END ELSE 'unknown' END AS intent
      FROM (SELECT *, string_split_regex(trim(text), '[ \\t]+') AS p, string_split_regex(regexp_replace(trim(text), '{assigned}', ''), '[ \\t]+')[1] AS f FROM {_phrase_sql(_COMMANDS)})"""


CATEGORIES = (("boot", ("worker", "boot", "trust")), ("event_report", ("event", "report")), ("branch_recovery", ("branch", "recover")), ("docs_license", ("docs", "license")))
_TITLES = ("Worker boot fix", "Event stream", "Branch recovery", "Docs and license", "Misc work", "Trust prompt", "Reporting")


def keyword_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, out = F.lower("text"), F.lit("governance")
    for name, words in reversed(CATEGORIES):
        out = F.when(low.rlike("|".join(words)), name).otherwise(out)
    return _phrase(spark, sf_dir, _TITLES).select("event_id", out.alias("category"), F.substring(F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), "^-|-$", ""), 1, 54).alias("slug"))


def _category_sql() -> str:
    case = " ".join(f"WHEN regexp_matches(lower(text), '{'|'.join(ws)}') THEN '{n}'" for n, ws in CATEGORIES)
    return f"SELECT event_id, CASE {case} ELSE 'governance' END AS category, substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 54) AS slug FROM {_phrase_sql(_TITLES)}"


def startup_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence flags made of event_id's bits, judged in the fixed order."""
    i = F.col("event_id").cast("int")
    def bit(k):
        return F.shiftright(i, k).bitwiseAND(F.lit(1)) == 1

    out = F.when(~bit(0), "transport_dead").when(bit(1) & bit(2), "trust_required").when(bit(3) & bit(4), "tool_permission_required").when(bit(5) & ~bit(6) & bit(7), "prompt_acceptance_timeout").when(bit(5) & ~bit(6) & (F.col("event_id") % 60 > 30), "prompt_misdelivery").when(~bit(8), "worker_crashed").otherwise("unknown")
    return table(spark, sf_dir, "events").select("event_id", out.alias("startup_class"))


def state_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _phrase(spark, sf_dir, ("background job", "merge conflict", "mcp down", "broken pipe", "idle", ""))
    status = F.element_at(F.array(*map(F.lit, ("running", "completed", "failed", "blocked"))), (F.col("event_id") % 4 + 1).cast("int"))
    out = F.when(status == "running", "working").when(status == "completed", F.when(F.col("event_id") % 3 == 0, "finished_cleanable").otherwise("finished_pending_report"))
    for words, name in ((("background",), "blocked_background_job"), (("merge conflict", "cherry-pick"), "blocked_merge_conflict"), (("mcp",), "degraded_mcp"), (("transport", "broken pipe", "connection", "interrupted"), "interrupted_transport")):
        out = out.when(F.lower("text").rlike("|".join(words)), name)
    return e.select("event_id", out.otherwise("truly_idle").alias("state"))


def intent_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    out = F.when(low.rlike("audit|review|security"), "audit").when(low.rlike("implement|add|fix"), "implement").when(low.rlike("explain|what|why"), "explain").otherwise("none")
    return _phrase(spark, sf_dir, ("Audit this", "please implement", "explain why", "hello", "fix and review")).select("event_id", out.alias("preset"))


def glob_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as paths against src1* and src?: a star crosses separators."""
    p = F.concat_ws("/", "source", "doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", p.rlike("^src1.*$").alias("starred"), p.rlike("^src./.*$").alias("single"))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 stands in for a hash that Spark lacks."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("long").alias("size_bytes"))


def dedupe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each normalised text (blank lines collapsed, ends trimmed)."""
    n = F.trim(F.regexp_replace("text", "\n\n+", "\n"))
    return table(spark, sf_dir, "documents").groupBy(F.sha2(n, 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies")).select("doc_id", "n_copies")


QUERIES = {
    "chunk_chars": (chunk_chars, f"""
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS ordinal, md5(c) AS chunk_md5, length(c) AS n_chars FROM (
          SELECT doc_id, s, substr(text, s + 1, 900) AS c FROM (SELECT doc_id, text, unnest(range(0, greatest(ceil((length(text) - 900) / 780.0), 0)::BIGINT * 780 + 1, 780)) AS s FROM documents WHERE length(text) > 0))
        WHERE {_TRIMMED.format('c')} <> ''"""),
    "chunk_lines": (chunk_lines, """
        WITH l AS (SELECT doc_id, string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10)) AS ls FROM documents WHERE text <> '')
        SELECT doc_id, s + 1 AS line_start, least(s + 50, len(ls)) AS line_end, md5(array_to_string(ls[s + 1:s + 50], chr(10))) AS chunk_md5
        FROM (SELECT *, unnest(range(0, greatest(ceil((len(ls) - 50) / 40.0), 0)::BIGINT * 40 + 1, 40)) AS s FROM l)"""),
    "line_window": (line_window, """
        WITH l AS (SELECT doc_id, string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10)) AS ls FROM documents WHERE text <> '')
        SELECT doc_id, i AS line_number, ls[i] AS line FROM (SELECT *, unnest(range(3, least(6, len(ls)) + 1)) AS i FROM l)"""),
    "extract_keywords": (extract_keywords, f"SELECT * FROM ({_KEPT_SQL}) WHERE rank < 8"),
    "expand_query": (expand_query, f"WITH k AS (SELECT doc_id AS query, rank AS pos, keyword FROM ({_KEPT_SQL}) WHERE rank < 8) SELECT query AS doc_id, pos AS rank, keyword AS term FROM {expand_sql('k')}"),
    "error_signals": (error_signals, f"""
        WITH m AS (SELECT event_id, 0 AS kind, unnest(regexp_extract_all(text, 'File\\s+"[^"]+",\\s*line\\s+\\d+')) AS message FROM {_phrase_sql(_TRACES)}
          UNION ALL SELECT event_id, 1, unnest(regexp_extract_all(text, '\\w+(?:Error|Exception|Warning)(?::|\\.|\\s)')) FROM {_phrase_sql(_TRACES)})
        SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY kind, message) - 1 AS ordinal, CASE WHEN kind = 0 THEN regexp_extract(message, '"([^"]+)"', 1) END AS file_path,
               CASE WHEN kind = 0 THEN regexp_extract(message, 'line\\s+(\\d+)', 1)::INTEGER END AS line, CASE WHEN kind = 1 THEN regexp_extract(message, '(\\w+)', 1) END AS error_type, message FROM m"""),
    "import_targets": (import_targets, f"""
        WITH m AS (SELECT event_id, string_split(rtrim(CASE WHEN starts_with(trim(text), 'from ') THEN regexp_extract(trim(text), '^from ([^ \\t]*)', 1) WHEN starts_with(trim(text), 'import ') THEN regexp_extract(trim(text), '^import ([^ \\t,]*)', 1) END, ','), '.')[1] AS top FROM {_phrase_sql(_SOURCES)})
        SELECT DISTINCT event_id, unnest([top || '.py', top || '/__init__.py']) AS target FROM m WHERE top NOT IN ('', 'import')"""),
    "diff_files": (diff_files, f"""
        SELECT DISTINCT event_id, regexp_replace(trim(substr(line, 5)), '^b/', '') AS path FROM (SELECT event_id, unnest(string_split(text, chr(10))) AS line FROM {_phrase_sql(_DIFFS).replace(chr(10), "' || chr(10) || '")})
        WHERE starts_with(line, '+++ ') AND trim(substr(line, 5)) <> '/dev/null'"""),
    "html_to_text": (html_to_text, """
        SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'))) AS text_md5 FROM pages"""),
    "html_title": (html_title, "SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g')), ''), 'untitled') AS title FROM pages"),
    "extract_links": (extract_links, """
        SELECT page_id, ordinal, regexp_extract(a, 'href="([^"]*)"', 1) AS href, regexp_extract(a, '>([^<]*)<', 1) AS label
        FROM (SELECT page_id, unnest(x) AS a, unnest(range(len(x))) AS ordinal FROM (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS x FROM pages))"""),
    "normalize_lines": (normalize_lines, """
        WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS ls FROM documents),
        x AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS raw FROM l), y AS (SELECT doc_id, pos, trim(regexp_replace(raw, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g')) AS line FROM x),
        z AS (SELECT doc_id, min(pos) AS pos, arg_min(line, pos) AS line FROM y WHERE line <> '' GROUP BY doc_id, lower(line))
        SELECT doc_id, pos, md5(CASE WHEN length(line) > 160 THEN substr(line, 1, 159) || '…' ELSE line END) AS line_md5 FROM z"""),
    "token_estimate": (token_estimates, "SELECT conv_id, turn, length(text) // 4 + 1 AS by_chars, strlen(text) // 4 + 1 AS by_bytes FROM conversations"),
    "redact_secrets": (redact_secrets, _redact_sql()),
    "artifact_refs": (artifact_refs, f"""
        SELECT event_id, array_to_string(regexp_extract_all(text, '[A-Za-z0-9_./-]+\\.[a-z]+'), ',') AS paths, regexp_extract(text, '(^|[^0-9a-z])([0-9a-f]{{7,40}})($|[^0-9a-z])', 2) AS sha, array_to_string(regexp_extract_all(text, '#[0-9]+'), ',') AS items FROM {_phrase_sql(_ARTIFACTS)}"""),
    "outcome_parse": (outcome_parse, f"SELECT event_id, CASE WHEN lower(text) LIKE 'approve%' THEN 'approve' WHEN lower(text) LIKE 'reject%' THEN 'reject' WHEN contains(lower(text), 'blocked') THEN 'blocked' ELSE 'none' END AS verdict, contains(lower(text), 'recover') AS recovered FROM {_phrase_sql(_REVIEWS)}"),
    "summary_quality": (summary_quality, f"""
        SELECT conv_id, turn, len(ws) AS word_count, array_to_string(list_filter([CASE WHEN trim(text) = '' THEN 'empty' END, CASE WHEN len(ws) > 0 AND len(list_filter(ws, lambda w: w NOT IN ({', '.join(f"'{w}'" for w in CONTROL_WORDS)}))) = 0 THEN 'control_only' END,
          CASE WHEN len(ws) < 7 AND NOT regexp_matches(text, '[`/:#]') THEN 'too_short_without_context' END], lambda x: x IS NOT NULL), ',') AS reasons
        FROM (SELECT *, list_filter(string_split_regex(lower(text), '[^a-z0-9#-]+'), lambda w: w <> '') AS ws FROM conversations)"""),
    "failure_class": (failure_class, _failure_sql()),
    "command_intent": (command_intent, _intent_sql()),
    "keyword_category": (keyword_category, _category_sql()),
    "startup_class": (startup_class, """
        SELECT event_id, CASE WHEN event_id & 1 = 0 THEN 'transport_dead' WHEN event_id & 6 = 6 THEN 'trust_required' WHEN event_id & 24 = 24 THEN 'tool_permission_required' WHEN event_id & 224 = 160 THEN 'prompt_acceptance_timeout'
          WHEN event_id & 96 = 32 AND event_id % 60 > 30 THEN 'prompt_misdelivery' WHEN event_id & 256 = 0 THEN 'worker_crashed' ELSE 'unknown' END AS startup_class FROM events"""),
    "state_label": (state_label, f"""
        SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'working' WHEN event_id % 4 = 1 THEN CASE WHEN event_id % 3 = 0 THEN 'finished_cleanable' ELSE 'finished_pending_report' END WHEN contains(text, 'background') THEN 'blocked_background_job'
          WHEN contains(text, 'merge conflict') THEN 'blocked_merge_conflict' WHEN contains(text, 'mcp') THEN 'degraded_mcp' WHEN contains(text, 'broken pipe') THEN 'interrupted_transport' ELSE 'truly_idle' END AS state
        FROM {_phrase_sql(("background job", "merge conflict", "mcp down", "broken pipe", "idle", ""))}"""),
    "intent_preset": (intent_preset, f"""
        SELECT event_id, CASE WHEN regexp_matches(lower(text), 'audit|review|security') THEN 'audit' WHEN regexp_matches(lower(text), 'implement|add|fix') THEN 'implement' WHEN regexp_matches(lower(text), 'explain|what|why') THEN 'explain' ELSE 'none' END AS preset
        FROM {_phrase_sql(("Audit this", "please implement", "explain why", "hello", "fix and review"))}"""),
    "glob_match": (glob_match, "SELECT doc_id, source || '/' || doc_id LIKE 'src1%' AS starred, source || '/' || doc_id LIKE 'src_/%' AS single FROM documents"),
    "content_hash": (content_hash, "SELECT doc_id, sha256(text) AS content_hash, strlen(text) AS size_bytes FROM documents"),
    "dedupe_documents": (dedupe_documents, "SELECT min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY trim(regexp_replace(text, '\\n\\n+', chr(10), 'g'))"),
}
