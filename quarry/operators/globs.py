"""Globs over tables of paths, and ignore files: the last rule that matches decides, deeper files before others, an ignored folder for all below it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that stand in for parts of a pattern while it becomes a regular expression.
_STAR, _QUESTION, _BRACKET, _DEEP = "\x01", "\x02", "\x03", "\x04"


def expand_braces(pattern: str) -> list[str]:
    """A pattern's alternatives, group by group from the left: `a.{b,c}` is `a.b` and `a.c`. A brace without its partner stands for itself."""
    before, brace, rest = pattern.partition("{")
    inner, close, after = rest.partition("}")
    if not brace or not close:
        return [pattern]
    return [x for one in inner.split(",") for x in expand_braces(before + one + after)]


def glob_regex(pattern: Column, crosses: bool) -> Column:
    """A glob as a regular expression for a whole path: `*`, `?`, classes and escapes; `crosses` tells whether the first two match a slash.

    Else `**` as a whole segment matches any number of segments.
    """
    p = pattern
    for escaped, mark in (("\\*", _STAR), ("\\?", _QUESTION), ("\\[", _BRACKET)):
        p = F.replace(p, F.lit(escaped), F.lit(mark))
    p = F.regexp_replace(p, r"\\(.)", "$1")
    p = F.regexp_replace(p, r"([.^$+(){}|\\])", r"\\$1")
    p = F.regexp_replace(p, r"\[!", "[^")
    p = F.regexp_replace(p, r"\[\\\^", "[^")
    p = F.regexp_replace(p, r"\[(?![^\]]+\])", r"\\[")  # a class that never closes
    if crosses:
        p = F.regexp_replace(p, r"\*+", _DEEP)
        p = F.replace(F.replace(p, F.lit("?"), F.lit(".")), F.lit(_DEEP), F.lit(".*"))
    else:
        p = F.regexp_replace(p, r"(^|/)\*\*/(?:\*\*/)*", f"$1{_DEEP}/")
        p = F.regexp_replace(p, r"/\*\*$", f"/{_DEEP}")
        p = F.regexp_replace(p, r"^\*\*$", _DEEP)
        p = F.replace(F.regexp_replace(p, r"\*+", "[^/]*"), F.lit("?"), F.lit("[^/]"))
        p = F.replace(F.replace(p, F.lit(f"{_DEEP}/"), F.lit("(?:.*/)?")), F.lit(_DEEP), F.lit(".+"))
    for mark, escaped in ((_STAR, "\\*"), (_QUESTION, "\\?"), (_BRACKET, "\\[")):
        p = F.replace(p, F.lit(mark), F.lit(escaped))
    return F.concat(F.lit("(?s)^"), p, F.lit("$"))


def matches_glob(path: Column, pattern: str) -> Column:
    """Whether a path as a whole matches a glob with braces, whose `*` and `?` match slashes too."""
    found = F.lit(False)
    for one in expand_braces(pattern):
        found = found | F.rlike(path, glob_regex(F.lit(one), True))
    return F.coalesce(found, F.lit(False))


def matches_filters(path: Column, glob: str | None = None, file_type: str | None = None) -> Column:
    """The filters of a content search: a glob over the path, and the extension, letters' case as it is. A filter that isn't given passes all."""
    ok = matches_glob(path, glob) if glob else F.lit(True)
    return ok & (F.regexp_extract(path, r"[^/]\.([^./]*)$", 1) == file_type) if file_type else ok


def ignore_rules(ignore_files: DataFrame, names: tuple[str, ...] = (".gitignore", ".ignore")) -> DataFrame:
    """The rules of ignore files (folder, name, text): (folder, level, line, keeps, folders_only, regex).

    folder is relative with slashes, "" the root; a name's level is its place in `names`, and
    files of other names are left out. Blank lines and those that start with # are no rules;
    `!` keeps what an earlier rule ignores; a slash at the end means folders only, one elsewhere ties the rule to
    its folder, else it matches at any depth below. Patterns are in terms of the path below the folder.
    """
    level = F.array_position(F.array(*map(F.lit, names)), F.col("name"))
    lines = ignore_files.where(F.col("name").isin(*names)).select(F.coalesce("folder", F.lit("")).alias("folder"), level.alias("level"), F.posexplode(F.split("text", "\r?\n")).alias("line", "rule"))
    lines = lines.withColumn("rule", F.regexp_replace("rule", r"(?<!\\)\s+$", "")).where((F.col("rule") != "") & ~F.startswith("rule", F.lit("#")))
    keeps = F.startswith("rule", F.lit("!"))
    lines = lines.withColumn("keeps", keeps).withColumn("rule", F.when(keeps, F.expr("substring(rule, 2)")).otherwise(F.col("rule")))
    lines = lines.withColumn("folders_only", F.endswith("rule", F.lit("/"))).withColumn("rule", F.regexp_replace("rule", "/+$", "")).where("rule <> ''")
    tied = F.contains("rule", F.lit("/"))
    glob = F.when(tied, F.regexp_replace("rule", "^/", "")).otherwise(F.concat(F.lit("**/"), "rule"))
    return lines.select("folder", "level", "line", "keeps", "folders_only", glob_regex(glob, False).alias("regex"))


def _prefixes(path: Column) -> Column:
    """A path and all folders above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def not_ignored(files: DataFrame, ignore_files: DataFrame, names: tuple[str, ...] = (".gitignore", ".ignore")) -> DataFrame:
    """The rows of files (path, ...) that a walk under ignore files (folder, name, text) would reach.

    Of a path and of every folder above it the deciding rule is, of the last name in `names`
    that has one, that of the deepest folder above, and there the last line that matches; a path below an
    ignored folder is ignored whatever rules lie deeper. Rules meet paths by folder, a row for
    each ignore file. Null paths are left out; repeated rows stay as they are.
    """
    rules = ignore_rules(ignore_files, names)
    held = rules.groupBy("folder", "level").agg(F.array_sort(F.collect_list(F.struct("line", "keeps", "folders_only", "regex"))).alias("rules"))
    paths = files.where("path is not null").select("path").distinct()
    entries = paths.select(F.explode(_prefixes(F.col("path"))).alias("entry"), "path").select("entry", (F.col("entry") != F.col("path")).alias("is_folder")).groupBy("entry").agg(F.max("is_folder").alias("is_folder"))
    above = F.concat(F.array(F.lit("")), F.slice(_prefixes(F.col("entry")), F.lit(1), F.size(F.split("entry", "/")) - 1))
    near = entries.select("entry", "is_folder", F.posexplode(above).alias("depth", "folder")).join(held, "folder")
    below = F.when(F.col("folder") == "", F.col("entry")).otherwise(F.expr("substring(entry, length(folder) + 2)"))
    last = F.element_at(F.concat(F.array(F.lit(None).cast("boolean")), F.transform(F.filter("rules", lambda r: (~r["folders_only"] | F.col("is_folder")) & F.rlike(below, r["regex"])), lambda r: r["keeps"])), -1)
    verdict = near.withColumn("keeps", last).where("keeps is not null").groupBy("entry").agg(F.max_by("keeps", F.struct("level", "depth")).alias("keeps"))
    ignored = verdict.where("not keeps").select("entry")
    gone = paths.select("path", F.explode(_prefixes(F.col("path"))).alias("entry")).join(ignored, "entry", "left_semi").select("path").distinct()
    return files.where("path is not null").join(gone, "path", "left_anti").select(files.columns)


def glob_files(files: DataFrame, ignore_files: DataFrame, pattern: str, root: str = "", max_depth: int | None = None, max_paths: int | None = None, names: tuple[str, ...] = (".gitignore", ".ignore")) -> DataFrame:
    """(path): files below a root folder whose path there matches a glob and that no ignore file hides, each once; with max_paths the first ones in order.

    max_depth counts the segments below the root. A pattern with `..` is refused.
    """
    if ".." in pattern:
        raise ValueError("a glob must not contain '..'")
    folder = root.strip("/")
    rel = F.expr(f"substring(path, {len(folder) + 2})") if folder else F.col("path")
    found = files.select("path").distinct().where(F.startswith("path", F.lit(folder + "/")) if folder else F.col("path").isNotNull())
    found = found.where(matches_glob(rel, pattern))
    if max_depth is not None:
        found = found.where(F.size(F.split(rel, "/")) <= max(1, max_depth))
    found = not_ignored(found, ignore_files, names)
    return found if max_paths is None else found.orderBy("path").limit(max_paths)
