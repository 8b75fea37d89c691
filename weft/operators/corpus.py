"""Corpus metrics and rule findings.

One row per file/document in, native column expressions out: every
per-document measure is a projection (``regexp_count``, ``split`` and
higher-order functions on the row), so computing them needs no shuffle.
Findings are produced by a narrow ``posexplode`` of each text's lines;
whole texts are always processed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import lexer as lx
from weft.functions import rules as R
from weft.functions.scalar import language_of, line_count

MAX_FILE_BYTES = 100 * 1024 * 1024
NONBLANK = "[^ \\t\\r]"
NONBLANK_LINE = "[^ \\t\\r\\n][^\\n]*+"  # from a line's first visible character to its end


def read_corpus(spark, path: str, max_bytes: int = MAX_FILE_BYTES, recursive: bool = False,
                name_filter: str | None = None) -> DataFrame:
    """S1 + S3: one row per file (whole text), with path, language and size
    from the file metadata. ``path`` is a folder or glob; ``recursive``
    walks a whole tree, ``name_filter`` (e.g. ``*.py``) keeps matching file
    names. The size filter is on ``_metadata.file_size``, so files over the
    limit are pruned at listing time, before content is read."""
    r = spark.read.format("text").option("wholetext", "true")
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    if name_filter:
        r = r.option("pathGlobFilter", name_filter)
    df = r.load(path).where(F.col("_metadata.file_size") <= max_bytes)
    return df.select(F.col("_metadata.file_path").alias("path"),
                     language_of(F.col("_metadata.file_name")).alias("language"),
                     F.col("value").alias("content"),
                     F.col("_metadata.file_size").alias("size"))


def filter_oversized(df: DataFrame, text: str = "text", max_bytes: int = MAX_FILE_BYTES
                     ) -> DataFrame:
    """S3 on an already loaded table: keep texts of at most ``max_bytes``."""
    return df.where(F.octet_length(text) <= max_bytes)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def may_match(text: Column, rule: str, pattern: str) -> Column:
    """Superset test on a whole text: one of the rule's literals occurs
    (substring search) and then the multiline form of the pattern matches.
    ``And`` short-circuits, so most texts never reach the regex."""
    guard = None
    for lit_ in R.RULE_GUARDS[rule]:
        g = text.contains(lit_)
        guard = g if guard is None else guard | g
    return guard & text.rlike(R.jvm(R.any_line_pattern([pattern])))


def rule_hits(text: Column, rule: str, pattern: str) -> Column:
    """Number of non-comment lines of ``text`` matching ``pattern``; only a
    text that may match (few do) is split into lines."""
    per_line = F.size(F.filter(_lines(text), lambda l: ~l.rlike(R.jvm(R.COMMENT_LINE))
                               & l.rlike(R.jvm(pattern))))
    return F.when(may_match(text, rule, pattern), per_line).otherwise(F.lit(0))


def definitions(code: Column, word: str, pattern: str) -> Column:
    """Matches of ``pattern`` in code that has its word at all."""
    return F.when(code.contains(word), F.regexp_count(code, F.lit(R.jvm(pattern)))).otherwise(0)


def long_param_defs(code: Column) -> Column:
    """Function signatures with at least LONG_PARAMETER_LIST parameters."""
    params = F.regexp_extract_all(code, F.lit(R.DEF_PARAMS_PATTERN), 1)
    long_ = F.size(F.filter(params, lambda p: F.size(F.split(p, ",", -1)) >= R.LONG_PARAMETER_LIST))
    return F.when(code.contains("def"), long_).otherwise(0)


def code_metrics(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 carry=()) -> DataFrame:
    """One row of measures per document. ``carry``
    columns (e.g. language, source, path) pass through the same projection,
    so reports never join the measures back to the document table. The lexer
    reads each text twice (:mod:`weft.functions.lexer`): once for its code, once
    for the code's tokens, which give complexity, numbers and nesting."""
    docs = docs.select("*", lx.code_of(F.col(text)).alias("__code"))
    docs = docs.select("*", lx.tokens(F.col("__code")).alias("__tokens"))
    t, code, toks = F.col(text), F.col("__code"), F.col("__tokens")
    by_cat = {cat: rule_hits(t, rule, pat) for rule, cat, _, pat in R.SOURCE_RULES}
    measures = {
        "lines_of_code": line_count(t),
        "nonblank_lines": F.regexp_count(t, F.lit(NONBLANK_LINE)),
        "function_count": definitions(code, "def", R.DEF_PATTERN),
        "class_count": definitions(code, "class", R.CLASS_PATTERN),
        "complexity": lx.keyword_count(toks) + 1,
        "secret_findings": by_cat["secret"],
        "sql_findings": by_cat["sql"],
        "command_findings": by_cat["command"],
        "max_depth": lx.nesting(toks),
        "magic_numbers": lx.number_count(toks),
        "long_param_defs": long_param_defs(code),
    }
    base = docs.select(F.col(key).alias(key), *[F.col(c) for c in carry],
                       *[v.cast("bigint").alias(k) for k, v in measures.items()])
    return base.select("*", *_derived())


def _derived() -> list[Column]:
    c = F.col
    security = c("secret_findings") + c("sql_findings") + c("command_findings")
    deep = (c("max_depth") >= R.DEEP_NESTING_LEVEL).cast("int")
    magic = (c("magic_numbers") > 0).cast("int")
    smells = deep + c("long_param_defs") + magic
    w = R.WEIGHT_HALVES
    cx = F.when(c("complexity") > 20, w["complexity_over_20"]).when(
        c("complexity") > 10, w["complexity_over_10"]).otherwise(0)
    halves = (w["secret"] * c("secret_findings") + w["sql"] * c("sql_findings")
              + w["command"] * c("command_findings") + cx + w["smell"] * smells)
    # per SIZE_UNIT lines, in whole tenths of a point; a shorter text counts as one unit
    size = F.greatest(c("lines_of_code").cast("bigint"), F.lit(R.SIZE_UNIT).cast("bigint"))
    lost = F.floor((halves * (5 * R.SIZE_UNIT)).cast("double") / size).cast("bigint")
    score = (F.greatest(F.lit(0).cast("bigint"), F.lit(100) - lost).cast("double") / 10).cast("decimal(4,1)")
    rating = None
    for lo, name in R.RATING_BANDS:
        cond = score >= lo
        rating = F.when(cond, name) if rating is None else rating.when(cond, name)
    rating = rating.otherwise(R.RATING_FLOOR)
    flags = {"secret": c("secret_findings") > 0, "sql": c("sql_findings") > 0,
             "command": c("command_findings") > 0, "complexity": c("complexity") > 10,
             "nesting": deep == 1, "params": c("long_param_defs") > 0, "magic": magic == 1}
    recs = F.concat_ws("; ", *[F.when(flags[k], F.lit(txt)) for k, txt in R.RECOMMENDATIONS])
    return [security.alias("security_issues"), smells.alias("smells"),
            (security + smells).alias("issues_found"), score.alias("quality_score"),
            rating.alias("rating"), recs.alias("recommendations")]


def security_findings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per (document, line, rule) that matches. The fixed
    rule set compiles to one ``when`` per rule on each exploded line (no
    join with a rule table)."""
    maybe = None
    for rule, _, _, pat in R.SOURCE_RULES:
        m = may_match(F.col(text), rule, pat)
        maybe = m if maybe is None else maybe | m
    lines = (docs.where(maybe)
             .select(F.col(key), F.posexplode(_lines(F.col(text))).alias("pos", "line"))
             .where(~F.col("line").rlike(R.jvm(R.COMMENT_LINE))))
    hits = F.filter(F.array(*[F.when(F.col("line").rlike(R.jvm(p)), F.struct(
        F.lit(r).alias("rule"), F.lit(cat).alias("category"), F.lit(sev).alias("severity")))
        for r, cat, sev, p in R.SOURCE_RULES]), lambda h: h.isNotNull())
    return (lines.select(key, (F.col("pos") + 1).alias("line_no"), F.explode(hits).alias("h"))
            .select(key, "line_no", "h.rule", "h.category", "h.severity"))


def markup_findings(pages: DataFrame, key: str = "page_id", text: str = "html") -> DataFrame:
    """J9 on raw markup: per page and rule, the number of matches (only
    rules that match)."""
    counts = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(sev).alias("severity"),
                                F.regexp_count(F.col(text), F.lit(p)).alias("matches"))
                       for r, sev, p in R.MARKUP_RULES])
    return (pages.select(key, F.explode(counts).alias("h"))
            .select(key, "h.rule", "h.severity", "h.matches")
            .where(F.col("matches") > 0))


def import_statements(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """C11: one row per imported name: (key, statement, item, level, module, name,
    alias). ``import a.b as c, d`` has the modules a.b and d and no names;
    ``from ..p import x as y, z`` has level 2, module p and the names x and z
    (level 0: absolute; an empty module: the package itself). Statements in
    strings and comments are none."""
    code = lx.code_of(F.col(text))
    found = F.when(F.contains(F.col(text), F.lit("import")), F.regexp_extract_all(code, F.lit(R.jvm(lx.IMPORT_STATEMENT)), 0))
    st = docs.select(key, F.posexplode(found).alias("statement", "s"))
    st = st.withColumn("s", F.regexp_replace("s", r"^[; \t\n]+", ""))
    is_from = F.col("s").startswith("from")
    origin = F.regexp_replace(F.regexp_extract("s", r"^from([A-Za-z0-9_. \t]*?)import[ \t(]", 1), r"[ \t]", "")
    listed = F.regexp_replace(F.regexp_replace("s", r"^(from[A-Za-z0-9_. \t]*?[ \t.])?import", ""), r"[()\\\n\r]", " ")
    st = st.select(key, "statement", is_from.alias("is_from"), origin.alias("origin"), F.posexplode(F.split(listed, ",")).alias("item", "i"))
    first = F.regexp_extract("i", r"^[ \t]*([A-Za-z0-9_.*]+)", 1)
    alias = F.regexp_extract("i", r"[ \t]as[ \t]+([A-Za-z0-9_]+)", 1)
    dots = F.regexp_extract("origin", r"^[.]*", 0)
    return st.where(first != "").select(
        key, F.col("statement").cast("long").alias("statement"), F.col("item").cast("long").alias("item"), F.length(dots).cast("long").alias("level"),
        F.when(F.col("is_from"), F.substr("origin", F.length(dots) + 1)).otherwise(first).alias("module"),
        F.when(F.col("is_from"), first).alias("name"), F.nullif(alias, F.lit("")).alias("alias"))


def imports_used(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """C11: modules imported per document, relative ones with their dots: one row
    per module of an ``import`` and per ``from`` statement."""
    return import_statements(docs, key, text).where(F.col("name").isNull() | (F.col("item") == 0)).select(
        key, F.concat(F.repeat(F.lit("."), F.col("level").cast("int")), "module").alias("module"))


def import_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """C11 over the corpus: documents and statements per module."""
    return imports_used(docs, key, text).groupBy("module").agg(
        F.count_distinct(key).alias("documents"), F.count(F.lit(1)).alias("statements"))


def corpus_rollup(metrics: DataFrame, dims=("lang", "source")) -> DataFrame:
    """Measures rolled up by language then source (subtotals and a
    grand total; ``level`` is the grouping id)."""
    return metrics.rollup(*dims).agg(
        F.grouping_id(*dims).alias("level"),
        F.count(F.lit(1)).alias("documents"),
        F.sum("lines_of_code").alias("lines_of_code"),
        F.sum("function_count").alias("function_count"),
        F.sum("class_count").alias("class_count"),
        F.sum("security_issues").alias("security_issues"),
        F.sum("issues_found").alias("issues_found"))


def worst_files(metrics: DataFrame, k: int = 10, key: str = "doc_id") -> DataFrame:
    """K4: the ``k`` lowest scores (most issues first on ties, then id)."""
    return (metrics.orderBy(F.col("quality_score").asc(), F.col("issues_found").desc(),
                            F.col(key).asc()).limit(k)
            .select(key, "quality_score", "issues_found", "rating"))
