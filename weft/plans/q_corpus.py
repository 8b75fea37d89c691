"""Catalog entries: corpus metrics and rule findings over ``documents`` and
``pages``. The SQL side spells each measure with RE2 functions."""

from pyspark.sql import functions as F

from weft.functions import lexer as lx
from weft.functions import rules as R
from weft.operators import corpus as cp
from weft.operators import rulescan as rs
from weft.plans.catalog import query


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


CODE_SQL = f"regexp_replace(text, {lit(lx.NO_CODE_RE2)}, '{lx.KEPT_RE2}', 'g')"
LINES = "string_split(text, chr(10))"


def count_sql(pattern: str, col: str = "text") -> str:
    return f"len(regexp_extract_all({col}, {lit(pattern)}))"


def hits_sql(pattern: str) -> str:
    return (f"len(list_filter({LINES}, lambda l: NOT regexp_matches(l, {lit(R.COMMENT_LINE)}) "
            f"AND regexp_matches(l, {lit(pattern)})))")


KW = ", ".join(lit(k) for k in R.DECISION_KEYWORDS)
CAT = {cat: pat for _, cat, _, pat in R.SOURCE_RULES}
BASE_SQL = f"""base AS (
  SELECT doc_id,
    CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS lines_of_code,
    CAST(len(list_filter({LINES}, lambda l: regexp_matches(l, {lit(cp.NONBLANK)}))) AS BIGINT) AS nonblank_lines,
    CAST({count_sql(R.DEF_PATTERN, 'code')} AS BIGINT) AS function_count,
    CAST({count_sql(R.CLASS_PATTERN, 'code')} AS BIGINT) AS class_count,
    CAST(len(list_filter(regexp_extract_all(code, '[A-Za-z0-9_]+'), lambda w: w IN ({KW}))) + 1 AS BIGINT) AS complexity,
    CAST({hits_sql(CAT['secret'])} AS BIGINT) AS secret_findings,
    CAST({hits_sql(CAT['sql'])} AS BIGINT) AS sql_findings,
    CAST({hits_sql(CAT['command'])} AS BIGINT) AS command_findings,
    CAST(list_reduce(list_prepend({{'o': 0, 'd': 0}}, list_transform(
           regexp_extract_all(code || chr(10), {lit(lx.LAYOUT_RE2)}), lambda t: {{
             'o': CASE WHEN t IN ('(', '[', '{{') THEN 1 WHEN t IN (')', ']', '}}') THEN -1 ELSE 0 END,
             'd': CASE WHEN t[1] = ' ' AND t[-1] = ' ' THEN length(t) // 4 ELSE 0 END}})),
         lambda a, x: {{'o': a.o + x.o, 'd': CASE WHEN a.o <= 0 THEN greatest(a.d, x.d) ELSE a.d END}}).d AS BIGINT) AS max_depth,
    -- runs of name characters that are numbers; one after a point is a fraction
    CAST(len(list_filter(regexp_extract_all(code, '[.]?[A-Za-z0-9_]+'),
         lambda w: regexp_full_match(w, '[0-9][0-9]+'))) AS BIGINT) AS magic_numbers,
    CAST(len(list_filter(regexp_extract_all(code, {lit(R.DEF_PARAMS_PATTERN)}, 1),
         lambda p: len(string_split(p, ',')) >= {R.LONG_PARAMETER_LIST})) AS BIGINT) AS long_param_defs
  FROM (SELECT *, {CODE_SQL} AS code FROM documents))"""

W = R.WEIGHT_HALVES
RECS = ", ".join(
    f"CASE WHEN {cond} THEN {lit(txt)} END" for cond, txt in zip([
        "secret_findings > 0", "sql_findings > 0", "command_findings > 0", "complexity > 10",
        f"max_depth >= {R.DEEP_NESTING_LEVEL}", "long_param_defs > 0", "magic_numbers > 0"],
        [t for _, t in R.RECOMMENDATIONS]))
RATING = "CASE " + " ".join(f"WHEN quality_score >= {lo} THEN {lit(n)}" for lo, n in R.RATING_BANDS) \
    + f" ELSE {lit(R.RATING_FLOOR)} END"
METRICS_SQL = BASE_SQL + f""",
d1 AS (
  SELECT *, secret_findings + sql_findings + command_findings AS security_issues,
         CAST(max_depth >= {R.DEEP_NESTING_LEVEL} AS BIGINT) + long_param_defs
           + CAST(magic_numbers > 0 AS BIGINT) AS smells
  FROM base),
d2 AS (
  SELECT *, security_issues + smells AS issues_found,
         CAST(CAST(greatest(0, 100 - CAST(floor(CAST(500 * ({W['secret']} * secret_findings + {W['sql']} * sql_findings
              + {W['command']} * command_findings
              + CASE WHEN complexity > 20 THEN {W['complexity_over_20']}
                     WHEN complexity > 10 THEN {W['complexity_over_10']} ELSE 0 END
              + {W['smell']} * smells) AS DOUBLE) / greatest(lines_of_code, 100)) AS BIGINT)) AS DOUBLE) / 10 AS DECIMAL(4,1))
           AS quality_score
  FROM d1),
metrics AS (
  SELECT *, {RATING} AS rating, concat_ws('; ', {RECS}) AS recommendations FROM d2)"""


def _metrics(m):
    return cp.code_metrics(m.raw("documents"))


@query("code_metrics", f"WITH {METRICS_SQL} SELECT * FROM metrics")
def q_code_metrics(m):
    """A14 over every document."""
    return _metrics(m)


RULE_VALUES = ", ".join(f"({lit(r)}, {lit(c)}, {lit(s)}, {lit(p)})" for r, c, s, p in R.SOURCE_RULES)


@query("security_findings", f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts({LINES}, 1) AS line_no, unnest({LINES}) AS line FROM documents)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, r.rule, r.category, r.severity
FROM lines, (VALUES {RULE_VALUES}) r(rule, category, severity, pattern)
WHERE NOT regexp_matches(line, {lit(R.COMMENT_LINE)}) AND regexp_matches(line, r.pattern)""")
def q_security_findings(m):
    """C4-C6 / J9 over every line of every document."""
    return cp.security_findings(m.raw("documents"))


MARKUP_VALUES = ", ".join(f"({lit(r)}, {lit(s)}, {lit(p)})" for r, s, p in R.MARKUP_RULES)


@query("markup_findings", f"""
SELECT page_id, rule, severity, matches FROM (
  SELECT page_id, r.rule, r.severity, CAST(len(regexp_extract_all(html, r.pattern)) AS INTEGER) AS matches
  FROM pages, (VALUES {MARKUP_VALUES}) r(rule, severity, pattern)) WHERE matches > 0""")
def q_markup_findings(m):
    """J9 over every page's markup."""
    return cp.markup_findings(m.raw("pages"))


def imports_sql(table: str, key: str) -> str:
    """CTE ``imports``: one row per imported name, as ``import_statements`` gives them."""
    return f"""statements AS (
  SELECT {key}, unnest(range(len(l))) AS statement, regexp_replace(unnest(l), '^[; \\t\\n]+', '') AS s
  FROM (SELECT {key}, regexp_extract_all({CODE_SQL}, {lit(lx.IMPORT_STATEMENT)}) AS l FROM {table})),
listed AS (
  SELECT {key}, statement, starts_with(s, 'from') AS is_from,
         regexp_replace(regexp_extract(s, '^from([A-Za-z0-9_. \\t]*?)import[ \\t(]', 1), '[ \\t]', '', 'g') AS origin,
         string_split(regexp_replace(regexp_replace(s, '^(from[A-Za-z0-9_. \\t]*?[ \\t.])?import', ''), '[()\\\\\\n\\r]', ' ', 'g'), ',') AS l
  FROM statements),
items AS (
  SELECT {key}, statement, is_from, origin, length(regexp_extract(origin, '^[.]*')) AS level, unnest(range(len(l))) AS item, unnest(l) AS i FROM listed),
imports AS (
  SELECT {key}, statement, item, level, CASE WHEN is_from THEN origin[level + 1:] ELSE first END AS module,
         CASE WHEN is_from THEN first END AS name, nullif(regexp_extract(i, '[ \\t]as[ \\t]+([A-Za-z0-9_]+)', 1), '') AS alias
  FROM (SELECT *, regexp_extract(i, '^[ \\t]*([A-Za-z0-9_.*]+)', 1) AS first FROM items) WHERE first <> '')"""


def import_counts_sql(table: str, key: str) -> str:
    return f"""{imports_sql(table, key)}
SELECT repeat('.', level) || module AS module, count(DISTINCT {key}) AS documents, count(*) AS statements
FROM imports WHERE name IS NULL OR item = 0 GROUP BY 1"""


@query("import_counts", f"WITH {import_counts_sql('documents', 'doc_id')}")
def q_import_counts(m):
    return cp.import_counts(m.raw("documents"))


#: A benchmark item's first three words, whatever stands between them, as a rule of its own.
BENCHMARK_WORDS = "regexp_extract_all(text, '[A-Za-z]+')"


@query("rule_table_findings", f"""
WITH rules AS (
  SELECT 'item ' || item_id AS rule, '(?i)' || w[1] || '[^A-Za-z]+' || w[2] || '[^A-Za-z]+' || w[3] AS pattern
  FROM (SELECT item_id, {BENCHMARK_WORDS} AS w FROM benchmark) WHERE len(w) >= 3),
lines AS (SELECT doc_id, generate_subscripts({LINES}, 1) AS line_no, unnest({LINES}) AS line FROM documents)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, rule FROM lines JOIN rules ON regexp_matches(line, pattern)""")
def q_rule_table_findings(m):
    """J9 with a rule table: one rule per benchmark item, over every line of every document."""
    w = m.raw("benchmark").select("item_id", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0).alias("w")).where(F.size("w") >= 3)
    rules = w.select(F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("rule"),
                     F.concat(F.lit("(?i)"), F.array_join(F.slice("w", 1, 3), "[^A-Za-z]+")).alias("pattern"))
    return rs.rule_scan(m.raw("documents"), rules)


@query("corpus_rollup", f"""WITH {METRICS_SQL}
SELECT d.lang, d.source, CAST(GROUPING(d.lang, d.source) AS BIGINT) AS level, count(*) AS documents,
       CAST(sum(lines_of_code) AS BIGINT) AS lines_of_code, CAST(sum(function_count) AS BIGINT) AS function_count,
       CAST(sum(class_count) AS BIGINT) AS class_count, CAST(sum(security_issues) AS BIGINT) AS security_issues,
       CAST(sum(issues_found) AS BIGINT) AS issues_found
FROM metrics JOIN documents d USING (doc_id) GROUP BY ROLLUP (d.lang, d.source)""")
def q_corpus_rollup(m):
    met = cp.code_metrics(m.raw("documents"), carry=("lang", "source"))
    return cp.corpus_rollup(met)


@query("worst_files", f"""WITH {METRICS_SQL}
SELECT doc_id, quality_score, issues_found, rating FROM metrics
ORDER BY quality_score, issues_found DESC, doc_id LIMIT 10""")
def q_worst_files(m):
    return cp.worst_files(_metrics(m), 10)


@query("filter_oversized", """
SELECT doc_id, n_chars FROM documents WHERE strlen(text) <= 104857600""")
def q_filter_oversized(m):
    return cp.filter_oversized(m.raw("documents")).select("doc_id", "n_chars")
