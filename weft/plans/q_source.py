"""Catalog entries over source files derived from ``part``: measures, findings,
imports, module graph."""

from pyspark.sql import functions as F

from weft.functions import rules as R
from weft.operators import corpus as cp
from weft.operators import modules as md
from weft.plans.catalog import query
from weft.plans.q_corpus import LINES, METRICS_SQL, RULE_VALUES, import_counts_sql, imports_sql, lit
from weft.sources.codebase import SRC_SQL, source_files
from weft.sources.tabular import written

SOURCE_METRICS_SQL = f"{SRC_SQL},\n" + METRICS_SQL.replace("FROM documents", "FROM src")


def _src(m):
    """The derived files, written once like any corpus."""
    return written(source_files(m.raw("part")), "sources")


@query("source_metrics", f"WITH {SOURCE_METRICS_SQL} SELECT * FROM metrics")
def q_source_metrics(m):
    """A14 / C1-C3, C7-C10 over source files."""
    return cp.code_metrics(_src(m))


@query("source_findings", f"""
WITH {SRC_SQL},
lines AS (SELECT doc_id, generate_subscripts({LINES}, 1) AS line_no, unnest({LINES}) AS line FROM src)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, r.rule, r.category, r.severity
FROM lines, (VALUES {RULE_VALUES}) r(rule, category, severity, pattern)
WHERE NOT regexp_matches(line, {lit(R.COMMENT_LINE)}) AND regexp_matches(line, r.pattern)""")
def q_source_findings(m):
    """C4-C6 over source files."""
    return cp.security_findings(_src(m))


@query("source_import_counts", f"WITH {SRC_SQL}, {import_counts_sql('src', 'doc_id')}")
def q_source_import_counts(m):
    """C11: several modules in one statement, relative and bracketed imports."""
    return cp.import_counts(_src(m))


@query("source_imports", f"WITH {SRC_SQL}, {imports_sql('src', 'doc_id')} SELECT * FROM imports")
def q_source_imports(m):
    """C11: every imported name with its level, module and alias."""
    return cp.import_statements(_src(m))


EDGES_SQL = f"""{SRC_SQL}, {imports_sql('src', 'doc_id')},
origins AS (
  SELECT doc_id, statement, item, s.module AS src, name,
         concat_ws('.', CASE WHEN level > 0 THEN array_to_string(string_split(s.package, '.')[1:len(string_split(s.package, '.')) - (level - 1)], '.') END,
                   nullif(i.module, '')) AS origin
  FROM imports i JOIN src s USING (doc_id)),
edges AS (
  SELECT DISTINCT src, dst FROM (
    SELECT o.src, coalesce(own.module, m.module) AS dst FROM origins o
    LEFT JOIN src own ON own.module = o.origin || '.' || o.name LEFT JOIN src m ON m.module = o.origin)
  WHERE dst IS NOT NULL AND src <> dst)"""


def _edges(src):
    """The statements are written, so that the texts are read once."""
    return md.module_edges(written(cp.import_statements(src), "imports"), src)


@query("module_edges", f"WITH {EDGES_SQL} SELECT * FROM edges")
def q_module_edges(m):
    """C11: who imports whom, relative imports resolved."""
    return _edges(_src(m))


@query("import_cycles", f"""WITH RECURSIVE {EDGES_SQL},
reach(a, b) AS (SELECT src, dst FROM edges UNION SELECT a, dst FROM reach JOIN edges ON b = src),
mutual AS (SELECT x.a, x.b FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a UNION SELECT module, module FROM src)
SELECT a AS module, min(b) AS component, count(*) AS members FROM mutual GROUP BY a""")
def q_import_cycles(m):
    """C11: strongly connected components of the module graph."""
    src = _src(m)
    return md.import_cycles(_edges(src), src)


@query("module_dependents", f"""WITH RECURSIVE {EDGES_SQL},
asked AS (SELECT module FROM src WHERE regexp_matches(module, '00[.]m0$')),
reach(module, dst) AS (SELECT module, module FROM asked UNION SELECT module, src FROM reach JOIN edges USING (dst))
SELECT module, count(*) AS dependents FROM reach WHERE module <> dst GROUP BY module""")
def q_module_dependents(m):
    """C11: how many modules depend, directly or not, on the first module of
    each hundredth package."""
    src = _src(m)
    asked = src.where(F.col("module").rlike("00[.]m0$")).select("module")
    return md.dependents(_edges(src), asked).groupBy("module").agg(F.count("*").alias("dependents"))
