"""Source files derived from ``part``: one module per row.

The testdata holds no source code, so each part becomes a module of a package
of ten (``shop/p<g>/m<i>.py``), whose docstring, imports, nesting, secrets and
calls follow from the part's columns. The text is one SQL expression that both
engines read, so Spark and the oracle see the same files.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = "p_partkey"
PLACE = f"({K} % 10)"
GROUP = f"({K} - {K} % 10)"
#: The package a package imports from: the first of its hundred, of its thousand, or of all.
ABOVE = f"(CASE WHEN {GROUP} % 100 > 0 THEN {GROUP} - {GROUP} % 100 WHEN {GROUP} % 1000 > 0 THEN {GROUP} - {GROUP} % 1000 ELSE 0 END)"

#: (condition, template): lines of a module; ``{...}`` holds SQL.
LINES = [
    ("true", '"""{p_name}: if this and that or else, for while'),
    ("true", "def not_a_function(): import nothing"),
    ("true", "class Neither: '''"),
    ("true", '"""'),
    ("true", "import os, sys as system; import json"),
    (f"{PLACE} > 0", f"from . import (m0 as base,\n    m{{{PLACE} - 1}})"),
    (f"{PLACE} < 9 AND p_size % 2 = 1", f"from .m{{{PLACE} + 1}} import run{{{K} + 1}} as halt, stop"),
    (f"{GROUP} > 0", f"from ..p{{{ABOVE}}} import m0"),
    ("p_size % 3 = 0", f"import shop.p{{{ABOVE}}}.m{{{PLACE}}} as twin, re"),
    ("p_size % 5 = 0", "PASSWORD = '{p_brand} it\\'s \"{p_type}\" if'  # if and or while"),
    ("p_size % 4 = 0", f"def run{{{K}}}(a, b, c={{p_size}}, d=2, e=\"x, y, z\", f=None):"),
    ("p_size % 4 <> 0", f"def run{{{K}}}(a, b, e=\"x, y, z, u, v, w\"):"),
    ("true", "    if a and b:"),
    ("true", "        for x in [a,\n                        b]:"),
    ("true", "            while x:"),
    ("p_size % 2 = 0", "                if a or b:\n                    return x"),
    ("true", "                return {p_size * 7} or \"say \\\"if\\\" and or\""),
    ("p_size % 6 = 0", "    os.system(a)"),
    ("p_size % 7 = 0", "    cursor.execute(\"SELECT * FROM t WHERE n = '%s'\" % a)"),
    ("true", f"class C{{{K}}}:\n    '''nested if'''\n    total = 1 + \\\n        {{p_size}}"),
]


def _sql(template: str) -> str:
    """A template as an SQL concatenation without escapes inside literals."""
    out = []
    for i, piece in enumerate(re.split(r"\{([^}]*)\}", template)):
        if i % 2:
            out.append(f"CAST({piece} AS STRING)")
            continue
        out += [f"chr({ord(x)})" if x in "\n\"'\\" else f"'{x}'" for x in re.split(r"([\n\"'\\])", piece) if x]
    return " || ".join(out)


TEXT = " || ".join(f"CASE WHEN {cond} THEN {_sql(line)} || chr(10) ELSE '' END" for cond, line in LINES)
COLUMNS = {
    "doc_id": K,
    "path": f"{_sql(f'shop/p{{{GROUP}}}/m{{{PLACE}}}.py')}",
    "package": _sql(f"shop.p{{{GROUP}}}"),
    "module": _sql(f"shop.p{{{GROUP}}}.m{{{PLACE}}}"),
    "text": TEXT,
}
SRC_SQL = "src AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in COLUMNS.items()) + " FROM part)"


def source_files(part: DataFrame) -> DataFrame:
    """(doc_id, path, package, module, text)."""
    return part.select(*[F.expr(v).alias(k) for k, v in COLUMNS.items()])
