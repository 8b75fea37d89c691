"""The lexer against Python's own tokenizer, imports against its parser, and the
module graph against plain searches."""

import ast
import io
import json
import random
import textwrap
import tokenize

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from weft.functions import lexer as lx
from weft.functions import rules as R
from weft.operators import corpus as cp
from weft.operators import modules as md
from weft.sources.codebase import source_files

AWKWARD = '''"""doc: if this and that or else
for while case 'quoted' \\""" still inside if
"""
x = "a \\" if b or c"  # if in a comment "and
y = r'\\' if'
z = \'\'\'one " if
   two\'\'\'
def f(a, b="if, and, or, x, y"):
    """if"""
    t = [1,
            22, 333]
    if a and \\
            b:
        return {"k": (a or
                          b)}
    # if deeper
            # a comment deeper still
    return x1 + 12
class A: pass
'''


def python_measures(text):
    """(keywords, deepest block, defs, classes, whole numbers of two or more digits) by tokenize."""
    kw = depth = deepest = defs = classes = nums = 0
    fstring = 0
    for t in tokenize.generate_tokens(io.StringIO(text).readline):
        name = tokenize.tok_name[t.type]
        if name == "FSTRING_START":
            fstring += 1
        elif name == "FSTRING_END":
            fstring -= 1
        elif fstring:
            continue
        elif name == "INDENT":
            depth += 1
            deepest = max(deepest, depth)
        elif name == "DEDENT":
            depth -= 1
        elif name == "NAME":
            kw += t.string in R.DECISION_KEYWORDS
            defs += t.string == "def"
            classes += t.string == "class"
        elif name == "NUMBER":
            nums += t.string.isdigit() and len(t.string) > 1
    return kw, deepest, defs, classes, nums


def measured(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [(r["complexity"] - 1, r["max_depth"], r["function_count"], r["class_count"], r["magic_numbers"])
            for r in cp.code_metrics(docs).orderBy("doc_id").collect()]


def test_awkward_strings_and_blocks_like_tokenize(spark):
    assert measured(spark, [AWKWARD]) == [python_measures(AWKWARD)]


def test_library_modules_like_tokenize(spark):
    texts = []
    for mod in (json.decoder, json.encoder, json.scanner, textwrap, random):
        with open(mod.__file__) as f:
            texts.append(f.read())
    got, want = measured(spark, texts), [python_measures(t) for t in texts]
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[2:4] for g in got] == [w[2:4] for w in want]


def test_derived_sources_like_tokenize(spark):
    src = source_files(spark.read.parquet(f"{SF_SMALL}/part.parquet")).orderBy("doc_id").limit(60)
    texts = [r["text"] for r in src.collect()]
    assert measured(spark, texts) == [python_measures(t) for t in texts]
    assert len({python_measures(t) for t in texts}) > 3


def test_unfinished_and_odd_texts(spark):
    texts = ['"""never closed if', "it's an apostrophe if", "", "\\", "'a\\", '"' * 7, "#", "((( if\n        x", ")))\n        x", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in cp.code_metrics(docs).collect()}
    assert got[0]["complexity"] == 2 and got[1]["complexity"] == 2 and got[7]["max_depth"] == 0 and got[8]["max_depth"] == 2
    long = "x = '" + "\\'" * 200_000 + "' if y else z\n" + '"""' + "a\"" * 100_000 + '"""'
    assert measured(spark, [long])[0][0] == 1


IMPORTS = """import os, sys as system, a.b.c as d; import json
from . import x
from .. import y as z, w
from .a import (b,
    c as e,)
from ...pkg.mod import *
    import inner.thing
text = "import no"
# import neither
'''
import nor_this
'''
from a.b import c  # import comment
"""


def plain_imports(text):
    out = []
    for node in ast.walk(ast.parse(textwrap.dedent(text.replace("    import inner", "import inner")))):
        if isinstance(node, ast.Import):
            out += [(0, n.name, None, n.asname) for n in node.names]
        elif isinstance(node, ast.ImportFrom):
            out += [(node.level, node.module or "", n.name, n.asname) for n in node.names]
    return sorted(out, key=str)


def test_imports_like_the_parser(spark):
    docs = spark.createDataFrame([(1, IMPORTS), (2, "nothing here"), (3, None)], "doc_id long, text string")
    st = cp.import_statements(docs)
    assert sorted((tuple(r) for r in st.select("level", "module", "name", "alias").collect()), key=str) == plain_imports(IMPORTS)
    used = rows(cp.imports_used(docs), "module")
    assert ("os",) in used and ("...pkg.mod",) in used and (".",) in used and used.count((".a",)) == 1
    src = source_files(spark.read.parquet(f"{SF_SMALL}/part.parquet")).orderBy("doc_id").limit(40)
    for r in src.collect():
        one = cp.import_statements(spark.createDataFrame([(1, r["text"])], "doc_id long, text string"))
        assert sorted((tuple(x) for x in one.select("level", "module", "name", "alias").collect()), key=str) == plain_imports(r["text"])
        if r["doc_id"] > 5:
            break


def test_relative_imports_resolve(spark):
    files = [("p.q.a", "p.q", "from . import b, nothing\nfrom .c import thing\nfrom ..r import d, e\nimport p.q.b, os\nfrom .... import far\nimport p.q.a"),
             ("p.q.b", "p.q", ""), ("p.q.c", "p.q", "from p.q import b as x"), ("p.r.d", "p.r", ""), ("p.r", "p", "")]
    src = spark.createDataFrame([(i, m, p, t) for i, (m, p, t) in enumerate(files)], "doc_id long, module string, package string, text string")
    edges = rows(md.module_edges(cp.import_statements(src), src), "src", "dst")
    assert edges == [("p.q.a", "p.q.b"), ("p.q.a", "p.q.c"), ("p.q.a", "p.r"), ("p.q.a", "p.r.d"), ("p.q.c", "p.q.b")]


def reached(edges, start):
    seen, todo = {start}, [start]
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


@pytest.mark.parametrize("seed", range(3))
def test_cycles_and_dependents_like_plain_searches(spark, seed):
    r = random.Random(seed)
    names = [f"m{i}" for i in range(14)]
    pairs = sorted({(r.choice(names), r.choice(names)) for _ in range(18)} | {("m0", "m1"), ("m1", "m2"), ("m2", "m0")})
    pairs = [p for p in pairs if p[0] != p[1]]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    modules = spark.createDataFrame([(n,) for n in names], "module string")
    reach = {n: reached(pairs, n) for n in names}
    want = []
    for n in names:
        same = sorted(x for x in names if x in reach[n] and n in reach[x])
        want.append((n, same[0], len(same)))
    assert rows(md.import_cycles(edges, modules), "module", "component", "members") == sorted(want)
    asked = modules.where("module in ('m0', 'm5', 'm9')")
    assert rows(md.dependents(edges, asked), "module", "dependent") == sorted(
        (q, n) for q in ("m0", "m5", "m9") for n in names if n != q and q in reach[n])


def test_empty_graph(spark):
    none = spark.createDataFrame([], "src string, dst string")
    modules = spark.createDataFrame([("a",)], "module string")
    assert rows(md.import_cycles(none, modules), "module", "component", "members") == [("a", "a", 1)]
    assert md.import_cycles(none, modules.where("false")).count() == 0
    assert md.dependents(none, modules).count() == 0


def test_patterns_of_both_engines_match_the_same(spark):
    import duckdb
    r = random.Random(3)
    bits = ['"', "'", '"""', "'''", "\\", "#", "\n", " ", "    ", "if", "x", "(", ")", "[", "]", "12", ".", "import a", "from . import b", ";"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(30))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string").select("i", lx.code_of(F.col("text")).alias("c"))
    got = [x["c"] for x in df.orderBy("i").collect()]
    pattern = lx.NO_CODE_RE2.replace("'", "''")
    want = [duckdb.execute(f"SELECT regexp_replace(?, '{pattern}', '{lx.KEPT_RE2}', 'g')", [t]).fetchone()[0] for t in texts]
    assert got == want


def test_the_rounds_carry_numbers(spark, monkeypatch):
    """A cycle, a way out of it and a module alone: only numbers pass the rounds."""
    kinds, plain = [], md.written
    monkeypatch.setattr(md, "written", lambda df, name: kinds.append((name, {t for c, t in df.dtypes if c != "fresh"})) or plain(df, name))
    edges = spark.createDataFrame([("c", "a"), ("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    modules = spark.createDataFrame([(x,) for x in "abcde"] + [(None,)], "module string")
    assert rows(md.import_cycles(edges, modules), "module", "component", "members") == [
        ("a", "a", 3), ("b", "a", 3), ("c", "a", 3), ("d", "d", 1), ("e", "e", 1)]
    reach = [k for name, k in kinds if name == "module-reach"]
    assert reach and all(k == {"bigint"} for k in reach)
