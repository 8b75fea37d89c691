"""Corpus measures on our own short samples (one line per rule, near misses)."""

import os

from conftest import rows
from weft.operators import corpus as cp
from weft.operators import reports as rp

SAMPLE = """import os
from sys import path
API_TOKEN = "abc123secretvalue"
class Store:
    def run(self, cmd):
        return os.system(cmd)
    def query(self, cur, name):
        cur.execute("SELECT * FROM t WHERE n = '%s'" % name)
    def wide(self, a, b, c, d, e, f):
        if a and b:
            for x in c:
                while d:
                    if e or f:
                        return 42
"""
NEAR_MISS = """token_count = 3
password = input()
# os.system is mentioned in a comment
evaluate(x)
cur.execute("SELECT 1", params)
"""


def _docs(spark):
    return spark.createDataFrame([(1, SAMPLE), (2, NEAR_MISS), (3, ""), (4, "one line")],
                                 "doc_id long, text string")


def test_metrics_on_sample(spark):
    m = {r["doc_id"]: r for r in cp.code_metrics(_docs(spark)).collect()}
    s = m[1]
    assert s["lines_of_code"] == 15 and s["function_count"] == 3 and s["class_count"] == 1
    assert (s["secret_findings"], s["sql_findings"], s["command_findings"]) == (1, 1, 1)
    assert s["max_depth"] == 6 and s["long_param_defs"] == 1 and s["magic_numbers"] == 1
    # if, and, for, while, if, or
    assert s["complexity"] == 7
    assert s["issues_found"] == 3 + 3
    # 10 - (3 findings x 2.0 + 3 smells x 0.5)
    assert float(s["quality_score"]) == 2.5 and s["rating"] == "Poor"
    assert s["recommendations"].startswith("Move hard-coded secrets")
    n = m[2]
    assert (n["secret_findings"], n["sql_findings"], n["command_findings"]) == (0, 0, 0)
    assert m[3]["lines_of_code"] == 1 and m[3]["nonblank_lines"] == 0
    assert m[4]["lines_of_code"] == 1 and float(m[4]["quality_score"]) == 10.0


def test_line_findings(spark):
    got = rows(cp.security_findings(_docs(spark)), "doc_id", "line_no", "rule")
    assert got == [(1, 3, "hardcoded_secret"), (1, 6, "command_injection"), (1, 8, "sql_injection")]


def test_imports(spark):
    got = rows(cp.import_counts(_docs(spark)), "module", "documents")
    assert got == [("os", 1), ("sys", 1)]


def test_markup_rules(spark):
    pages = spark.createDataFrame([(1, '<a href="javascript:x()" onclick="y()">z</a><script>eval(1)</script>')],
                                  "page_id long, html string")
    got = rows(cp.markup_findings(pages), "rule", "matches")
    assert got == [("eval_call", 1), ("event_handler_attribute", 1), ("inline_script", 1),
                   ("javascript_url", 1)]


def test_read_corpus_whole_files_and_size_filter(spark, tmpdir_path):
    for name, body in [("a.py", SAMPLE), ("b.py", "x = 1\n"), ("big.py", "y" * 5000)]:
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.write(body)
    df = cp.read_corpus(spark, tmpdir_path + "/*.py", max_bytes=4096)
    got = {os.path.basename(r["path"]): (r["size"], r["language"]) for r in df.collect()}
    assert got == {"a.py": (len(SAMPLE), "Python"), "b.py": (6, "Python")}
    text = df.where(df.path.endswith("a.py")).collect()[0]["content"]
    assert text == SAMPLE


def _silent(docs):
    raise ValueError


def test_reports(spark):
    met = cp.code_metrics(_docs(spark)).withColumn("path", __import__("pyspark.sql.functions").sql.functions.lit("f.py"))
    rep = dict(rows(rp.text_report(met), "doc_id", "report"))
    assert rep[1].splitlines()[2] == "File: f.py"
    assert "- Security Issues: 3" in rep[1] and "- Move hard-coded secrets out of the source" in rep[1]
    run = rp.combine_analyzers(_docs(spark), {
        "ok": lambda d: d.selectExpr("doc_id", "'fine' AS detail"),
        "broken": lambda d: d.select("doc_id", "no_such_column"),
        "late": lambda d: d.selectExpr("doc_id", "raise_error('line one\\nline two ' || repeat('x', 300)) AS detail"),
        "silent": _silent})
    st = rows(run.groupBy("analyzer", "status").count(), "analyzer", "status", "count")
    assert st == [("broken", "error", 4), ("late", "error", 4), ("ok", "ok", 4), ("silent", "error", 4)]
    assert "line two " + "x" * 300 in run.where("analyzer = 'late'").collect()[0]["error"]
    assert rows(rp.analyzers_run(run), "analyzers")[0] == ("ok",)


def test_keywords_in_comments_and_strings_do_not_count(spark):
    text = ('x = "if and or while"  # for if else\n'
            "y = 'for' if a else b\n"
            "# while while while\n"
            "elif_ = orbit + android\n")
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    m = cp.code_metrics(df).collect()[0]
    # only the bare `if` on line 2 counts (identifiers containing keywords do not)
    assert m["complexity"] == 2


def test_file_tree_rollup_by_language_and_dir(spark, tmpdir_path):
    import pyspark.sql.functions as F
    os.makedirs(os.path.join(tmpdir_path, "pkg", "sub"))
    files = {"pkg/a.py": SAMPLE, "pkg/sub/b.py": "x = 1\n", "pkg/sub/c.go": "package main\n"}
    for name, body in files.items():
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.write(body)
    corpus = cp.read_corpus(spark, tmpdir_path + "/pkg", recursive=True)
    corpus = corpus.withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]+$", 1))
    met = cp.code_metrics(corpus, key="path", text="content", carry=("language", "dir"))
    roll = cp.corpus_rollup(met, dims=("language", "dir"))
    total = roll.where(F.col("level") == 3).collect()[0]
    assert total["documents"] == 3 and total["lines_of_code"] == 15 + 2 + 2
    by_lang = {r["language"]: r["documents"] for r in roll.where(F.col("level") == 1).collect()}
    assert by_lang == {"Python": 2, "Go": 1}
