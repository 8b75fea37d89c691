import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import docs
from weft.llm import op12_line_dedup as lines, op13_fill_in_middle as fim
from weft.llm.wavelet import WaveletMatrix

SPACES = " \t\n\x0b\x0c\r"


# --- line dedup --------------------------------------------------------------

def line_rows(seed=3):
    r = random.Random(seed)
    shared = [f"  Shared line number {i} of this page \t" for i in range(12)] + ["short", "", "  ", "É" * 20, "é" * 20, "x" * 19, "y" * 20]
    rows = []
    for i in range(60):
        own = [f"own line {r.random()} of document {i}" for _ in range(r.randrange(4))]
        text = own + [r.choice([str.upper, str.lower, str.strip, str])(r.choice(shared)) for _ in range(r.randrange(8))]
        r.shuffle(text)
        rows.append((i + 1, "\n".join(text), "en", r.choice(["a", None])))
    rows += [(70, None, None, None), (71, "", None, None), (72, "\n\n", None, None), (None, "Shared line number 1 of this page", None, None),
             rows[3], rows[3], (5, "Shared line number 2 of this page\nanother text of document five", None, "b")]
    return rows + [(80, "\n".join(f"Shared line number {i % 20} of this page" for i in range(20_000)), None, None)]


def plain_lines(rows, min_chars=20, min_docs=3):
    """(doc_id, n_lines, n_dropped, kept) by dictionaries."""
    low = {c: c + 32 for c in range(65, 91)}

    def key(line):
        return line.strip(SPACES).translate(low)

    held = {}
    for d, t, *_ in rows:
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(d)
    out = []
    for d, t, *_ in rows:
        all_ = (t or "").split("\n")
        keep = []
        for x in all_:
            h = held[key(x)]
            often = len(key(x)) >= min_chars and len(h) >= min_docs
            if not often or d == max(h - {None}):
                keep.append(x)
        out.append((d, len(all_), len(all_) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


@pytest.mark.parametrize("heavy", [lines.HEAVY, 1, 10 ** 9])
def test_lines_equal_dictionaries_whichever_way_they_join(spark, monkeypatch, heavy):
    monkeypatch.setattr(lines, "HEAVY", heavy)
    rows = line_rows()
    out = lines._kept(docs.frame(spark, rows), 20, 3).select("_row.doc_id", "n_lines", "n_dropped", "kept").collect()
    assert sorted((tuple(r) for r in out), key=str) == plain_lines(rows)
    assert any(r["n_dropped"] for r in out)


def test_dedup_keeps_columns_and_takes_empty_tables(spark):
    rows = line_rows()
    table = docs.frame(spark, rows).withColumn("drop", F.lit(1)).withColumn("_row", F.lit("r")).withColumn("lines", F.lit(2)).withColumn("r1", F.lit(3))
    out = lines.dedup(table)
    assert out.columns == table.columns and out.schema["text"].dataType == table.schema["text"].dataType
    assert sorted(r["text"] for r in out.collect()) == sorted(x[3] for x in plain_lines(rows))
    assert lines.dedup(docs.empty(spark)).count() == 0
    assert {r["_row"] for r in out.collect()} == {"r"}


def test_other_limits(spark):
    rows = line_rows(9)
    out = lines._kept(docs.frame(spark, rows), 5, 10).select("_row.doc_id", "n_lines", "n_dropped", "kept").collect()
    assert sorted((tuple(r) for r in out), key=str) == plain_lines(rows, 5, 10)


# --- fill in the middle ----------------------------------------------------------

@pytest.mark.parametrize("width", [1, 2, 3])
def test_wavelet_matrix_counts(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 63, 64, 65, 1000):
        codes = rng.integers(0, 1 << width, n).astype(np.uint8)
        m = WaveletMatrix(codes, width)
        a, b = np.sort(rng.integers(0, n + 1, (2, 50)), axis=0)
        for c in range(1 << width):
            assert m.count(c, a, b).tolist() == [(codes[x:y] == c).sum() for x, y in zip(a, b)]


def plain_fim(doc_id, text, rate=90, spm=20):
    t = text or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    s = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(s[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= rate:
        return doc_id, len(u), "plain", None, None, t
    p, m, z = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    return doc_id, len(u), form, len(p), len(m), f"<S>{z}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{z}<M>{m}"


def fim_rows():
    r = random.Random(4)
    alphabet = ["a", "Z", "word", "é", "漢", "🙂", " ", "\n", "<", ">", "<P", "P>", "1", "_"]
    rows = docs.rows() + [(1000 + i, "".join(r.choice(alphabet) for _ in range(r.randrange(40))), None, None) for i in range(300)]
    rows += [(2000 + i, x, None, None) for i, x in enumerate(["<P>", "a<S>b", "<M>", "<Q>", "<", "a", "é", "\x00a", "zz" * 50_000, "- " * 60_000])]
    return rows + [(None, "no number here", None, None), (None, None, None, None), rows[7], rows[7]]


def test_cuts_equal_plain_units_and_read_back(spark):
    rows = fim_rows()
    made = fim.fill_in_middle(docs.frame(spark, rows).withColumn("h1", F.lit("x")).withColumn("output", F.lit(0)))
    out = made.withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in out), key=str) == sorted((plain_fim(d, t) for d, t, *_ in rows), key=str)
    assert sorted(r["again"] for r in out) == sorted(t or "" for _, t, *_ in rows)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.empty(spark)).count() == 0


def test_rates_are_parameters(spark):
    rows = fim_rows()
    out = fim.fill_in_middle(docs.frame(spark, rows), rate=100, spm=100).collect()
    assert sorted((tuple(r) for r in out), key=str) == sorted((plain_fim(d, t, 100, 100) for d, t, *_ in rows), key=str)
    assert {r["form"] for r in out} == {"plain", "spm"}
