import collections
import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import docs as D  # noqa: E402

from weft.llm import op9_lsh_forest as forest, scratch  # noqa: E402
from weft.llm.components import components  # noqa: E402


def plain_groups(rows, k, threshold=80):
    """(set size, smallest doc_id reachable) by comparing every pair."""
    sets = {}
    for i, t in rows:
        w = D.words(t, lower=True)
        sets[i] = frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if sets[a] and sets[b]:
                same = len(sets[a] & sets[b])
                if 100 * same >= threshold * (len(sets[a]) + len(sets[b]) - same):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_rows(seed, n=60, size=90):
    """A dense group of near copies of one text, and chains of ever more changed ones."""
    r = random.Random(seed)
    base = D.prose(r, size, 3000).split(" ")
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(size)] = f"n{r.randrange(10 ** 6)}"
        out.append(" ".join(w))
    chain = D.prose(r, size, 3000).split(" ")
    for i in range(12):
        chain[(i * 17) % size] = f"c{i}"
        out.append(" ".join(chain))
    r.shuffle(out)
    return [(1000 + i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("seed,k", [(1, 4), (2, 5)])
def test_groups_match_all_pairs(spark, seed, k):
    rows = [(i, t) for i, t, *_ in D.rows(seed)] + near_rows(seed)
    docs = D.frame(spark, [(i, t, None, None) for i, t in rows])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in forest.near_duplicates(docs, k).collect()}
    assert got == plain_groups(rows, k)


def test_small_regions_and_deep_levels_still_find_a_dense_group(spark, monkeypatch):
    monkeypatch.setattr(forest, "REGION", 3)
    rows = near_rows(9, n=150)
    docs = D.frame(spark, [(i, t, None, None) for i, t in rows])
    got = {r["doc_id"]: r["component_id"] for r in forest.near_duplicates(docs).collect()}
    want = {i: c for i, (_, c) in plain_groups(rows, 4).items()}
    assert got == want


def changed(r, words, n, mark):
    """The words with n of them, far from each other, replaced by new ones."""
    w, step = list(words), len(words) // n
    for j in range(n):
        w[j * step + r.randrange(step - 5)] = f"{mark}v{j}"
    return w


def plain_links(rows, k, threshold=80):
    """The component of each row by all pairs; shingles of one row alone can't be in an intersection."""
    import numpy as np

    sets = {i: {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} for i, w in rows}
    n = collections.Counter(g for s in sets.values() for g in s)
    at = {g: j for j, g in enumerate(g for g in n if n[g] > 1)}
    ids = sorted(sets)
    m = np.zeros((len(ids), len(at)), np.float32)
    for x, i in enumerate(ids):
        m[x, [at[g] for g in sets[i] if g in at]] = 1
    same, size = m @ m.T, np.array([len(sets[i]) for i in ids])
    link = 100 * same >= threshold * (size[:, None] + size[None, :] - same)
    np.fill_diagonal(link, True)
    root = np.arange(len(ids))
    while True:
        new = np.array([root[row].min() for row in link])
        if (new == root).all():
            return {i: ids[root[x]] for x, i in enumerate(ids)}
        root = new


def test_crowd_around_a_hub_and_chains_out_of_it_match_all_pairs(spark):
    r = random.Random(11)
    base = [f"b{i}" for i in range(203)]
    copies = [changed(r, base, 5, f"c{i}") for i in range(3000)]      # 0.81 to the base, less to each other
    tails = [changed(r, copies[i], 4, f"t{i}") for i in range(25)]    # linked to one copy alone
    rows = [base, *copies, *tails]
    r.shuffle(rows)
    rows = [(500 + i, w) for i, w in enumerate(rows)]
    docs = D.frame(spark, [(i, " ".join(w), None, None) for i, w in rows])
    got = {x["doc_id"]: x["component_id"] for x in forest.near_duplicates(docs).collect()}
    want = plain_links(rows, 4)
    assert len(set(want.values())) == 1 and got == want


def test_crowd_without_a_hub_finds_its_few_links(spark):
    r = random.Random(12)
    base = [f"b{i}" for i in range(203)]
    copies = [changed(r, base, 6, f"c{i}") for i in range(300)]       # no two at the threshold
    tails = [changed(r, copies[i], 4, f"t{i}") for i in range(40)]
    rows = [(500 + i, w) for i, w in enumerate(copies + tails)]
    docs = D.frame(spark, [(i, " ".join(w), None, None) for i, w in rows])
    got = {x["doc_id"]: x["component_id"] for x in forest.near_duplicates(docs).collect()}
    want = plain_links(rows, 4)
    assert len(set(want.values())) > 200 and got == want


def test_null_and_repeated_ids_and_empty_table(spark):
    docs = D.frame(spark, [(None, "a b c d e", None, None), (4, "a b c d e", None, None), (4, "a b c d e", None, None), (9, "A B c d e", None, None), (5, None, None, None)])
    got = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in forest.near_duplicates(docs).collect())
    assert got == [(0, None, True), (4, 4, True), (4, 4, True), (5, 5, True), (9, 4, False)]
    left = forest.first_of_groups(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 4, 4, 5]
    assert forest.near_duplicates(D.empty(spark)).count() == 0


def test_a_doc_id_with_several_texts_links_through_each(spark):
    a, b, c = ("a b c d e f g h", "p q r s t u v w", "k l m n o k m l")
    rows = [(5, a), (5, b), (3, a), (7, b), (9, c), (9, a), (11, c), (12, "x y z x z y")]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        docs = D.frame(spark, [(i, t, None, None) for i, t in rows])
        got = {r["doc_id"]: r["component_id"] for r in forest.near_duplicates(docs).collect()}
        assert got == {3: 3, 5: 3, 7: 3, 9: 3, 11: 3, 12: 12}
        assert sorted(r["doc_id"] for r in forest.first_of_groups(docs, k=4).collect()) == [3, 12]


def test_columns_of_any_name_are_kept(spark):
    from pyspark.sql import functions as F

    docs = D.frame(spark, [(1, "a b c d e f", None, None), (2, "a b c d e f", None, None)])
    docs = docs.withColumns({c: F.lit(c) for c in ("_gone", "row", "component_id", "kept", "a", "b", "rep")})
    left = forest.first_of_groups(docs)
    assert left.columns == docs.columns and [(r["doc_id"], r["_gone"], r["row"]) for r in left.collect()] == [(1, "_gone", "row")]


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    r = random.Random(1)
    edges = {"path": [(i, i + 1) for i in range(60)], "star": [(100, i) for i in range(50)],
             "random": [(r.randrange(90), r.randrange(90)) for _ in range(60)], "none": []}[shape]
    r.shuffle(edges)
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long"), scratch.new_folder(spark, "t")).collect()}
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in edges:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {i: v for i, v in root.items() if any(i in e and e[0] != e[1] for e in edges)}


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as pipe
    from weft.llm import op2_pii, op3_quality, op5_string_tiling

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    judged = {r["doc_id"]: r["kept"] for r in op3_quality.judge(docs).collect()}
    for name, stage in pipe.STAGES[:-1]:
        out = scratch.stored(stage(spark, docs, d), scratch.new_folder(spark, "t"))
        assert out.columns == docs.columns, name
        before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (docs, out))
        if name == "quality":
            assert set(after) == {i for i, k in judged.items() if k}
        elif name == "near_duplicates":
            assert set(after) == {i for i, (_, c) in plain_groups(list(before.items()), 5).items() if i == c}
        elif name == "decontamination":
            leaks = op5_string_tiling.leaked(docs, spark.read.parquet(f"{d}/benchmark.parquet")).collect()
            assert leaks and set(after) == set(before) - {r["doc_id"] for r in leaks}
        else:
            spans = {r["doc_id"]: r["all"] for r in op2_pii.find(docs).collect()}
            assert set(after) == set(before) and sum(map(bool, map(len, spans.values()))) > 0
            assert all((after[i] == before[i]) == (not spans[i]) for i in before)
        docs = out
    packed = pipe.packing(spark, docs, d).toPandas()
    assert set(packed.doc_id) == {r["doc_id"] for r in docs.collect()}
    assert collections.Counter(packed.groupby("sequence_id").length.sum() > 1024)[True] == 0


def test_pipeline_keeps_one_of_a_large_group_linked_through_its_original(spark):
    import corpus_pipeline as pipe

    r = random.Random(13)
    base = [f"b{i}" for i in range(100)]
    rows = [base] + [changed(r, base, 2, f"c{i}") for i in range(1000)]
    other = [f"o{i}" for i in range(100)]
    docs = D.frame(spark, [(700 + i, " ".join(w), None, None) for i, w in enumerate([*rows, other])])
    assert len(set(plain_links(list(enumerate(rows)), 5).values())) == 1
    left = pipe.near_duplicates(spark, docs, "/root/testdata/sf0.001")
    assert sorted(x["doc_id"] for x in left.collect()) == [700, 1701]


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_empty_and_odd_tables(spark, stage):
    import corpus_pipeline as pipe

    name, f = pipe.STAGES[stage]
    assert f(spark, D.empty(spark), "/root/testdata/sf0.001").count() == 0
    docs = D.frame(spark, D.rows() + [(None, None, None, None)])
    out = f(spark, docs, "/root/testdata/sf0.001")
    ids, left = {i for i, *_ in D.rows()} | {None}, [r["doc_id"] for r in out.collect()]
    assert left and set(left) <= ids
    if name == "packing":
        assert set(left) == ids
    else:
        assert out.columns == docs.columns and len(left) == len(set(left))
