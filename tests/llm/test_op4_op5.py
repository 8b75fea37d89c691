import math
import os
import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import docs as D  # noqa: E402

from weft.llm import op4_packing as packing, op5_string_tiling as tiling  # noqa: E402

BPE = public_tokenizers.path("byte_bpe_50k.json")


def lengths(kind, n, seed):
    r = random.Random(seed)
    draw = {"uniform": lambda: r.randint(1, 64), "small": lambda: r.randint(1, 12), "large": lambda: r.randint(20, 44), "one": lambda: 1, "half": lambda: 32}[kind]
    return [draw() for _ in range(n)]


def histogram(items):
    return {x: items.count(x) for x in set(items)}


@pytest.mark.parametrize("kind", ["uniform", "small", "large", "one", "half"])
@pytest.mark.parametrize("n", [0, 1, 2, 37, 400])
def test_plans_use_every_item_once_and_few_sequences(kind, n):
    items = lengths(kind, n, n)
    plan = packing.solve(histogram(items), 64)
    used = {}
    for pattern, times in plan:
        assert sum(s * c for s, c in pattern) <= 64 and times > 0
        for s, c in pattern:
            used[s] = used.get(s, 0) + c * times
    assert used == histogram(items)
    bound = math.ceil(sum(items) / 64)
    assert bound <= sum(t for _, t in plan) <= bound * 1.25 + 1


def best(items, capacity):
    """Least number of bins, by trying all assignments."""
    items = sorted(items, reverse=True)
    least = [len(items)]

    def go(i, bins):
        if len(bins) >= least[0]:
            return
        if i == len(items):
            least[0] = len(bins)
            return
        for b in {x: j for j, x in enumerate(bins)}.values():
            if bins[b] + items[i] <= capacity:
                go(i + 1, bins[:b] + [bins[b] + items[i]] + bins[b + 1:])
        go(i + 1, bins + [items[i]])

    go(0, [])
    return least[0]


@pytest.mark.parametrize("seed", range(25))
def test_fixed_sets_never_cost_a_sequence(seed):
    r = random.Random(seed)
    items = [r.randint(1, 20) for _ in range(9)]
    h = packing.Histogram(histogram(items), 20)
    fixed = packing.reduce_instance(h, 20)
    rest = [s for s, c in enumerate(h.n) for _ in range(c)]
    assert sum(t for _, t in fixed) + best(rest, 20) == best(items, 20)


def test_pieces_and_places(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    rows = D.rows()
    got = packing.pack(D.frame(spark, rows), BPE, capacity=256).toPandas()
    for i, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        own = got[got.doc_id == i].sort_values("piece")
        assert own.piece.tolist() == list(range(-(-len(ids) // 256)))
        assert own.length.tolist()[1:] == [256] * (len(own) - 1) and own.length.sum() == len(ids)
        for p in own.itertuples():
            assert zlib.crc32(np.array(ids[p.start:p.start + p.length], "<u4").tobytes()) == p.ids_crc32
    g = got.sort_values(["sequence_id", "offset"])
    assert ((g.groupby("sequence_id").length.cumsum() - g.length) == g.offset).all()
    assert g.groupby("sequence_id").length.sum().max() <= 256
    assert g.sequence_id.nunique() <= math.ceil(got.length.sum() / 256) * 1.1 + 1


def test_many_equal_pieces_get_different_places(spark):
    rows = [(i % 50, "same", None, None) for i in range(500)] + [(None, None, None, None)]
    pieces = packing.cut_pieces(D.frame(spark, rows), BPE, capacity=8)
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    got = packing.assign(pieces, packing.solve(counts, 8), "", per_bucket=7).toPandas()
    assert len(got) == 501 and not got[["sequence_id", "offset"]].duplicated().any()
    assert packing.pack(D.empty(spark), BPE).count() == 0


# --- op5 ---------------------------------------------------------------------------

def plain_tiles(p, t, k):
    """Greedy string tiling by looking at every pair of places."""
    mp, mt, out = [False] * len(p), [False] * len(t), []
    while True:
        top, pick = k - 1, None
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and not mp[i + n] and not mt[j + n]:
                    n += 1
                if n > top:
                    top, pick = n, (i, j)
        if pick is None:
            return out
        i, j = pick
        out.append((i, j, top))
        mp[i:i + top] = [True] * top
        mt[j:j + top] = [True] * top


def bare(text):
    import re

    return [w for w in (re.sub(r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$", "", x) for x in D.words(text, lower=True)) if w]


def leak_rows(seed):
    r = random.Random(seed)
    items = [(i, D.prose(r, r.choice([4, 8, 20, 40]), 60)) for i in range(8)] + [(20, None), (21, ""), (22, "same same same same same same")]
    docs = D.rows(seed)
    n = 1000
    for i, t in items[:8]:
        w = t.split(" ")
        parts = [w[x:x + 7] for x in range(0, len(w), 7)]
        r.shuffle(parts)
        mixed = " filler ".join(" ".join(x) for x in parts)
        for text in (f"before {t.upper()} after", "x " * 30 + mixed, " ".join(w[:len(w) // 2])):
            docs.append((n, text, None, None))
            n += 1
    return docs + [(n, "same " * 500, None, None), (n, "same " * 500, None, None)], items


@pytest.mark.parametrize("seed", [1, 2])
def test_leaks_match_plain_tiling(spark, seed):
    docs, items = leak_rows(seed)
    docs = [d for d in docs if len(D.words(d[1])) < 700]
    table = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id long")
    want = set()
    for i, t, *_ in docs:
        p = bare(t)
        for j, x in items:
            q = bare(x)
            if len(q) >= 5:
                n = sum(z for *_, z in plain_tiles(p, q, 5))
                if n >= 0.6 * len(q):
                    want.add((i, j, n))
    for block in (1 << 20, 150):
        got = tiling.leaked(D.frame(spark, docs), table, coverage=0.6, block_bytes=block).collect()
        assert {(r["doc_id"], r["item_id"], r["covered_words"]) for r in got} == want
    left = tiling.decontaminate(D.frame(spark, docs), table, coverage=0.6)
    assert left.columns == D.empty(spark).columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, *_ in docs if i not in {w[0] for w in want})


def test_long_repetitive_texts_are_taken_in_parts(monkeypatch):
    monkeypatch.setattr(tiling, "HITS", 500)
    r = random.Random(4)
    item = " ".join(r.choice("abc") for _ in range(30))
    text = " ".join(r.choice("abc") for _ in range(400)) + " " + item + " tail"
    block = tiling.Block([(1, item)], 5)
    h, at = tiling.Words().tokens(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    (d, t, tiles), = block.leaks(h, at, block.table(), 0.8)
    assert sorted(tiles) == sorted(plain_tiles(bare(text), bare(item), 5))


def test_plan_and_passes_do_not_grow_with_the_benchmark(spark, monkeypatch):
    docs = D.frame(spark, D.rows())

    def plan(n):
        items = spark.createDataFrame([(i, f"item {i} has these words and w{i} more of them") for i in range(n)], "item_id long, text string")
        return tiling.decontaminate(docs, items, block_bytes=200)._jdf.queryExecution().optimizedPlan().toString()

    few, many = plan(3), plan(300)
    assert few.count("MapInArrow") == many.count("MapInArrow") == 1 and abs(len(few) - len(many)) < 50
    items = [(i, f"item {i} has these words and w{i} more of them") for i in range(100)] + [(None, "an item without any number of its own at all")]
    texts = [(1, items[70][1], None, None), (2, "clean words here", None, None), (3, items[3][1] + " " + items[-1][1], None, None)]
    got = tiling.leaked(D.frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"), coverage=0.9, block_bytes=100).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 70), (3, 3), (3, None)}


def test_no_benchmark_and_no_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    docs = D.frame(spark, D.rows())
    assert tiling.leaked(docs, none).count() == 0 and tiling.decontaminate(docs, none).count() == docs.count()
    assert tiling.leaked(D.empty(spark), some).count() == 0
