import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import op11_prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, seg long, keys string, n long"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows, head=lambda c: 0, donor=lambda c: c):
    """The trie by dictionaries."""
    own = {}
    for c, n, r, t in rows:
        if c is not None:
            own.setdefault(c, []).append((n is not None, n, r or "", t or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v, key=lambda x: (x[0], x[1] or 0))] for c, v in own.items()}
    built = {c: tuple(own.get(donor(c), [])[:head(c)] + v[head(c):]) for c, v in own.items()}
    members = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        below = children.get(p, [])
        leaves[p] = sum(leaves[q] for q in below) if below else 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[q] for q in below)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(c, n, r, t, 1, "k", 2) for c, n, r, t in rows], SCHEMA)


def got(df):
    return sorted((tuple(r[c] for c in NODE) for r in df.collect()), key=str)


def talks(seed, convs=120, longest=9):
    """Conversations that share beginnings of different lengths; some copies, some long."""
    r = random.Random(seed)
    pool = [[(r.choice(["user", "assistant", None]), r.choice(["a b", "c", "", None, "d  e\tf", "é 漢字"])) for _ in range(longest)] for _ in range(6)]
    rows = []
    for c in range(convs):
        base, keep = r.choice(pool), r.randrange(longest)
        turns = base[:keep] + [(r.choice(["user", "assistant"]), f"t{r.randrange(3)}") for _ in range(r.randrange(4))]
        turns = turns or [("user", "x")]
        rows += [(c, None if i == 0 and c % 7 == 0 else i, *t) for i, t in enumerate(turns)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, segment, shard", [(1, 4096, 1 << 18), (2, 3, 40), (3, 2, 7), (4, 1, 1)])
def test_equals_dictionaries_however_it_is_cut(spark, seed, segment, shard):
    rows = talks(seed)
    assert got(trie.prefix_trie(table(spark, rows), segment=segment, shard=shard)) == plain(rows)


@pytest.mark.parametrize("segment, shard", [(4096, 1 << 18), (2, 11)])
def test_rebuilt_beginnings(spark, segment, shard):
    rows = [x for x in talks(5) if x[0] not in (20, 60)]  # two donors are absent
    c = F.col("conv_id")
    out = trie.prefix_trie(table(spark, rows), F.crc32(c.cast("string").cast("binary")) % 4, c - c % 20, segment=segment, shard=shard)
    assert got(out) == plain(rows, lambda c: zlib.crc32(str(c).encode()) % 4, lambda c: c - c % 20)


def test_one_conversation_holds_most_rows(spark):
    rows = [(8, i, "user", f"w{i % 5} x") for i in range(1500)] + [(9, i, "user", f"w{i % 5} x") for i in range(700)]
    rows += [(10 + i, 0, "user", "w0 x") for i in range(30)] + [(50, i, "user", f"w{i % 5} x") for i in range(700)]
    assert got(trie.prefix_trie(table(spark, rows), segment=64, shard=300)) == plain(rows)


def test_awkward_rows(spark):
    rows = [(1, 0, None, None), (2, 0, "", ""), (3, None, "user", "a"), (3, 0, "user", "a"), (4, 1, "user", "a"), (4, 1, "user", "a"),
            (None, 0, "user", "nobody"), (-3, 5, "user", "a"), (7, 0, "user a", "b"), (8, 0, "user", "a b"), (9, 0, "user", "w " * 200_000)]
    assert got(trie.prefix_trie(table(spark, rows))) == plain(rows)
    assert trie.prefix_trie(table(spark, [])).count() == 0
    assert trie.prefix_trie(table(spark, [(None, 0, "user", "x")])).count() == 0
    everything_replaced = [(21, 0, "user", "a"), (22, 0, "user", "b"), (22, 1, "user", "c")]
    out = got(trie.prefix_trie(table(spark, everything_replaced), F.lit(2), F.lit(0).cast("long")))
    assert out == plain(everything_replaced, lambda c: 2, lambda c: 0) and len(out) == 1


def test_slots_are_verified(monkeypatch):
    """Digests whose table keys collide get another seed, not one slot."""
    real, seen = trie.mix, []

    def weak(h):
        seen.append(1)
        return np.zeros_like(h) if len(seen) <= 2 else real(h)

    monkeypatch.setattr(trie, "mix", weak)
    d = [np.array([1, 2, 3, 1], np.uint64), np.array([5, 6, 7, 5], np.uint64)]
    slot = trie.NodeTable._slots(d, np.array([False, False, False, False]))
    assert slot[0] == slot[3] and sorted(set(slot.tolist())) == [0, 1, 2]
    assert len(seen) > 2
