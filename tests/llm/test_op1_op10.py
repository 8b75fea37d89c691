import collections
import math
import os
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import docs as D  # noqa: E402

from weft.llm import op1_kneser_ney as lm, op10_token_store as store, scratch  # noqa: E402

BPE = public_tokenizers.path("byte_bpe_50k.json")


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def plain_scores(rows):
    """The same formulas with dictionaries of strings."""
    t = {i: D.words(x, lower=True) + ["\0end"] for i, x, *_ in rows}
    train = [i for i in t if not held(i)]
    c = collections.Counter(w for i in train for w in t[i])
    n, v = sum(c.values()), len(c)
    pair = collections.Counter(p for i in train for p in zip(["\0end"] + t[i], t[i]))
    cont, total, kinds = collections.Counter(b for _, b in pair), collections.Counter(), collections.defaultdict(lambda: [0, 0, 0])
    for (a, _), k in pair.items():
        total[a] += k
        kinds[a][min(k, 3) - 1] += 1
    of = lambda x: [collections.Counter(x.values())[i] for i in (1, 2, 3, 4)]
    d, e = lm.discounts(of(pair)), lm.discounts(of(cont))
    off = lambda k, z: z[min(k, 3) - 1] if k else 0
    rest = sum(off(k, e) for k in cont.values()) / len(pair)
    out = {}
    for i, ws in t.items():
        base = score = 0.0
        for a, w in zip(["\0end"] + ws, ws):
            base += math.log10((c[w] + 1) / (n + v + 1))
            p = max(cont[w] - off(cont[w], e), 0) / len(pair) + rest / (v + 1)
            if total[a]:
                k = pair[a, w]
                p = max(k - off(k, d), 0) / total[a] + sum(x * y for x, y in zip(kinds[a], d)) / total[a] * p
            score += math.log10(p)
        out[i] = (len(ws), sum(c[w] > 0 for w in ws), n, base, score)
    return out


def test_scores_match_a_plain_model(spark):
    rows = D.rows()
    docs = D.frame(spark, rows)
    model = lm.train(docs.where(~lm.held_out(docs["doc_id"])), scratch.new_folder(spark, "t"))
    got = {r["doc_id"]: r for r in lm.score(docs, model).collect()}
    want = plain_scores(rows)
    assert set(got) == set(want)
    for i, (n, known, total, base, score) in want.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], model["N"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(score, rel=1e-6)


def test_probabilities_of_a_context_sum_to_one(spark):
    rows = [(i, "a b a c b a d", None, None) for i in range(3)] + [(9, "b c d e a", None, None)]
    model = lm.train(D.frame(spark, rows), scratch.new_folder(spark, "t"))
    m = lm.Model(model)
    h = lm.WordHasher(lower=True)
    enc = lambda t: lm.token_hashes(h, np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))
    first = lambda t: m.score(*enc(t))["score"][0]
    # p(w | a) for every known word, the end and one unknown word
    pre = "a "
    total = 0.0
    for w in ("a", "b", "c", "d", "e", "zzz"):
        with_w, rest = enc(pre + w)[0], enc(w)[0]
        total += 10 ** (m.score(with_w[:2], np.array([0, 2]))["score"][0] - m.score(with_w[:1], np.array([0, 1]))["score"][0])
        assert len(rest) == 2
    total += 10 ** (first("a") - m.score(enc("a")[0][:1], np.array([0, 1]))["score"][0])
    assert total == pytest.approx(1.0, abs=1e-5)


def test_model_of_nothing(spark):
    model = lm.train(D.empty(spark), scratch.new_folder(spark, "t"))
    got = lm.score(D.frame(spark, [(1, "a b", None, None), (None, None, None, None)]), model).collect()
    assert [(r["n_tokens"], r["n_known"], r["score"], r["base_score"]) for r in got] == [(3, 0, 0.0, 0.0), (1, 0, 0.0, 0.0)]
    assert lm.score(D.empty(spark), model).count() == 0


def test_blocks_survive_packing_and_hot_tasks():
    c = lm.Counts(3, mixed=True)
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 62, 5000, dtype=np.uint64) // np.uint64(7)
    old, lm.FLUSH = lm.FLUSH, 1500
    try:
        sent = [x for i in range(0, 5000, 500) for x in c.add(np.repeat(keys[i:i + 500], 2))] + list(c.send())
    finally:
        lm.FLUSH = old
    back = collections.Counter()
    for _, block in sent:
        k, n = lm.unpack(block)
        back.update(dict(zip(k.tolist(), n.tolist())))
    assert back == collections.Counter(np.repeat(keys, 2).tolist())


# --- op10 ----------------------------------------------------------------------

def plain_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("seed", [5, 6])
def test_store_round_trip(spark, seed):
    rows = D.rows(seed) + [(500, "a.b,c ,d e  f\n\n g  <|endoftext|> it's we'll  ", None, None), (501, "　 x", None, None)]
    folder = scratch.new_folder(spark, "t")
    manifest = store.write_store(D.frame(spark, rows), BPE, folder, shards=3)
    got = {r["key"]: r for r in store.scan_store(manifest, folder).collect()}
    at = 0
    for i, t, *_ in sorted(rows):
        ids = plain_ids(t)
        r = got[i]
        assert (r["start"], r["n_ids"], r["ids_crc32"], r["indexed"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True), i
        at += len(ids)
    keys = spark.createDataFrame([(1,), (500,), (12345,), (45,)], "doc_id long")
    found = {r["key"]: r for r in store.lookup(keys, manifest, folder).collect()}
    assert found[12345]["found"] is False and found[12345]["ids"] is None
    assert all(found[i]["ids"] == plain_ids(dict((a, b) for a, b, *_ in rows)[i]) for i in (1, 45, 500))


def test_store_with_null_and_repeated_keys(spark):
    rows = [(None, "x y", None, None), (3, "b", None, None), (3, "a", None, None), (3, "a", None, None), (1, None, None, None)]
    folder = scratch.new_folder(spark, "t")
    manifest = store.write_store(D.frame(spark, rows), BPE, folder, shards=2)
    got = sorted(((r["key"] is not None, r["key"] or 0, r["start"], r["n_ids"]) for r in store.scan_store(manifest, folder).collect()))
    n = [len(plain_ids(t)) for t in ("x y", None, "a", "a", "b")]
    assert [x[3] for x in got] == n
    assert [x[2] for x in got] == [sum(n[:i]) for i in range(5)]
    found = store.lookup(spark.createDataFrame([(3,)], "doc_id long"), manifest, folder).collect()
    assert found[0]["ids"] == plain_ids("a")


@pytest.mark.parametrize("what", ["disp", "fp", "first"])
def test_a_damaged_index_is_noticed(spark, what):
    folder = scratch.new_folder(spark, "t")
    manifest = store.write_store(D.frame(spark, D.rows()), BPE, folder, shards=2)
    m = manifest.orderBy("shard").first().asDict()
    n, b = m["n_keys"], m["n_buckets"]
    at, size = {"first": (0, 8 * n), "disp": (8 * n, 4 * b), "fp": (8 * n + 4 * b, 4 * n)}[what]
    fs, path = scratch.locate(f"{folder}/{m['stem']}.mph")
    with open(path, "r+b") as f:
        f.seek(at)
        f.write(b"\x07" * size)
    with pytest.raises(Exception, match="doesn't lead to key"):
        store.scan_store(manifest, folder).collect()


def test_lookup_over_many_shards(spark):
    rows = [(i * 3 - 50, f"text {i}", None, None) for i in range(200)] + [(None, "none", None, None)]
    folder = scratch.new_folder(spark, "t")
    manifest = store.write_store(D.frame(spark, rows), BPE, folder, shards=7)
    want = [-51, -50, -49, 0, 1, 547, 548, 10 ** 12, None, -50]
    got = {r["key"]: r["ids"] for r in store.lookup(spark.createDataFrame([(k,) for k in want], "doc_id long"), manifest, folder).collect()}
    texts = {i: t for i, t, *_ in rows if i is not None}
    assert got == {k: plain_ids(texts[k]) if k in texts else None for k in set(want)}
    every = store.lookup(spark.createDataFrame([(k,) for k in texts], "doc_id long"), manifest, folder).collect()
    assert all(r["ids"] == plain_ids(texts[r["key"]]) for r in every) and len(every) == 200


def test_empty_store(spark):
    folder = scratch.new_folder(spark, "t")
    manifest = store.write_store(D.empty(spark), BPE, folder)
    assert store.scan_store(manifest, folder).count() == 0
    assert [r["found"] for r in store.lookup(spark.createDataFrame([(3,)], "doc_id long"), manifest, folder).collect()] == [False]


@pytest.mark.parametrize("n", [1, 2, 5, 1000, 20_000])
def test_perfect_hash_is_minimal(n):
    keys = np.random.default_rng(n).choice(1 << 40, n, replace=False).astype(np.uint64)
    disp, slot = store.build_mph(keys)
    assert sorted(slot) == list(range(n))
    assert (store.find_slots(keys, disp, n) == slot).all()
