import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import docs as D  # noqa: E402

from weft.llm import op7_language as language, op8_toxicity as toxicity  # noqa: E402

PARTS = {"en": "the ing tion and er ea sh th on", "fr": "que eux é la ment ou ai tion le", "de": "ung sch ein ß der ü keit en ch"}


def text(r, lang, n):
    p = PARTS[lang].split()
    return " ".join("".join(r.choice(p) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_language_on_held_out_texts(spark):
    r = random.Random(1)
    rows = [(i, text(r, la, r.choice([6, 40, 200])), la, "s") for i, la in enumerate(r.choices(list(PARTS), k=500))]
    odd = [(900, None, "en", None), (901, "", "en", None), (902, "12 .. 34", "fr", None), (903, text(r, "de", 40_000), None, None), (None, text(r, "fr", 50), None, None)]
    docs = D.frame(spark, rows + odd)
    model = language.train(docs.where(~language.held_out(docs["doc_id"])))
    assert model["langs"] == sorted(PARTS) and model["temperature"] > 0
    got = {x["doc_id"]: x for x in language.predict(docs, model).collect()}
    held = {x["doc_id"] for x in docs.where(language.held_out(docs["doc_id"])).collect()} & set(range(500))
    right = [got[i]["lang_pred"] == rows[i][2] for i in held]
    assert len(right) > 80 and np.mean(right) > 0.97
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "de", "fr"]
    assert all(0 <= x["score"] <= 1 for x in got.values())


def test_language_without_labels(spark):
    docs = D.frame(spark, [(1, "abc", None, None)])
    assert language.train(docs) is None and language.train(D.empty(spark)) is None
    assert [tuple(x) for x in language.predict(docs, None).collect()] == [(1, "und", 0.0)]
    assert language.predict(D.empty(spark), None).count() == 0


def test_ftrl_leaves_useless_features_at_zero_and_temperature_calibrates():
    r = np.random.default_rng(0)
    rows = []
    for i in range(600):
        y = i % 2
        rows.append((np.array([y, 2 + r.integers(50), language.DIM]), np.array([1.0, 0.02, 0.1]), y if r.random() < 0.9 else 1 - y))
    w = language.fit_ftrl(rows, 2, l1=0.5)
    assert (w[2:52] == 0).mean() > 0.9 and w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0]
    z = r.normal(size=(4000, 2)) * 3
    p = 1 / (1 + np.exp(-(z[:, 1] - z[:, 0]) / 2))
    assert language.fit_temperature(z, (r.random(4000) < p).astype(int)) == pytest.approx(2.0, rel=0.15)


def test_ftrl_and_tfidf_equal_plain_loops():
    r = random.Random(6)
    rows = []
    for _ in range(40):
        idx = np.array(sorted(r.sample(range(30), 5)))
        rows.append((np.append(idx, language.DIM), np.append(np.array([r.random() for _ in idx]), 0.1), r.randrange(3)))
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.02
    z, n = {}, {}

    def weight(k):
        zi, ni = z.get(k, 0.0), n.get(k, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - np.sign(zi) * l1) / ((beta + ni ** 0.5) / alpha + l2)

    for epoch in range(2):
        for at in np.random.default_rng(epoch).permutation(len(rows)):
            idx, x, y = rows[at]
            w = {(i, c): weight((i, c)) for i in idx.tolist() for c in range(3)}
            s = [sum(v * w[i, c] for i, v in zip(idx.tolist(), x)) for c in range(3)]
            e = [np.exp(v - max(s)) for v in s]
            for i, v in zip(idx.tolist(), x):
                for c in range(3):
                    g = v * (e[c] / sum(e) - (c == y))
                    n0 = n.get((i, c), 0.0)
                    z[i, c] = z.get((i, c), 0.0) + g - ((n0 + g * g) ** 0.5 - n0 ** 0.5) / alpha * w[i, c]
                    n[i, c] = n0 + g * g
    got = language.fit_ftrl(rows, 3, epochs=2)
    assert all(got[i, c] == pytest.approx(weight((i, c)), abs=1e-9) for i, c in z) and np.count_nonzero(got) <= len(z)
    idf = np.array([0.5, 1.0, 2.0])
    want = [(1 + np.log(3)) * 0.5, (1 + np.log(1)) * 2.0]
    length = sum(v * v for v in want) ** 0.5
    assert language.tfidf(np.array([0, 2]), np.array([3, 1]), idf).tolist() == pytest.approx([v / length for v in want])
    grams = language.CharGrams()
    (idx, count), = grams.features(np.frombuffer(b"aab", np.uint8), np.array([0, 3]))
    assert sorted(count.tolist()) == [1, 1, 1, 1, 2]  # a twice, b, aa, ab, aab


def test_samples_are_bounded_in_bytes(spark):
    r = random.Random(9)
    rows = [(i, text(r, la, 300 if i % 10 else 4000), la, None) for i, la in enumerate(r.choices(list(PARTS), k=300))]
    docs = D.frame(spark, rows)
    seen = []
    real = language.fit_ftrl
    try:
        language.fit_ftrl = lambda fit, n: seen.append(len(fit)) or real(fit, n)
        few = language.train(docs, sample_bytes=60_000)
        all_ = language.train(docs)
    finally:
        language.fit_ftrl = real
    assert 0 < seen[0] < 60 and seen[1] > 200 and few["langs"] == all_["langs"]
    assert few["idf"].tolist() == all_["idf"].tolist()  # statistics cover all rows either way


def test_risk_gradient_equals_differences():
    """One step of the fit goes down the class-prior-corrected risk, by its numeric gradient."""
    r = np.random.default_rng(5)
    pos = [np.unique(np.append(r.integers(10, 60, 8), [1, 2, 3])).astype(np.uint32) for _ in range(30)]
    unl = [np.unique(r.integers(10, 60, 8)).astype(np.uint32) for _ in range(50)]
    prior = 0.3
    names, w, b = toxicity.fit_nnpu(pos, unl, prior, steps=1, l1=0.0)
    assert len(names)

    def risk(w, b):
        sig = lambda x: 1 / (1 + np.exp(-x))
        f = lambda d: b + w[np.isin(names, d)].sum()
        p, u = np.array([f(d) for d in pos]), np.array([f(d) for d in unl])
        negative = sig(u).mean() - prior * sig(p).mean()
        assert negative > 0
        return prior * sig(-p).mean() + negative

    zero, eps = np.zeros(len(names)), 1e-5
    for i in range(len(names)):  # Adam's first step is the rate against the gradient's sign
        e = zero.copy()
        e[i] = eps
        g = (risk(e, -1.0) - risk(-e, -1.0)) / (2 * eps)
        assert w[i] == pytest.approx(-0.05 * g / (abs(g) + 1e-6), rel=1e-2)
    g = (risk(zero, -1.0 + eps) - risk(zero, -1.0 - eps)) / (2 * eps)
    assert b + 1.0 == pytest.approx(-0.05 * g / (abs(g) + 1e-6), rel=1e-2)


BAD = ["vilewordly", "nastyish", "rottenest", "awfuller", "vilewording", "nastyful", "vilewordance"]


def toxic_rows(r, n):
    out = []
    for i in range(n):
        w = D.prose(r, 80).split(" ")
        bad = r.random() < 0.2
        if bad:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(BAD) + r.choice(["", ".", ","])
        out.append((i, " ".join(w), int(bad)))
    return out


def test_toxicity_from_positives_and_unlabelled_text(spark):
    r = random.Random(3)
    made = toxic_rows(r, 1200)
    rows = [(i, t, None, None) for i, t, _ in made] + [(5000, None, None, None), (5001, "", None, None), (5002, "a quite vilewordable thing " + D.prose(r, 30), None, None)]
    docs = D.frame(spark, rows)
    known = spark.createDataFrame([(i, y, 1) for i, _, y in made if i % 2 == 0] + [(4, 0, 1), (None, 1, 1), (6, None, None)], "doc_id long, toxic int, text int")
    seen = ~toxicity.held_out(docs["doc_id"])
    model = toxicity.train(docs.where(seen), known.where(~toxicity.held_out(known["doc_id"])))
    got = {x["doc_id"]: x["score"] for x in toxicity.score(docs, model).collect()}
    held = {x["doc_id"] for x in docs.where(~seen).collect()}
    bad, good = [got[i] for i, _, y in made if y and i in held], [got[i] for i, _, y in made if not y and i in held]
    assert np.mean(np.array(bad) >= 0.5) > 0.95 and np.mean(np.array(good) >= 0.5) < 0.02
    assert got[5000] == got[5001] < 0.5 <= got[5002]
    assert all(0 <= x <= 1 for x in got.values())


def test_toxicity_without_labels(spark):
    docs = D.frame(spark, [(1, "abc", None, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(docs, none) is None
    assert [tuple(x) for x in toxicity.score(docs, None).collect()] == [(1, 0.0)]
    assert toxicity.score(D.empty(spark), None).count() == 0


def test_negative_risk_stays_above_zero():
    r = np.random.default_rng(2)
    pos = [np.unique(np.append(r.integers(10, 500, 20), 1)).astype(np.uint32) for _ in range(60)]
    unl = [np.unique(np.append(r.integers(10, 500, 20), [1] if i < 40 else [])).astype(np.uint32) for i in range(200)]
    names, w, b = toxicity.fit_nnpu(pos, unl, 0.2)
    f = lambda d: b + w[np.isin(names, d)].sum()
    assert all(f(d) > 0 for d in pos) and np.mean([f(d) > 0 for d in unl[:40]]) == 1 and np.mean([f(d) > 0 for d in unl[40:]]) < 0.05
