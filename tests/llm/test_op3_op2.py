import collections
import hashlib
import os
import random
import re
import sys
import unicodedata

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import docs as D  # noqa: E402

from weft.llm import op2_pii as pii, op3_quality as quality  # noqa: E402

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d))) % 10 == 0


def fits(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 10 <= len(d) <= 15


def plain_spans(text):
    return sorted((m.start(), r, m.end(), k) for r, k in enumerate(PLAIN) for m in re.finditer(PLAIN[k], text or "") if fits(k, m.group()))


AWKWARD = [
    "a@b.c%d@e.f x@y me@host.co.uk. q@-.-", "1.2.3.4.5.6.7.8.9 256.1.1.1 0000255.01.2.3 1.2.3", "4111 1111-1111 1111 4111111111111112 12-34  56",
    "+1 (555) 555-0199 +4930 1234567. ++1 234 567 8901 +1-", "é漢字🙂 a@b.cd 🙂 10.0.0.1,4012888888881881;+49 (30) 901820", "@ @. a@b", "", None,
    "9" * 40 + " " + "1 " * 300, "mail:x.y+z@mail.example.org/10.0.0.1:4111111111111111",
    "u0@h.io " * 400, "4111111111111111" * 3,
]


def test_base_spans_match_plain_regular_expressions(spark):
    rows = [(i, t, None, None) for i, t in enumerate(AWKWARD)] + [(100 + i, t, a, b) for i, t, a, b in D.rows()]
    text = {i: t for i, t, *_ in rows}
    got = pii.find(D.frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain_spans(text[r["doc_id"]])
        assert [tuple(x) for x in r["base"]] == want, text[r["doc_id"]][:80]
        n = collections.Counter(k for *_, k in want)
        assert [r[f"n_{k}"] for k in PLAIN] == [n[k] for k in PLAIN]
        assert [tuple(x) for x in r["all"] if x["kind"] != "id"] == want


def test_cue_words_of_seeds_discover_unseen_identifiers(spark):
    rows = [(i, f"the order came. please dial +1 (555) 555-{1000 + i} or write to u{i}@ex.com today, the end", None, None) for i in range(30)]
    rows += [(50 + i, f"the order 77{i}12345 came. please dial 55510{i}77 today, the end", None, None) for i in range(4)]
    got = {r["doc_id"]: r for r in pii.find(D.frame(spark, rows)).collect()}
    for i in range(4):
        text = dict((a, b) for a, b, *_ in rows)[50 + i]
        ids = [text[x["start"]:x["end"]] for x in got[50 + i]["all"]]
        assert ids == [f"55510{i}77"]  # after "dial"; the number after the common word stays


def plain_words(text):
    """Split at the separators, strip what is neither letter, number nor ``_``."""
    inside = lambda c: c == "_" or unicodedata.category(c)[0] in "LN"
    out = []
    for w in re.split(r"""[\x20\x09-\x0D"'=:;,()\[\]{}<>|]""", re.sub("[0-9]", "0", text.lower())):
        at = [i for i, c in enumerate(w) if inside(c)]
        if at:
            out.append(w[at[0]:at[-1] + 1])
    return out


def plain_new_spans(texts):
    """The bootstrapping by dictionaries: {doc_id: sorted spans of kind id}."""
    seen, total = [], collections.Counter()
    for d, t in texts.items():
        w = plain_words(t)
        total.update(w)
        total.update(map(" ".join, zip(w, w[1:])))
        total.update(map(" _ ".join, zip(w, w[2:])))
        base = [(a, b) for a, _, b, _ in plain_spans(t)]
        for kind, pattern in {**PLAIN, "id": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{6,}"}.items():
            every = list(re.finditer(pattern, t))
            for i, m in enumerate(every):
                if not (fits(kind, m.group()) if kind != "id" else all(m.end() <= a or m.start() >= b for a, b in base)):
                    continue
                before = t[every[i - 1].end() if i else 0:m.start()][-64:]
                after = t[m.end():every[i + 1].start() if i + 1 < len(every) else len(t)][:64]
                l, r = plain_words(before), plain_words(after)
                l, r = l[1:] if len(before) == 64 else l, r[:-1] if len(after) == 64 else r
                held = [("L1", l[-1:], 1), ("L2", l[-2:], 2), ("R1", r[:1], 1), ("R2", r[:2], 2)]
                patterns = [(k, " ".join(x)) for k, x, n in held if len(x) == n] + [("LR", f"{x} _ {y}") for x, y in zip(l[-1:], r[:1])]
                key = m.group().lower()
                seed = kind != "id" or (len(key) >= 32 and not set(key) - set("0123456789abcdef") and re.search("[a-f]", key) is not None)
                seen.append((d, m.start(), m.end(), kind, key, seed, patterns))
    edges, seeds = collections.Counter(), collections.defaultdict(set)
    known = collections.defaultdict(float)
    for *_, key, seed, patterns in seen:
        for p in patterns:
            edges[p, key] += 1
            if seed:
                seeds[p].add(key)
        if seed:
            known[key] = 1.0
    sure = {k for k, v in known.items() if v}
    edges = {(p, k): n for (p, k), n in edges.items() if len(seeds[p]) >= pii.MIN_SUPPORT}
    conf = {}
    for _ in range(pii.ROUNDS):
        hits, times = collections.Counter(), collections.Counter()
        for (p, k), n in edges.items():
            hits[p] += n * known[k]
            times[p] += n
        conf = {p: hits[p] / (max(total[p[1]], times[p]) + 1) for p in hits}
        for key in {k for _, k in edges} - sure:
            l, r = (max([conf[p] for p, k in edges if k == key and (p[0][0] == "L") == side], default=0) for side in (True, False))
            known[key] = 1 - (1 - l) * (1 - r)
    out = collections.defaultdict(set)
    for d, a, b, kind, key, _, patterns in seen:
        if kind == "id" and known[key] >= pii.MIN_CONFIDENCE and any(conf.get(p, 0) >= pii.MIN_PATTERN for p in patterns):
            out[d].add((a, b))
    return {d: sorted(v) for d, v in out.items()}


def cued():
    """Cues of common words, of one word, and on both sides; hexadecimal keys; near misses."""
    rng = random.Random(5)
    common = ["my", "number", "is", "the", "call", "at", "to", "été", "don't", "x.y", "-"]
    noise = lambda n: " ".join(rng.choice(common) for _ in range(n))
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(39)) + "a7"
    out = [f"{noise(9)} number, is +1 555 555 {1000 + i}. {noise(9)}" for i in range(40)]
    out += [f"{noise(3)} number is AB-77{i}12 {noise(2)} order 99{i}1234 {noise(5)}" for i in range(6)]
    out += [f"{noise(4)} call u{i}@ex.com now, {noise(4)}" for i in range(12)] + [f"{noise(2)} call 555{i}777 now {noise(2)}" for i in range(3)]
    out += [f'{noise(5)} token = "{key()}" {noise(7)}' for _ in range(9)] + [f"{noise(5)} {key()} {noise(5)}" for _ in range(3)]
    out += ['a token: "s3cr3t-77" of ours', "w" * 70 + " token 123456x", "", "10.0.0.1 " * 12, noise(400)]
    return dict(enumerate(out))


def new_spans(rows):
    return {r["doc_id"]: [(x["start"], x["end"]) for x in r["all"] if x["kind"] == "id"] for r in rows if len(r["all"]) > len(r["base"])}


def test_discovery_matches_plain_bootstrapping(spark):
    texts = cued()
    want = plain_new_spans(texts)
    got = new_spans(pii.find(D.frame(spark, [(i, t, None, None) for i, t in texts.items()])).collect())
    assert got == want
    found = {texts[d][a:b] for d, v in got.items() for a, b in v}
    assert {f"AB-77{i}12" for i in range(6)} <= found  # after "number is", both common words
    assert {f"555{i}777" for i in range(3)} <= found   # between "call" and "now"
    assert "s3cr3t-77" in found and not any(x.startswith("99") for x in found)
    assert sum(len(x) == 41 for x in found) == 9       # hexadecimal keys without a cue stay


def test_discovery_on_a_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert new_spans(pii.find(docs).collect()) == plain_new_spans(texts)


def test_phrases_joined_by_shuffle_count_the_same(spark):
    text = D.frame(spark, [(i, t, None, None) for i, t in cued().items()]).select("text")
    phrases = spark.createDataFrame([("number is",), ("is",), ("my _ is",), ("absent",)], "words string")
    near = sorted(map(tuple, pii.phrase_counts(text, phrases).collect()))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, pii.phrase_counts(text, phrases).collect())) == near
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    words = [plain_words(t) for t in cued().values()]
    assert dict(near) == {"is": sum(w.count("is") for w in words), "number is": sum(x == ("number", "is") for w in words for x in zip(w, w[1:])),
                          "my _ is": sum(x == ("my", "is") for w in words for x in zip(w, w[2:]))}


def test_redaction_keeps_rows_and_columns(spark):
    rows = [(1, "write to a@b.co now", "en", "s"), (2, None, None, None), (2, "x 10.0.0.1 🙂 4111 1111 1111 1111", None, "s"),
            (2, "x 10.0.0.1 🙂 4111 1111 1111 1111", None, "s"), (None, "a@b.co", None, None)]
    docs = D.frame(spark, rows)
    got = pii.redact(docs)
    assert got.columns == docs.columns and got.schema == docs.schema
    texts = sorted((r["text"] or "", r["n_chars"]) for r in got.collect())
    assert texts == sorted([("write to [EMAIL] now", 20), ("", None), ("x [IP] 🙂 [CARD]", 15), ("x [IP] 🙂 [CARD]", 15), ("[EMAIL]", 7)])
    assert pii.find(D.empty(spark)).count() == 0 and pii.redact(D.empty(spark)).count() == 0


def test_plans_are_native(spark):
    for df in (pii.find(D.frame(spark, D.rows())), quality.judge(D.frame(spark, D.rows()))):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# --- op3 -------------------------------------------------------------------------

def plain_base(text):
    w = D.words(text)
    lines = [x for x in (text or "").split("\n") if D.words(x)]
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    n = collections.Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside))


REPEATS = ["a b c d e " * 8, "x # y | z <b> & 50% $5\nx # y | z <b> & 50% $5\n\n \nq", "a " * 30, "a b c d e f g h i j k a b c d e m n o p q r s t u v w x y z aa bb cc dd"]


def test_base_counts(spark):
    rows = [(1000 + i, t, None, None) for i, t in enumerate(REPEATS)] + D.rows()
    text = {i: t for i, t, *_ in rows}
    for r in quality.judge(D.frame(spark, rows)).collect():
        want = plain_base(text[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def boiler():
    """40 distinct texts of one host end in one line; some hold nothing else but a few words."""
    line = "All rights of this page number 7 are reserved by its owner and nobody else."
    out = []
    for i in range(40):
        own = D.prose(__import__("random").Random(i), 60 if i % 2 else 4, 9000).replace("\n", " ")
        out.append((i, own + f"\n  {line.replace('7', str(i))} ", None, "h"))
    out += [(100 + i, "one text that is copied many times over\nand has a second line of words", None, "h") for i in range(60)]
    out += [(200, line, None, "other"), (201, line, None, None)]
    return out


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    rows = boiler()
    got = {r["doc_id"]: r for r in quality.judge(D.frame(spark, rows), max_docs=20).collect()}
    for i in range(40):
        assert got[i]["kept"] == (i == 0 or i % 2 == 1), i   # the first holder keeps its line
        assert (got[i]["removed"] is None) == (i == 0)
    assert all(got[100 + i]["kept"] for i in range(60))      # copies of one text count once
    assert got[200]["kept"] and got[201]["kept"]             # other hosts
    clean = {r["doc_id"]: r for r in quality.clean(D.frame(spark, rows), max_docs=20).collect()}
    joined = {r["doc_id"]: r for r in quality.clean(D.frame(spark, rows), max_docs=20, few_lines=0).collect()}
    assert clean == joined
    assert set(clean) == {i for i, r in got.items() if r["kept"]}
    assert "rights" in clean[0]["text"] and all("rights" not in clean[i]["text"] for i in range(1, 40, 2))
    assert all(clean[i]["n_chars"] == len(clean[i]["text"]) for i in clean)


def test_oracle_agrees_where_lines_are_frequent(spark, monkeypatch):
    rows = boiler() + [(1000 + i, t, a, b) for i, t, a, b in D.rows()]
    con = duckdb.connect()
    table = D.frame(spark, rows).select("doc_id", "text", "source").toPandas()
    con.register("documents", table)
    want = con.sql(quality.ORACLE.replace("> 200", "> 20")).df().sort_values("doc_id").values.tolist()
    got = quality.judge(D.frame(spark, rows), max_docs=20).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left").orderBy("doc_id").collect()
    assert [list(r) for r in got] == want


@pytest.mark.parametrize("limits", [{}, {"max_docs": 0}])
def test_repeated_rows_and_empty_tables(spark, limits):
    rows = [(1, "a b c d e f g h i j k\nx y z", None, "s")] * 3 + [(None, "a b c d e f g h i j k l m", None, None)]
    got = quality.judge(D.frame(spark, rows), **limits).collect()
    assert len(got) == 4 and len({(r["doc_id"], r["kept"], r["words_left"]) for r in got}) == 2
    docs = D.empty(spark)
    assert quality.judge(docs).count() == 0 and quality.clean(docs).columns == docs.columns
