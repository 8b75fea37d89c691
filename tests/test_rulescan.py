"""Rules as data: literals that must occur, and the scan against plain searches."""

import random
import re
import time

import pytest

from weft.functions.literals import needed
from weft.operators import rulescan as rs


@pytest.mark.parametrize("pattern, want", [
    ("token=[0-9]+", (["token="], False)),
    ("(?i)PassWord", (["password"], True)),
    ("(foo|barbar)[0-9]", (["barbar", "foo"], False)),
    ("(foo|[0-9])x", (["x"], False)),
    ("(abc)+d?", (["abc"], False)),
    ("(abc)?[0-9]*", None),
    ("a.{3}longer", (["longer"], False)),
    ("x(?i:AB)c", (["ab"], True)),
    ("(?:a|b)(?:cd|ef)", (["cd", "ef"], False)),
    ("[0-9]+", None),
    ("", None),
    ("(?=look)ahead", (["ahead"], False)),
    ("(?>atom)s", (["atom"], False)),
])
def test_needed_literals(pattern, want):
    got = needed(pattern)
    assert got == want or (got and want and got[1] == want[1] and set(got[0]) == set(want[0]))


def random_rules(r, n):
    def word():
        return "".join(r.choice("abAB") for _ in range(r.randint(1, 4)))

    out = []
    for i in range(n):
        p = r.choice([lambda: word(), lambda: f"({word()}|{word()})[0-9]?", lambda: f"(?i){word()}", lambda: f"^{word()}.*{word()}$",
                      lambda: "[0-9]{2}", lambda: f"({word()})+x?", lambda: f"\\b{word()}\\b", lambda: f"(?:{word()})?{r.choice('ab')}é"])()
        out.append((f"r{i}", p))
    return out


@pytest.mark.parametrize("seed, block", [(1, 1000), (2, 7)])
def test_equals_every_rule_on_every_line(spark, monkeypatch, seed, block):
    monkeypatch.setattr(rs, "BLOCK", block)
    r = random.Random(seed)
    texts = ["\n".join("".join(r.choice("abAB 0é1İ\t") for _ in range(r.randrange(12))) for _ in range(r.randrange(6))) for _ in range(60)]
    texts += [None, "", "\n\n", "ab" * 50_000]
    rules = random_rules(r, 40)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, rule string")
    table = spark.createDataFrame(rules + rules[:3] + [(None, "a"), ("null", None)], "rule string, pattern string")
    got = sorted(tuple(x) for x in rs.rule_scan(docs, table).collect())
    want = sorted((i, n + 1, name) for i, t in enumerate(texts) if t for n, line in enumerate(t.split("\n"))
                  for name, p in rules if re.search(p, line))
    assert got == want and got


def test_characters_that_fold_to_ascii():
    scanner = rs.Scanner([("a", "(?i)kiss"), ("b", "kiss")])
    assert scanner.hits("x \u212a\u0130\u017fS\nkiss\nK\u0131ss") == [(0, 0), (1, 0), (1, 1), (2, 0)]


def test_empty_tables_and_bad_patterns(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "rule string, pattern string")
    assert rs.rule_scan(docs, none).count() == 0
    assert rs.rule_scan(docs.where("false"), spark.createDataFrame([("r", "a")], "rule string, pattern string")).count() == 0
    with pytest.raises(ValueError, match="rule bad"):
        rs.rule_scan(docs, spark.createDataFrame([("bad", "(a")], "rule string, pattern string"))
    twice = spark.createDataFrame([("r", "a"), ("r", "[a]")], "rule string, pattern string")
    assert rs.rule_scan(docs, twice).count() == 1


def test_a_thousand_rules_cost_little_more_than_ten():
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(3000)]
    texts = [" ".join(r.choice(words) for _ in range(2000)) for _ in range(40)]
    rules = [(f"r{i}", "".join(r.choice("klmnopqr") for _ in range(6)) + "[0-9]+") for i in range(990)] + [(f"s{i}", words[i] + " [ab]") for i in range(10)]

    def seconds(table):
        scanner = rs.Scanner(table)
        t0 = time.perf_counter()
        found = [scanner.hits(t) for t in texts]
        return time.perf_counter() - t0, sum(map(len, found))

    few = [seconds(rules[-10:]) for _ in range(3)]
    many = [seconds(rules) for _ in range(3)]
    assert few[0][1] == many[0][1] > 0
    assert min(t for t, _ in many) < 3 * min(t for t, _ in few)
