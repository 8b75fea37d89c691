import itertools
import random
import re

import pytest

from weft.llm import op6_chat_repair as chat

SCHEMA = "conv_id long, turn long, role string, text string, part long, last string"


def least(roles):
    """Least cost by trying every relabelling and every set of merges."""
    best = 10 ** 9
    for w in itertools.product(range(3), repeat=len(roles)):
        cost = sum(chat.RELABEL for a, b in zip(w, roles) if a != b)
        for merged in itertools.product((False, True), repeat=len(roles) - 1):
            if any(m and w[i] != w[i + 1] for i, m in enumerate(merged)):
                continue
            seq = [w[0]] + [w[i + 1] for i, m in enumerate(merged) if not m]
            state, inserted = chat.NONE, 0
            for q in seq:
                while state is not None and (state, q) not in chat.FOLLOWS:
                    state = None if q == 0 else {chat.NONE: 1, 0: 1, 1: 2, 2: 1}[state]
                    inserted += 1
                if state is None:
                    break
                state = q
            else:
                best = min(best, cost + sum(merged) * chat.MERGE + (inserted + len(chat.CLOSING[state])) * chat.INSERT)
    return best


def cost_of(roles, turns, made):
    return (chat.MERGE * sum(m["n_merged"] for m in made) + chat.INSERT * sum(m["n_inserted"] for m in made)
            + chat.RELABEL * sum(q != c for (q, *_), c in zip(turns, roles)))


def legal(text):
    roles = re.findall(r"<\|(system|user|assistant)\|>", text)
    ends = text.count("<|end|>\n")
    body = roles[1:] if roles[:1] == ["system"] else roles
    return ends == len(roles) and body == ["user", "assistant"] * (len(body) // 2) and bool(body)


@pytest.mark.parametrize("seed", range(60))
def test_repairs_cost_least_however_parts_are_cut(seed):
    r = random.Random(seed)
    roles = [r.randint(0, 3) for _ in range(r.randint(1, 5))]
    want = least(roles)
    for cut in range(len(roles)):
        parts = [x for x in (roles[:cut], roles[cut:]) if x]
        ends = chat.chain([chat.matrix(x) for x in parts])
        turns = [chat.repair(x, *e) for x, e in zip(parts, ends)]
        out = [chat.render(t, ["t"] * len(t), *e, last=i == len(parts) - 1) for i, (t, e) in enumerate(zip(turns, ends))]
        assert cost_of(roles, sum(turns, []), [m for _, m in out]) == want
        assert legal("".join(t for t, _ in out))


def table(spark, rows):
    return spark.createDataFrame([(c, n, r, t, 3, "x") for c, n, r, t in rows], SCHEMA)


def test_table_of_awkward_conversations(spark):
    rows = [(1, 0, "Human", "hi"), (1, 1, "gpt", "hello"), (1, 2, "user", "a"), (1, 3, "user", "b"), (1, 3, "user", "b"),
            (2, 0, "assistant", "first"), (3, 0, None, None), (3, None, "system", "s"), (None, 0, "user", "x"), (None, 1, "assistant", "y"),
            (4, 0, "user", "u"), (4, 1, "system", "late"), (4, 2, "assistant", "")]
    got = {r["conv_id"]: r for r in chat.repaired(table(spark, rows)).groupBy("conv_id").agg(
        __import__("pyspark").sql.functions.expr("array_join(transform(sort_array(collect_list(struct(part, rendered))), x -> x.rendered), '') as text"),
        __import__("pyspark").sql.functions.sum("n_in").alias("n_in"), __import__("pyspark").sql.functions.sum("cost").alias("cost")).collect()}
    assert all(legal(r["text"]) for r in got.values()) and set(got) == {1, 2, 3, 4, None}
    assert got[1]["n_in"] == 4 and got[1]["cost"] == chat.MERGE + chat.INSERT
    assert got[1]["text"].count("a\nb") == 1
    assert got[2]["text"] == "<|user|>\n<|end|>\n<|assistant|>\nfirst<|end|>\n"
    assert got[None]["text"] == "<|user|>\nx<|end|>\n<|assistant|>\ny<|end|>\n" and got[None]["cost"] == 0
    assert chat.repaired(table(spark, [])).count() == 0


def test_one_very_long_conversation_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART", 50)
    r = random.Random(2)
    rows = [(7, i, r.choice(["user", "assistant", "assistant", "user", "system", "??"]), f"t{i}") for i in range(1000)] + [(8, 0, "user", "x")]
    got = chat.repaired(table(spark, rows)).orderBy("conv_id", "part").collect()
    long = [x for x in got if x["conv_id"] == 7]
    assert len(long) == 20 and sum(x["n_in"] for x in long) == 1000
    text = "".join(x["rendered"] for x in long)
    assert legal(text) and re.findall(r"t\d+", text) == [f"t{i}" for i in range(1000)]
    whole = [min(chat.NAMES.get(x[2], 3), 3) for x in rows[:1000]]
    m = chat.matrix(whole)
    assert sum(x["cost"] for x in long) == min(m[12 + q] + chat.INSERT * len(chat.CLOSING[q]) for q in range(3))


def test_rows_of_different_roles_or_without_numbers_are_all_read(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "human", "a"), (1, 0, "human", "a"), (2, 0, "tool", "x"), (2, 0, "function", "x"),
            (3, None, "user", "a"), (3, None, "user", "a"), (3, None, None, "b"), (3, 1, "user", "c"), (3, 1, "user", "c")]
    got = {r["conv_id"]: r for r in chat.repaired(table(spark, rows)).groupBy("conv_id").agg(
        __import__("pyspark").sql.functions.expr("array_join(transform(sort_array(collect_list(struct(part, rendered))), x -> x.rendered), '') as text"),
        __import__("pyspark").sql.functions.sum("n_in").alias("n_in")).collect()}
    assert {c: r["n_in"] for c, r in got.items()} == {1: 2, 2: 2, 3: 4}
    assert all(legal(r["text"]) for r in got.values())
    assert got[1]["text"].count("a\na") == 1 and got[2]["text"].count("x") == 2 and got[3]["text"].count("\na") == 2
