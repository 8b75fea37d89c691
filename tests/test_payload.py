"""Payloads of any shape against Python's own printing and parsing."""

import json
import random

from pyspark.sql import functions as F

from weft.functions import payload as pl
from weft.operators import events as ev


def random_value(r, deep=0):
    kind = r.randrange(8 if deep < 3 else 6)
    if kind == 0:
        return r.choice([None, True, False])
    if kind == 1:
        return r.randrange(-10 ** 6, 10 ** 6)
    if kind == 2:
        return r.randrange(1, 1000) + 0.5
    if kind < 6:
        return "".join(r.choice(["a", "é", "漢", "🙂", "'", '"', "\\", "\n", "\t", "\x01", "\x0c", "/", ":", ",", " ", "null", "{", "]"])
                       for _ in range(r.randrange(6)))
    if kind == 6:
        return [random_value(r, deep + 1) for _ in range(r.randrange(4))]
    return {random_value(r, 9) if r.random() < 0 else r.choice(["a", "b:c", "d'e", 'f"g', "true", "é"]) + str(i): random_value(r, deep + 1)
            for i in range(r.randrange(4))}


def test_printed_like_python_and_written_like_json(spark):
    r = random.Random(8)
    values = [{f"k{i}": random_value(r) for i in range(r.randrange(5))} for _ in range(300)]
    texts = [json.dumps(v, ensure_ascii=r.random() < 0.5, indent=r.choice([None, None, 2])) for v in values]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = df.select("i", pl.python_text(F.col("t")).alias("p"), F.to_json(pl.parsed(F.col("t"))).alias("j")).orderBy("i").collect()
    assert [x["p"] for x in got] == [repr(v) for v in values]
    assert [json.loads(x["j"]) for x in got] == values


def test_log_lines_and_defaults(spark):
    rows = [(1, "x", "a", None, '{"b": 1, "a": {"c": [1, null]}}'), (2, "x", "a", "t", None), (3, "x", "a", None, "not json {"), (4, "y", "b", None, "{}")]
    e = spark.createDataFrame(rows, "seq long, event_type string, source_agent string, target_agent string, payload_json string")
    got = {r["seq"]: r["line"] for r in ev.payload_log_lines(e).collect()}
    assert got == {1: "Event: x from a to all - {'b': 1, 'a': {'c': [1, None]}}", 2: "Event: x from a to t - {}",
                   3: "Event: x from a to all - not json {", 4: "Event: y from b to all - {}"}
    p = pl.parsed(F.col("payload_json"))
    vals = e.select("seq", pl.field(p, "$.a.c[0]", "int", -1).alias("v"), pl.field(p, "$.b", "string", "none").alias("b"),
                    pl.field(p, "$.a", "int", 7).alias("w")).orderBy("seq").collect()
    assert [(r["v"], r["b"], r["w"]) for r in vals] == [(1, "1", 7), (-1, "none", 7), (-1, "none", 7), (-1, "none", 7)]
