"""Chat formatting by minimum-cost role repair (operator 6).

A legal conversation is an optional system turn, then user and assistant turns
in alternation, the user first and the assistant last. The automaton's state is
the role of the turn being written (or none yet). For each turn read, dynamic
programming chooses among writing it as a new turn, merging it into the turn
being written (``MERGE``), inserting an empty turn before it (``INSERT``), and
giving it another role (``RELABEL``), such that the sum is least; at the end
empty turns are inserted until the last one is the assistant's. Among equally
cheap repairs the choice is fixed: from the end back, the first state in the
order (system, user, assistant, none), part by part.

A step is a 4 x 4 matrix over (min, +), and so is any run of steps. So
conversations are cut into parts of ``PART`` turn numbers: each part's matrix
is made from its roles alone, the parts of a conversation are chained (a few
matrices, whatever the texts), and each part is then repaired by itself between
the states chosen at its ends. A conversation of any length is dealt out over
tasks; the rendered parts, joined in order, are the conversation.

Edge cases: turns are read by turn number (null first), then role, then text; a
row repeated with the same number, role and text is read once, but a row without
a number is a turn of its own each time; a null text is an
empty turn; an unknown or null role costs a relabel whatever it becomes; a null
conv_id is a conversation of its own; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import scratch

ROLES = ("system", "user", "assistant")
#: Names of roles in common chat formats.
NAMES = {"system": 0, "developer": 0, "user": 1, "human": 1, "prompter": 1, "assistant": 2, "gpt": 2, "bot": 2, "ai": 2, "model": 2}
NONE, UNKNOWN = 3, 3          # state before any turn; code of an unknown role
MERGE, INSERT, RELABEL = 1, 2, 3
FOLLOWS = {(NONE, 0), (NONE, 1), (0, 1), (1, 2), (2, 1)}
FAR = 1 << 40
PART = 16384


def step_options(role: int, state: int) -> list[tuple[int, int, tuple[int, ...], bool]]:
    """(new state, cost, empty turns inserted, merged) for a turn of ``role`` read in ``state``."""
    out = []
    for q in range(3):
        cost = 0 if q == role else RELABEL
        if q == state:
            out.append((q, cost + MERGE, (), True))
        elif (state, q) in FOLLOWS:
            out.append((q, cost, (), False))
        else:
            for x in range(3):
                if (state, x) in FOLLOWS and (x, q) in FOLLOWS:
                    out.append((q, cost + INSERT, (x,), False))
    return out


#: By role code: by state: the options there.
OPTIONS = [[step_options(r, p) for p in range(4)] for r in range(4)]
#: Cost of the empty turns that end a conversation in each state.
CLOSING = {2: (), 1: (2,), 0: (1, 2), NONE: ()}


def matrix(roles: list[int]) -> list[int]:
    """Least cost from each state to each state over a run of turns (16 numbers, by row)."""
    rows = []
    for start in range(4):
        cost = [FAR] * 4
        cost[start] = 0
        for r in roles:
            new = [FAR] * 4
            for p in range(4):
                if cost[p] < FAR:
                    for q, c, *_ in OPTIONS[r][p]:
                        if cost[p] + c < new[q]:
                            new[q] = cost[p] + c
            cost = new
        rows += cost
    return rows


def chain(parts: list[list[int]]) -> list[tuple[int, int]]:
    """(state before, state after) of each part on the cheapest way from no turn to a closed end."""
    cost, back = [FAR, FAR, FAR, 0], []
    for m in parts:
        new, came = [FAR] * 4, [NONE] * 4
        for q in range(4):
            for p in range(4):
                if cost[p] + m[4 * p + q] < new[q]:
                    new[q], came[q] = cost[p] + m[4 * p + q], p
        cost = new
        back.append(came)
    state = min(range(4), key=lambda q: (cost[q] + INSERT * len(CLOSING[q]), q))
    out = []
    for came in reversed(back):
        out.append((came[state], state))
        state = came[state]
    return out[::-1]


def repair(roles: list[int], before: int, after: int) -> list[tuple[int, tuple[int, ...], bool]]:
    """(role written, empty turns inserted before it, merged) of each turn of a part."""
    cost = [FAR] * 4
    cost[before] = 0
    back = []
    for r in roles:
        new, came = [FAR] * 4, [None] * 4
        for p in range(4):
            if cost[p] < FAR:
                for q, c, inserted, merged in OPTIONS[r][p]:
                    if cost[p] + c < new[q]:
                        new[q], came[q] = cost[p] + c, (p, inserted, merged)
        cost = new
        back.append(came)
    out, q = [], after
    for came in reversed(back):
        p, inserted, merged = came[q]
        out.append((q, inserted, merged))
        q = p
    return out[::-1]


def render(turns: list[tuple[int, tuple[int, ...], bool]], texts: list[str], before: int, after: int, last: bool) -> tuple[str, dict]:
    """The part's text in chat markup, and what was done."""
    out, made, state = [], {"n_out": 0, "n_merged": 0, "n_inserted": 0}, before

    def begin(role: int, text: str) -> None:
        nonlocal state
        out.append(("" if state == NONE else "<|end|>\n") + f"<|{ROLES[role]}|>\n{text}")
        made["n_out"] += 1
        state = role

    for (q, inserted, merged), text in zip(turns, texts):
        for x in inserted:
            begin(x, "")
            made["n_inserted"] += 1
        if merged:
            out.append(f"\n{text}")
            made["n_merged"] += 1
        else:
            begin(q, text)
    if last:
        for x in CLOSING[after]:
            begin(x, "")
            made["n_inserted"] += 1
        if state != NONE:
            out.append("<|end|>\n")
    return "".join(out), made


def role_code(role: Column) -> Column:
    known = F.create_map(*[x for k, v in NAMES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(known[F.lower(F.trim(F.coalesce(role, F.lit(""))))], F.lit(UNKNOWN))


RESULT = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("n_in", pa.int64()), ("n_out", pa.int64()), ("n_merged", pa.int64()),
                    ("n_inserted", pa.int64()), ("n_relabelled", pa.int64()), ("cost", pa.int64()), ("rendered", pa.string())])


def repaired(turns: DataFrame) -> DataFrame:
    """One row per part of a conversation (mostly one): counts, cost and rendered text."""
    folder = scratch.new_folder(turns.sparkSession, "chat")
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role_code(F.col("role")).alias("code"),
                     F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("part", F.coalesce(F.floor(F.col("turn") / PART), F.lit(-(1 << 40))))
    # the parts' matrices, from the roles alone; a row without a number is a turn each time it stands there
    roles = t.groupBy("conv_id", "part", "turn", "code", "role", F.xxhash64("text").alias("h")).agg(
        F.when(F.col("turn").isNull(), F.count("*").cast("int")).otherwise(1).alias("times")).groupBy("conv_id", "part").agg(
        F.sort_array(F.collect_list(F.struct("turn", "code", "role", "h", "times"))).alias("l"))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = [matrix(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(m, pa.list_(pa.int64()))], names=["conv_id", "part", "m"])

    codes = F.flatten(F.transform("l", lambda x: F.array_repeat(x["code"], x["times"])))
    parts = roles.select("conv_id", "part", codes.alias("codes")).mapInArrow(matrices, "conv_id long, part long, m array<long>")

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv, l in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ends = chain([x["m"] for x in l])
                rows += [dict(conv=conv, at=x["part"], before=p, after=q, last=i == len(l) - 1) for i, (x, (p, q)) in enumerate(zip(l, ends))]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("conv", pa.int64()), ("at", pa.int64()), ("before", pa.int32()), ("after", pa.int32()), ("last", pa.bool_())]))

    ends = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "m"))).alias("l")).mapInArrow(
        chains, "conv long, at long, before int, after int, last boolean")
    ends = scratch.stored(ends, f"{folder}/ends")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key: tuple, rows: list[dict]) -> dict:
            codes, r = [x["code"] for x in rows], rows[0]
            chosen = repair(codes, r["before"], r["after"])
            text, made = render(chosen, [x["text"] for x in rows], r["before"], r["after"], r["last"])
            moved = sum(q != c for (q, *_), c in zip(chosen, codes))
            return dict(conv_id=key[0], part=key[1], n_in=len(rows), n_relabelled=moved, rendered=text,
                        cost=MERGE * made["n_merged"] + INSERT * made["n_inserted"] + RELABEL * moved, **made)

        key, rows = None, []
        for b in batches:
            out = []
            for x in b.to_pylist():
                if (x["conv_id"], x["part"]) != key:
                    if rows:
                        out.append(done(key, rows))
                    key, rows = (x["conv_id"], x["part"]), []
                if x["turn"] is None or not rows or any(x[c] != rows[-1][c] for c in ("turn", "role", "text")):
                    rows.append(x)
            yield pa.RecordBatch.from_pylist(out, schema=RESULT)
        if rows:
            yield pa.RecordBatch.from_pylist([done(key, rows)], schema=RESULT)

    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = t.join(ends, t["conv_id"].eqNullSafe(ends["conv"]) & (t["part"] == ends["at"])).drop("conv", "at")
    t = t.repartition(n, "conv_id", "part").sortWithinPartitions("conv_id", "part", "turn", "code", "role", F.xxhash64("text"), "text")
    return t.select("conv_id", "part", "turn", "code", "role", "text", "before", "after", "last").mapInArrow(
        write, "conv_id long, part long, n_in long, n_out long, n_merged long, n_inserted long, n_relabelled long, cost long, rendered string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the whole table."""
    return repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
