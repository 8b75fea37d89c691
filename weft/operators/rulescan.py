"""J9 with rules as data: lines of texts against a table of regular expressions.

The rules' necessary literals (:mod:`weft.functions.literals`) go into one
automaton per case mode, which reads each text once, however many rules there
are; a rule's regular expression runs only on lines where one of its literals
occurs. A rule without a literal runs on every line.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 20_000           # rules of one pass over the texts
RULE_BYTES = 32 << 20    # bytes of rules of one pass


class Scanner:
    """Rules compiled once per task."""

    def __init__(self, rules: list[tuple[str, str]]):
        import ahocorasick

        from weft.functions.literals import needed

        self.rules = [(name, re.compile(pattern)) for name, pattern in rules]
        self.everywhere, words = [], {False: {}, True: {}}
        for i, (_, pattern) in enumerate(rules):
            found = needed(pattern)
            if found is None:
                self.everywhere.append(i)
                continue
            for w in found[0]:
                words[found[1]].setdefault(w, []).append(i)
        self.automata = {}
        for fold, table in words.items():
            if table:
                a = ahocorasick.Automaton()
                for w, ids in table.items():
                    a.add_word(w, ids)
                a.make_automaton()
                self.automata[fold] = a

    def hits(self, text: str) -> list[tuple[int, int]]:
        """Sorted (line from 0, rule) of the lines that match."""
        starts = [0]
        at = text.find("\n")
        while at >= 0:
            starts.append(at + 1)
            at = text.find("\n", at + 1)
        maybe = {(n, i) for i in self.everywhere for n in range(len(starts))}
        for fold, a in self.automata.items():
            # one code point for one, so that places stay what they are
            for end, ids in a.iter(text.translate(LOWER) if fold else text):
                line = bisect_right(starts, end) - 1
                maybe.update((line, i) for i in ids)
        ends = starts[1:] + [len(text) + 1]
        return sorted((n, i) for n, i in maybe if self.rules[i][1].search(text[starts[n]:ends[n] - 1]))


#: Lower case of A-Z, and the other characters that match i, s or k where case is ignored.
LOWER = {**{c: c + 32 for c in range(65, 91)}, 0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"}


def rule_scan(docs: DataFrame, rules: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (key, line_no, rule) per line and rule that match; ``rules`` has the
    columns rule and pattern (Python syntax, searched within single lines).

    Rules reach the tasks in blocks of at most ``BLOCK`` rules and ``RULE_BYTES``
    bytes; each block costs one pass over the texts, so a table of any size is
    applied whole. Null texts and null patterns match nothing; a rule given twice
    counts once; a pattern that doesn't compile raises an error that names it."""
    table = rules.where("rule IS NOT NULL AND pattern IS NOT NULL").select("rule", "pattern").distinct().orderBy("rule", "pattern")
    ktype = docs.schema[key].dataType.simpleString()
    out = None
    for block in _blocks(table):
        found = docs.select(F.col(key).alias(key), F.col(text).alias("__text")).mapInArrow(
            _scan_fn(block), f"`{key}` {ktype}, line_no int, rule string")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.select(F.col(key), F.lit(0).alias("line_no"), F.lit("").alias("rule")).where("false")
    return out.distinct() if table.count() != table.select("rule").distinct().count() else out


def _blocks(table: DataFrame) -> Iterator[list[tuple[str, str]]]:
    block, size = [], 0
    for r in table.toLocalIterator():
        try:
            re.compile(r["pattern"])
        except re.error as e:
            raise ValueError(f"rule {r['rule']}: {e}: {r['pattern']}") from e
        block.append((r["rule"], r["pattern"]))
        size += len(r["pattern"]) + len(r["rule"])
        if len(block) >= BLOCK or size >= RULE_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _scan_fn(block: list[tuple[str, str]]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(block)
        for b in batches:
            rows, lines, names = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for n, r in scanner.hits(t) if t else ():
                    rows.append(i)
                    lines.append(n + 1)
                    names.append(scanner.rules[r][0])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(lines, pa.int32()), pa.array(names, pa.string())],
                                             names=[b.schema.names[0], "line_no", "rule"])
    return scan
