"""Personal data by fixed patterns and bootstrapped contexts (operator 2, native).

Only DataFrame functions. Places are code points, found from the lengths of the
matches of a pattern and of the text between them. The base patterns are
written so that Java's matcher goes through a text once: a match starts only at
the beginning of a run (or where the last match ended), and runs are possessive.

*Bootstrapping.* Seed instances of confidence 1 are the base matches and, outside
them, hexadecimal keys: runs of 32 or more hexadecimal digits with a letter and a
digit. Candidates are other runs of letters, digits, ``_`` and ``-`` of six or more
characters with a digit. Words are lower case, without outer punctuation, digits as
``0``; a context reaches 64 characters, or to the next match of the same kind. Each
occurrence lends its instance up to five lexical patterns:

* ``L1``, ``L2``: the word, the two words before it;
* ``R1``, ``R2``: the word, the two words after it;
* ``LR``: the word before and the word after it.

A cue may so be made of words that are common each for itself. How often the words
of a pattern stand together at all, over the whole corpus, tells cues from chance;
only patterns with ``MIN_SUPPORT`` distinct seeds are looked up there. Over the
graph of (pattern, instance) pairs with their numbers of occurrences Spark repeats
``ROUNDS`` times:

* a pattern's confidence is the sum of its occurrences' confidences over the
  number of times its words occur, plus one (so a common context, or one seen with
  many unknowns, or rarely, stays low);
* an unknown instance's confidence is 1 - (1 - l) (1 - r), l the highest confidence
  of its patterns with a word before, r that of the others (patterns of one side
  are no independent witnesses).

Occurrences of hexadecimal keys, and of unknown instances of confidence
``MIN_CONFIDENCE`` or more, that stand in a pattern of ``MIN_PATTERN`` or more are
added as spans of kind ``id``, where they don't touch a base span. Base spans and
counts stay as they are.

Edge cases: a null or empty text has no spans; equal rows get the same answer; a
null doc_id is carried along; empty tables give no rows; other columns are
ignored by :func:`find` and kept by :func:`redact`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm import scratch

KINDS = ("email", "ip", "card", "phone")
PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){2}\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "id": r"(?:\G|(?<![A-Za-z0-9_-]))(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{6,}+",
}
GUARD = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "id": r"[0-9]"}
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
HEX_KEY = r"^(?=[a-f]*+[0-9])(?=[0-9]*+[a-f])[0-9a-f]{32,}+$"  # of a candidate in lower case
APART = r"""\x20\x09-\x0D"'=:;,()\[\]{}<>|"""  # one of these stands between words of a context
OTHER = rf"[^\p{{L}}\p{{N}}_{APART}]"         # other punctuation goes at the ends of a word
GAP = rf"^[^\p{{L}}\p{{N}}_]++|(?<!{OTHER}){OTHER}*+(?:[{APART}][^\p{{L}}\p{{N}}_]*+|\z)"
REACH = 64
BLOCK = 128
ROUNDS, MIN_SUPPORT, MIN_PATTERN, MIN_CONFIDENCE = 3, 5, 0.6, 0.6


def _sums(a: Column) -> Column:
    """Running sums of a short array."""
    return F.aggregate(a, F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("l")),
                       lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.array_append(acc["l"], acc["s"] + x).alias("l")), lambda acc: acc["l"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    back = F.split(F.reverse(digits), "")
    twice = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    total = F.aggregate(F.transform(back, lambda c, i: F.when(i % 2 == 1, F.get(twice, c.cast("int"))).otherwise(c.cast("int"))), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """The contract's test of a match."""
    if kind == "ip":
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        n = F.length(_digits(m))
        return F.when((n >= 14) & (n <= 19), luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def placed(df: DataFrame, kinds: tuple[str, ...], keep: list[str]) -> DataFrame:
    """Add for each kind an array of its matches (start, end, text, before, after);
    start and end in code points, end exclusive; before and after up to ``REACH`` characters."""
    steps = df
    for fn in (
        # texts a cheap test rules out are not searched
        lambda k: [F.when(F.col("text").rlike(GUARD[k]), F.regexp_extract_all("text", F.lit(PATTERN[k]), 0)).alias(f"m_{k}"),
                   F.when(F.col("text").rlike(GUARD[k]), F.split("text", PATTERN[k], -1)).alias(f"g_{k}")],
        # distance from the start of a match to that of the one before; in blocks, so that sums stay linear
        lambda k: [F.col(f"m_{k}"), F.col(f"g_{k}"), F.transform(f"m_{k}", lambda x, i: F.char_length(F.get(f"g_{k}", i)) + F.when(
            i > 0, F.char_length(F.get(f"m_{k}", i - 1))).otherwise(0)).alias(f"d_{k}")],
        lambda k: [F.col(f"m_{k}"), F.col(f"g_{k}"), F.when(F.size(f"d_{k}") > 0, F.transform(F.sequence(F.lit(0), F.floor(
            (F.size(f"d_{k}") - 1) / BLOCK).cast("int")), lambda b: _sums(F.slice(f"d_{k}", b * BLOCK + 1, F.lit(BLOCK))))).alias(f"b_{k}")],
        lambda k: [F.col(f"m_{k}"), F.col(f"g_{k}"), F.col(f"b_{k}"), _sums(F.transform(f"b_{k}", lambda x: F.element_at(x, -1))).alias(f"t_{k}")],
        # (a column used twice is computed once; used once, it would be computed anew for each element)
        lambda k: [F.col(f"m_{k}"), F.col(f"g_{k}"), F.when(F.size(f"t_{k}") > 0, F.flatten(F.transform(f"b_{k}", lambda x, i: F.transform(
            x, lambda y: y + F.when(i > 0, F.get(f"t_{k}", i - 1)).otherwise(0))))).alias(f"s_{k}")],
        lambda k: [F.coalesce(F.transform(f"m_{k}", lambda x, i: F.struct(
            F.get(f"s_{k}", i).alias("start"), (F.get(f"s_{k}", i) + F.char_length(x)).alias("end"), x.alias("text"),
            F.right(F.get(f"g_{k}", i), F.lit(REACH)).alias("before"), F.left(F.get(f"g_{k}", i + 1), F.lit(REACH)).alias("after"))),
            F.array().cast("array<struct<start:int,end:int,text:string,before:string,after:string>>")).alias(k)],
    ):
        steps = steps.select(*keep, *[c for k in kinds for c in fn(k)])
    return steps


def words_of(text: Column) -> Column:
    """The words of a text in normal form."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), "[0-9]", "0"), GAP), "")


def _patterns(before: Column, after: Column) -> Column:
    """The patterns (kind, words) of an occurrence from the words before and after it."""
    last, first = F.get(before, F.size(before) - 1), F.get(after, F.lit(0))
    every = [("L1", [last]), ("L2", [F.get(before, F.size(before) - 2), last]), ("R1", [first]), ("R2", [first, F.get(after, F.lit(1))]),
             ("LR", [last, F.lit("_"), first])]
    return F.filter(F.array(*[F.struct(F.lit(kind).alias("kind"), _phrase(w).alias("words")) for kind, w in every]), lambda x: x["words"].isNotNull())


def _phrase(words: list[Column]) -> Column:
    """Words joined by spaces, which no word holds; null if one is missing."""
    return F.concat(*[x for w in words for x in (F.lit(" "), w)][1:])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def phrase_counts(text: DataFrame, phrases: DataFrame) -> DataFrame:
    """(words, total): how often each of ``phrases`` (words, distinct) stands in the texts.

    Single words, pairs, and pairs around one word are held against the phrases
    where the text is, if Spark finds these small enough to bring there, else by a
    join that splits frequent words; only hits are counted."""
    w = F.col("w")
    pairs = F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda x, y: _phrase([x, y]))
    around = F.zip_with(F.slice(w, 1, F.size(w) - 2), F.slice(w, 3, F.size(w)), lambda x, y: _phrase([x, F.lit("_"), y]))
    some = text.select(words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    every = F.concat(w, pairs, F.when(F.size(w) > 2, around).otherwise(F.array().cast("array<string>")))
    return some.select(F.explode(every).alias("words")).join(phrases, "words", "left_semi").groupBy("words").agg(F.count("*").alias("total"))


def _whole(words: Column, cut: Column, place: int) -> Column:
    """Words of a context without the one (first: 1, last: -1) that its end may have cut."""
    return F.when(cut & (F.size(words) > 0), F.slice(words, 2 if place == 1 else 1, F.size(words) - 1)).otherwise(words)


def discover(found: DataFrame, text: DataFrame, folder: str) -> DataFrame:
    """(doc_id, copy, start, end) of the unseen identifiers the bootstrapping accepts.

    ``found`` has doc_id, copy, start, end, base, text, before, after; ``text`` the corpus."""
    key = ["doc_id", "copy"]
    # distance to the base spans of the document: the largest end before, the least start after
    order = Window.partitionBy(*key).orderBy("start", F.desc("base"), "end")
    back = Window.partitionBy(*key).orderBy(F.desc("start"), "base", F.desc("end"))  # a frame up to the end would be summed anew for each row
    f = found.dropDuplicates([*key, "start", "end", "base"])
    f = f.withColumn("till", F.max(F.when(F.col("base") == 1, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))) \
         .withColumn("next", F.min(F.when(F.col("base") == 1, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    free = (F.coalesce("till", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("next") >= F.col("end"), F.lit(True)))
    f = f.where((F.col("base") == 1) | free).withColumn("instance", F.lower("text"))
    f = f.withColumn("seed", F.when(F.col("instance").rlike(HEX_KEY), 1).otherwise(F.col("base")))
    f = f.select(*key, "start", "end", "base", "seed", "instance",
                 _whole(words_of(F.col("before")), F.char_length("before") >= REACH, 1).alias("before"),
                 _whole(words_of(F.col("after")), F.char_length("after") >= REACH, -1).alias("after"))
    f = f.withColumn("patterns", _patterns(F.col("before"), F.col("after"))).drop("before", "after")
    f = scratch.stored(f, f"{folder}/occurrences")
    edges = f.select("instance", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(
        F.max("seed").alias("seed"), F.count("*").alias("n"))
    # only patterns that enough seeds support take part
    support = edges.groupBy("pattern").agg(F.sum("seed").alias("support"), F.sum("n").alias("seen")).where(F.col("support") >= MIN_SUPPORT)
    support = scratch.stored(support.select("pattern", "seen"), f"{folder}/support")
    if support.isEmpty():
        return f.where("false").select(*key, "start", "end")
    phrases = scratch.stored(support.select("pattern.words").distinct(), f"{folder}/phrases")
    counts = phrase_counts(text, phrases)
    # an instance of several words hides some of its contexts from the counts
    totals = support.join(counts, F.col("pattern.words") == counts["words"], "left").select("pattern", F.greatest("seen", "total").alias("total"))
    edges = scratch.stored(edges.join(totals, "pattern"), f"{folder}/edges")
    known = edges.select("instance", F.col("seed").cast("double").alias("conf")).groupBy("instance").agg(F.max("conf").alias("conf"))
    patterns = None
    ahead = F.col("pattern.kind").startswith("L")
    for i in range(ROUNDS):
        patterns = edges.join(known, "instance").groupBy("pattern").agg((F.sum(F.col("n") * F.col("conf")) / (F.max("total") + 1)).alias("p"))
        patterns = scratch.stored(patterns, f"{folder}/patterns{i}")
        best = [1 - F.coalesce(F.max(F.when(side, F.col("p"))), F.lit(0.0)) for side in (ahead, ~ahead)]
        known = edges.join(patterns, "pattern").groupBy("instance").agg(F.max("seed").alias("seed"), (1 - best[0] * best[1]).alias("c"))
        known = scratch.stored(known.select("instance", F.when(F.col("seed") == 1, 1.0).otherwise(F.col("c")).alias("conf")), f"{folder}/known{i}")
    good = patterns.where(F.col("p") >= MIN_PATTERN).select("pattern")
    sure = known.where(F.col("conf") >= MIN_CONFIDENCE).select("instance")
    new = f.where("base = 0").select(*key, "start", "end", "instance", F.explode("patterns").alias("pattern"))
    return new.join(good, "pattern", "left_semi").join(sure, "instance", "left_semi").select(*key, "start", "end").distinct()


SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _texts(docs: DataFrame, *more: Column) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more)
    return d.withColumn("copy", F.xxhash64("text"))


def _base() -> Column:
    """The base spans in order, from the arrays of valid matches."""
    return F.sort_array(F.concat(*[spans_of(k, i) for i, k in enumerate(KINDS)]).cast(SPAN))


def _with_new(base: Column, more: Column) -> Column:
    return F.when(more.isNull(), base).otherwise(F.sort_array(F.concat(base, more)))


def searched(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per row doc_id, copy, counts and base spans; per document the spans discovered), both written."""
    folder = scratch.new_folder(docs.sparkSession, "pii")
    d = _texts(docs)
    p = located(d, (*KINDS, "id"), ["doc_id", "copy"])
    every = F.concat(*[F.transform(k, lambda x: F.struct(F.lit(1).alias("base"), x.alias("x"))) for k in KINDS],
                     F.transform("id", lambda x: F.struct(F.lit(0).alias("base"), x.alias("x"))))
    told = scratch.stored(p.select("doc_id", "copy", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], _base().alias("base"),
                                   every.alias("found")), f"{folder}/told")
    each = told.select("doc_id", "copy", F.explode("found").alias("o")).select("doc_id", "copy", "o.base", "o.x.*")
    new = discover(each, d.select("text"), folder).groupBy("doc_id", "copy").agg(F.collect_list(F.struct(
        F.col("start"), F.lit(len(KINDS)).alias("rank"), F.col("end"), F.lit("id").alias("kind"))).cast(SPAN).alias("more"))
    return told.drop("found"), scratch.stored(new.toDF("n_doc", "n_copy", "more"), f"{folder}/new")


def find(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, copy (text hash), counts of the base kinds, ``base`` and ``all``
    spans as arrays of (start, rank of the kind, end, kind) in order."""
    told, new = searched(docs)
    joined = told.join(new, told["doc_id"].eqNullSafe(new["n_doc"]) & (told["copy"] == new["n_copy"]), "left")
    return joined.select(*told.columns, _with_new(F.col("base"), F.col("more")).alias("all"))


def only_valid(kind: str) -> Column:
    return F.filter(kind, lambda x: valid(kind, x["text"]))


def spans_of(kind: str, rank: int) -> Column:
    return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def located(d: DataFrame, kinds: tuple[str, ...], keep: list[str]) -> DataFrame:
    """The columns ``keep`` and for each kind the array of its valid matches."""
    return placed(d, kinds, keep).select(*keep, *[only_valid(k).alias(k) for k in kinds])


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; all columns
    as they came (``n_chars``, if there is one, follows the text).

    Base spans are found where the text is; only spans discovered elsewhere in
    the corpus, if there are any, are joined to it."""
    _, new = searched(docs)
    d = _texts(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    d = located(d, KINDS, ["_row", "doc_id", "copy"]).select("_row", "doc_id", "copy", _base().alias("base"))
    if new.isEmpty():
        d = d.withColumn("all", F.col("base"))
    else:
        d = d.join(new, d["doc_id"].eqNullSafe(new["n_doc"]) & (d["copy"] == new["n_copy"]), "left")
        d = d.withColumn("all", _with_new(F.col("base"), F.col("more")))
    # spans that overlap: the first one's kind stands for all they cover
    old = F.col("_row.text")
    fold = F.aggregate("all", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda a, x: F.when(
        x["start"] >= a["at"], F.struct(x["end"].alias("at"), F.concat(a["out"], F.substring(old, a["at"] + 1, x["start"] - a["at"]),
                                                                       F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("out")))
        .otherwise(F.struct(F.greatest(a["at"], x["end"]).alias("at"), a["out"].alias("out"))))
    d = d.select("_row", F.size("all").alias("_n"), F.when(F.size("all") > 0, fold).alias("_fold"))
    d = d.withColumn("_text", F.when(F.col("_n") > 0, F.concat("_fold.out", F.substring(
        old, F.col("_fold.at") + 1, F.char_length(old)))).otherwise(old))
    out = {c: F.col(f"_row.`{c}`") for c in docs.columns} | {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("_n") > 0, F.char_length("_text")).otherwise(F.col("_row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return d.select(*[v.alias(c) for c, v in out.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the whole table."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"))
