"""Small document tables with the awkward cases every operator must take."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start long, rank string, copy string, kept string, n long"
SPACE = r"[^\x20\x09-\x0D]+"


def words(text, lower=False):
    t = text or ""
    if lower:
        t = t.translate({c: c + 32 for c in range(65, 91)})
    return re.findall(SPACE, t)


def prose(rng, n, vocabulary=400):
    out = []
    for i in range(n):
        w = f"w{rng.randrange(vocabulary)}x"
        out.append(w.capitalize() if rng.random() < 0.1 else w)
        if rng.random() < 0.08:
            out[-1] += rng.choice([".", ",", ".\n", "!\n\n"])
    return " ".join(out)


def rows(seed=5):
    """(doc_id, text, lang, source): nulls, empty, long, repeated and near texts."""
    rng = random.Random(seed)
    base = [prose(rng, rng.choice([3, 12, 40, 120, 300])) for _ in range(40)]
    long_text = prose(rng, 30_000, 5000)
    texts = base + base[5:9] * 3 + [None, "", " \t\n ", "one", "one two three", "ONE two three", "é ü 漢字 🙂 ¿qué? x", long_text]
    for t in (base[10], base[11], long_text):  # near copies: a few words changed
        w = t.split(" ")
        for k in (1, 2):
            v = list(w)
            for j in range(0, len(v), 150):
                v[min(j + k, len(v) - 1)] = f"changed{k}"
            texts.append(" ".join(v))
    out = [(i + 1, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None])) for i, t in enumerate(texts)]
    return out


def frame(spark, data):
    """A table with the columns of ``documents`` and extra ones whose names operators use inside."""
    return spark.createDataFrame([(i, t, la, s, None if t is None else len(t), 7, "r", "c", "k", 9) for i, t, la, s in data], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
