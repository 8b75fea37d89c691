import os
import sys

import numpy as np
import pyarrow as pa

sys.path.insert(0, os.path.dirname(__file__))
import docs as D  # noqa: E402

from weft.llm.textops import WordHasher, combine, text_chunks, windows  # noqa: E402


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])


def test_words_are_the_runs_outside_the_six_spaces():
    texts = [t for _, t, *_ in D.rows()]
    h = WordHasher()
    got = []
    for part, data, offs in text_chunks(batch(texts), limit=20_000):
        s, e, at = h.words(data, offs)
        raw = data.tobytes()
        got += [[raw[s[i]:e[i]].decode() for i in range(a, b)] for a, b in zip(at[:-1], at[1:])]
    assert got == [D.words(t) for t in texts]


def test_equal_words_have_equal_hashes_wherever_they_stand():
    h = WordHasher(lower=True)
    seen = {}
    texts = [t for _, t, *_ in D.rows()]
    for limit in (1000, 1 << 22):
        for part, data, offs in text_chunks(batch(texts), limit=limit):
            s, e, _ = h.words(data, offs)
            raw = data.tobytes()
            for i, v in enumerate(h.hashes(data, s, e).tolist()):
                w = raw[s[i]:e[i]].decode().translate({c: c + 32 for c in range(65, 91)})
                assert seen.setdefault(w, v) == v
    assert len(set(seen.values())) == len(seen)


def test_chunks_cover_sliced_batches_and_nulls():
    b = batch([None, "ab", "", "cd e", None]).slice(1, 3)
    parts = list(text_chunks(b, limit=2))
    assert [p.num_rows for p, *_ in parts] == [2, 1]
    assert b"".join(d.tobytes() for _, d, _ in parts) == b"abcd e"


def test_windows_stay_inside_documents():
    h = np.arange(1, 8, dtype=np.uint64)
    g, first = windows(h, np.array([0, 2, 2, 7]), 3)
    assert first.tolist() == [2, 3, 4]
    assert g[0] == combine([h[2:3], h[3:4], h[4:5]])[0]
