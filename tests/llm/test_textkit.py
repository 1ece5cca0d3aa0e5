import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm.line_dedup import line_hashes
from factloom.llm.textkit import U, chunks, kgrams, minimisers, word_hashes

TEXT = st.text(alphabet="ab \n\té", max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=12), st.integers(1, 60))
def test_words_and_lines_of_chunks(texts, size):
    names, lines, got_words, got_lines, valid = {}, {}, [], [], []
    for chunk in chunks(pa.array(texts, pa.string()), size):
        h, first = word_hashes(chunk)
        got_words += [h[a:b].tolist() for a, b in zip(first, first[1:])]
        lh, sizes, lf = line_hashes(chunk)
        got_lines += [lh[a:b].tolist() for a, b in zip(lf, lf[1:])]
        valid += chunk.valid.tolist()
    assert valid == [t is not None for t in texts]
    for t, ws, ls in zip(texts, got_words, got_lines):
        assert len(ws) == len((t or "").split()) and len(ls) == (t or "").count("\n") + 1
        for w, h in zip((t or "").split(), ws):
            assert names.setdefault(w, h) == h
        for x, h in zip((t or "").split("\n"), ls):
            assert lines.setdefault(x, h) == h
    assert len(set(names.values())) == len(names) and len(set(lines.values())) == len(lines)


def test_slices_keep_their_offsets():
    column = pa.array(["a b", None, "c", "d e f"]).slice(2)
    (chunk,) = chunks(column)
    assert np.diff(word_hashes(chunk)[1]).tolist() == [1, 3]


def test_minimisers_against_all_windows():
    rng = random.Random(1)
    k, w = 3, 5
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 40))) for _ in range(30)]
    (chunk,) = chunks(pa.array(texts))
    h, first = word_hashes(chunk)
    grams, ok = kgrams(h, first, k)
    want = set()
    low = U((1 << 26) - 1)
    for a, b in zip(first, first[1:]):
        n = b - a - k + 1
        for j in range(n - w + 1):
            window = range(a + j, a + j + w)
            want.add(min(window, key=lambda i: (grams[i] & ~low, i)))
    assert minimisers(grams, first, k, w).tolist() == sorted(want)
