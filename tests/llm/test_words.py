import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from scrubwell.llm.words import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
texts = st.lists(st.one_of(st.none(), st.text(alphabet="aAbB é\t\n.\x1c日", max_size=30)), max_size=8)


def split(text):
    return WORD.findall((text or "").translate(LOWER))


@settings(max_examples=200, deadline=None)
@given(texts, st.integers(1, 40))
def test_words_and_hashes_equal_a_plain_split(column, limit):
    seen, rows = {}, 0
    for part in words(pa.array(column, pa.string()), limit):
        hashes = part.hashes()
        for i in range(len(part)):
            own = slice(part.offsets[i], part.offsets[i + 1])
            expected = split(column[part.first + i])
            assert [bytes(part.data[a:b]).decode() for a, b in zip(part.starts[own], part.ends[own])] == expected
            for word, h in zip(expected, hashes[own]):
                assert seen.setdefault(word, h) == h
            rows += 1
    assert rows == len(column) and len(set(seen.values())) == len(seen)


@settings(max_examples=100, deadline=None)
@given(texts, st.integers(1, 4))
def test_shingles_equal_plain_runs(column, size):
    seen = {}
    for part in words(pa.array(column, pa.string())):
        grams, offsets = part.shingles(size)
        for i in range(len(part)):
            w = split(column[part.first + i])
            runs = [tuple(w[k:k + size]) for k in range(len(w) - size + 1)] or ([tuple(w)] if w else [])
            own = grams[offsets[i]:offsets[i + 1]]
            assert len(own) == len(runs)
            for run, h in zip(runs, own):
                assert seen.setdefault(run, h) == h
    assert len(set(map(int, seen.values()))) == len(seen)


def test_sliced_columns_and_no_rows():
    column = pa.array(["x y", "A b", None, ""])
    (part,) = words(column.slice(1, 2))
    assert part.offsets.tolist() == [0, 2, 2]
    assert list(words(pa.array([], pa.string()))) == []
    assert np.array_equal(next(words(pa.array(["A b"]))).hashes(), part.hashes())
