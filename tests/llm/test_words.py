"""Word arrays against regular expressions."""

import re

import numpy as np
import pyarrow as pa
from brute import normal_words
from hypothesis import given, settings
from hypothesis import strategies as st

from alertloom.llm import words as W

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB9 .\n\té\U0001F600-", max_size=40)), max_size=6)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_equal_the_pattern(texts):
    column = pa.array(texts, pa.string())
    for inside, lower, plain in ((W.ALNUM, True, normal_words), (W.NON_BLANK, False, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or ""))):
        words = W.split(*W.text_bytes(column), inside, lower=lower)
        got = [[] for _ in texts]
        for i, r in enumerate(words.row):
            got[r].append(words.text(i))
        assert got == [plain(t) for t in texts]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=30), min_size=1, max_size=5), st.integers(1, 4))
def test_equal_windows_have_equal_hashes(texts, k):
    words = W.split(*W.text_bytes(pa.array(texts)), W.NON_BLANK)
    at, found = W.windows(words.hashes(), words.row, k)
    grams = [" ".join(words.text(j) for j in range(i, i + k)) for i in at]
    assert len(set(grams)) == len(set(found.tolist())) == len(set(zip(grams, found.tolist(), strict=True)))
    assert len(grams) == sum(max(0, len(t.split(" ")) - t.split(" ").count("") - k + 1) for t in texts)


def test_slices_keep_rows_and_order():
    texts = ["a" * 10, "", None, "b" * 3000, "c"] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(texts)], names=["n", "text"])
    seen, total = [], 0
    for rows, data, bounds in W.slices([batch.slice(3)], limit=4000):
        assert len(bounds) == rows.num_rows + 1 and len(data) == bounds[-1]
        seen += W.column(rows, "n").to_pylist()
        total += len(data)
    assert seen == list(range(3, 100)) and total == sum(len(t or "") for t in texts[3:])
    assert len(np.unique(W.mix(np.arange(1000, dtype=np.uint64)))) == 1000
