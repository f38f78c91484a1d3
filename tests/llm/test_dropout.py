"""Merge-dropout is drawn for every occurrence."""

import numpy as np
import pyarrow as pa

from alertloom.llm import merge_dropout
from alertloom.llm import words as W


def encoded(coder, texts):
    data, bounds = W.text_bytes(pa.array(texts, pa.string()))
    ids, ends = coder.encode(data, bounds, W.mix(np.arange(len(texts), dtype=np.uint64)))
    back, back_ends = coder.decode(ids, ends)
    assert np.array_equal(back, data) and np.array_equal(back_ends, bounds)
    return [tuple(ids[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def test_a_long_word_has_more_than_eight_segmentations():
    coder = merge_dropout.Encoder(merge_dropout.MODEL, merge_dropout.DROPOUT, 1, merge_dropout.VARIANTS)
    assert len(set(encoded(coder, ["internationalization"] * 2000))) > 50


def test_kept_segmentations_are_those_of_each_occurrence(pairs):
    """What comes out equals encoding every occurrence for itself, one by one."""
    texts = [t for _, t in pairs if t][:25] + ["internationalization and responsibility " * 40, "日本語 é\U0001F600 " * 9, "x" * 60 + " " + "ab" * 15]
    for dropout in (0.1, 0.6, 1.0):
        coder = merge_dropout.Encoder(merge_dropout.MODEL, dropout, 7, None)
        got = encoded(coder, texts)
        plain = merge_dropout.Encoder(merge_dropout.MODEL, dropout, 7, None)
        plain._find = None  # nothing is kept
        limit, merge_dropout.LONGEST = merge_dropout.LONGEST, 0
        try:
            assert encoded(plain, texts) == got
        finally:
            merge_dropout.LONGEST = limit
        assert encoded(coder, texts) == got
