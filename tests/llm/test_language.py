"""Code lengths against plain prediction by partial matching, and held-out accuracy."""

import random
import zlib

import numpy as np
import pytest
from brute import code_length

from alertloom.llm import context_trees
from alertloom.llm.queries import QUERIES

FRENCH = ["le chat est là", "la maison été", "les chats aussi", "où est la maison"]
ENGLISH = ["the cat is there", "the house in summer", "where is the house", "cats too"]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(t, "fr") for t in FRENCH] + [(t, "en") for t in ENGLISH] + [(None, "en"), ("nix", None), ("", "fr")], "text string, lang string")


@pytest.mark.parametrize("order", [0, 1, 2, 4, 5])
def test_code_lengths_are_exact(small, order):
    model = context_trees.train(small, order=order)
    texts = ["the chat", "été là où", "", "zzz\x00\x01", "the house in summer", "日本語", "a"]
    joined = [t.encode() for t in texts]
    bounds = np.concatenate(([0], np.cumsum([len(b) for b in joined])))
    got = model.code_lengths(np.frombuffer(b"".join(joined), dtype=np.uint8), bounds)
    for i, text in enumerate(texts):
        for j, training in enumerate((ENGLISH, FRENCH)):
            assert got[i, j] == pytest.approx(code_length(text, training, order), abs=1e-6)


def test_probabilities_sum_to_one(small):
    model = context_trees.train(small, order=3)
    for context in (b"", b"t", b"th", b"the", b"la ", b"qq", b"xyz", "é".encode()):
        keys = np.array([((len(context) + 1) << 56) | int.from_bytes(context + bytes([b]), "big") for b in range(256)], dtype=np.uint64)
        for tree in model.trees:
            assert np.exp2(-tree.bits(keys, 3)).sum() == pytest.approx(1.0)


def test_bound_of_nodes(small):
    model = context_trees.train(small, order=4, max_nodes=60)
    assert sum((tree.gram >> np.uint64(56) > 1).sum() for tree in model.trees) <= 60
    for tree in model.trees:  # shorter contexts of what is kept are kept
        size = (tree.gram >> np.uint64(56)).astype(int)
        raw = {int(g) & ((1 << 8 * s) - 1) | s << 64 for g, s in zip(tree.gram, size, strict=True)}
        assert all(s == 1 or (int(g) & ((1 << 8 * (s - 1)) - 1) | (s - 1) << 64) in raw for g, s in zip(tree.gram, size, strict=True))


def test_held_out_accuracy(spark, sf, docs):
    got = {r["doc_id"]: r for r in QUERIES["op11_context_trees"](spark, sf).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert got.keys() == truth.keys()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    tested = [i for i in truth if got[i]["held_out"]]
    assert sum(got[i]["lang_pred"] == truth[i] for i in tested) >= 0.93 * len(tested) and len(tested) > 20
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_odd_input(spark, table):
    rng = random.Random(1)
    long = " ".join(rng.choice(ENGLISH) for _ in range(40_000))
    cases = [(1, None), (2, ""), (3, "12 .. 34"), (4, "the house"), (4, "the house"), (None, "la maison"), (5, long), (6, "日本"), (7, "ª")]
    docs = table(cases).withColumnRenamed("hash", "lang").withColumnRenamed("row_key", "letters")
    model = context_trees.train(spark.createDataFrame([(t, "fr") for t in FRENCH] + [(t, "en") for t in ENGLISH], "text string, lang string"))
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in context_trees.identify(docs, model).collect()]
    by = {i: p for i, p, _ in got}
    assert len(got) == len(cases) and [by[i] for i in (1, 2, 3)] == ["und"] * 3 and by[4] == by[5] == "en" and by[None] == "fr" and by[6] != "und"
    assert all(s == 0 for _, p, s in got if p == "und")
    nothing = context_trees.train(docs.limit(0))
    assert {r["lang_pred"] for r in context_trees.identify(docs, nothing).collect()} == {"und"}
    assert context_trees.identify(docs.limit(0), model).count() == 0


def test_equal_code_lengths_take_the_first_name(spark):
    model = context_trees.train(spark.createDataFrame([("same words", "b"), ("same words", "a")], "text string, lang string"))
    row = context_trees.identify(spark.createDataFrame([("k", "words")], "doc_id string, text string"), model).first()
    assert (row["lang_pred"], row["score"]) == ("a", 0.5)
