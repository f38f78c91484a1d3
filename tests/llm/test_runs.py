"""Periodic runs against a plain search of all periods."""

import random

import numpy as np
import pytest
from brute import run_row, runs

from alertloom.llm import periodic_runs, words
from alertloom.llm.queries import QUERIES

COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def values(sequence):
    names = {w: i for i, w in enumerate(dict.fromkeys(sequence))}
    return words.mix(np.array([names[w] + 1 for w in sequence], dtype=np.uint64)) if sequence else np.zeros(0, dtype=np.uint64)


def found(sequence):
    return [(a, b - a, q) for a, b, q in periodic_runs.runs_of(values(sequence), len(sequence)).tolist()]


def sequences():
    rng = random.Random(3)
    for _ in range(200):
        letters, out = rng.choice([1, 2, 3, 40]), []
        while len(out) < rng.choice([5, 60, 900, 2500]):
            block = rng.choices(range(letters), k=rng.randint(1, rng.choice([3, 30, 90, 200])))
            if rng.random() < 0.3:  # a period that holds a highly periodic part
                block = block + block[:1] * rng.randint(5, 70)
            out += (block * 12)[: rng.randint(1, max(1, int(len(block) * rng.uniform(0.5, 11))))]
        yield out
    yield [0, 1] * 500 + [2] + [0, 1] * 300
    yield ([0] * 63 + [1]) * 9
    yield (list(range(37)) * 5)[:-1] + [99] + list(range(37)) * 4


def test_runs_equal_brute_force():
    total = 0
    for sequence in sequences():
        want = runs(sequence)
        assert found(sequence) == want, sequence
        total += sum(q >= periodic_runs.SMALL for _, _, q in want)
    assert total > 50


def test_thue_morse_words_are_not_taken_for_runs():
    word = [bin(i).count("1") % 2 for i in range(1 << 13)]
    assert found(word) == runs(word) == []


def test_chosen_positions_are_consistent_and_dense():
    rng = random.Random(5)
    text = [rng.randrange(50) for _ in range(3000)]
    twice = values(text + [-1] + text)
    n, t = len(twice), 32
    chosen = periodic_runs.synchronising(periodic_runs._Prefix(twice), n, t, np.zeros(n, dtype=bool))
    a, b = chosen[chosen < 3000 - 2 * t], chosen[(chosen > 3000) & (chosen - 3001 < 3000 - 2 * t)] - 3001
    assert a.tolist() == b.tolist()
    assert np.diff(chosen).max() <= t and len(chosen) < 4 * n / t


def test_query_equals_brute_force(spark, sf, pairs):
    got = sorted(tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_periodic_runs"](spark, sf).collect())
    assert got == sorted(run_row(*p) for p in pairs)
    assert sum(r[1] for r in got) > 10


@pytest.fixture()
def odd(table):
    long = "ab cd ef " * 30_000 + " ".join(f"w{i}" for i in range(50_000))
    cases = [(1, None), (2, ""), (3, " \t\n"), (4, "a a a a a a"), (4, "a a a a a a"), (5, "a a a a a"), (None, "x y " * 9), (6, long), (7, "é ü " * 12), (8, "a a a a a a b b b b b b")]
    return cases, periodic_runs.digest(periodic_runs.find(periodic_runs.looped(table(cases))))


def test_odd_input(odd, table):
    cases, got = odd
    rows = {}
    for r in got.collect():
        rows.setdefault(r["doc_id"], []).append(tuple(r[c] for c in COLUMNS))
    for doc, text in cases:
        if doc not in (6, None):
            assert set(rows[doc]) == {run_row(doc, text)}
    assert len(rows[4]) == 2
    assert rows[None][0][1:6] == (1, 0, 18, 2, 9000)
    assert rows[6][0][1] >= 1
    assert periodic_runs.digest(periodic_runs.find(table([]))).count() == 0


def test_collapsed_text_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "x a b a b a b a b y", 0, 0)], "doc_id long, text string, runs int, n_words int")
    row = periodic_runs.find(docs).first()
    assert row["collapsed"] == "x a b y" and [tuple(r) for r in row["runs"]] == [(1, 8, 2)] and row["n_words"] == 10
    with pytest.raises(ValueError):
        periodic_runs.find(docs, exponent=2)


def test_text_ids(spark):
    docs = spark.createDataFrame([("k1", "a a a a a a a")], "doc_id string, text string")
    assert periodic_runs.find(periodic_runs.looped(docs)).first()["runs"][0]["period"] == 1
