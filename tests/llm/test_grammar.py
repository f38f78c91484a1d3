"""Automata keep lengths and beginnings; parts of tokens against a plain search; very long tokens."""

import random
import time

import pytest

from alertloom.llm import secret_grammar as G

HEX = "0123456789abcdef"


def hexes(seed, n, size=40):
    rng = random.Random(seed)
    return ["".join(rng.choices(HEX, k=size)) for _ in range(n)]


def test_fixed_length_survives():
    known = G.Automaton(hexes(1, 3000))
    assert known.states > 40
    assert sum(known.excess(v) >= 0 for v in hexes(2, 200)) >= 190
    assert all(known.score(v) == float("-inf") for size in (24, 39, 41, 60) for v in hexes(3, 50, size))


def test_fixed_beginning_and_few_values_survive():
    rng = random.Random(4)
    values = ["ghp_" + "".join(rng.choices(HEX.upper(), k=12)) for _ in range(25)]  # fewer than SUPPORT: nothing may be merged
    known = G.Automaton(values)
    assert known.states == 17
    assert known.score("gh7_" + values[0][4:]) == known.score(values[0] + "A") == float("-inf") and known.score(values[1]) > 0


def test_variable_lengths_are_generalised():
    rng = random.Random(6)
    values = ["".join(rng.choices("BCDFGHJKLMNP", k=8 + min(int(rng.expovariate(0.2)), 40))) for _ in range(3000)]
    known = G.Automaton(values, ordinary=G.Ordinary(["weather", "station", "rainfall"] * 30))
    assert known.states < 30 and known.excess("BCDFGHJKLMNPBCDFGH") > 0


def plain_parts(scorer, value, cuts):
    """The best sum of excesses over parts without overlap, by all pairs of places."""
    starts, stops = sorted({0, *(c + 1 for c in cuts)}), sorted({*cuts, *(c + 1 for c in cuts), len(value)})
    best = [0.0] * (len(value) + 1)
    for at in range(1, len(value) + 1):
        best[at] = best[at - 1]
        if at in stops:
            for start in starts:
                if at - start >= G.SHORTEST:
                    over = max(a.excess(value[start:at]) for a in scorer.automata.values())
                    if over >= 0:
                        best[at] = max(best[at], best[start] + over)
    return best[-1]


def test_parts_equal_a_plain_search():
    rng = random.Random(9)
    ordinary = G.Ordinary(["weather", "station", "index.html", "v1.2"] * 40)
    loose = ["".join(rng.choices("XYZ01", k=6 + min(int(rng.expovariate(0.3)), 20))) for _ in range(1000)]
    scorer = G.Scorer({"hex": G.Automaton(hexes(1, 800, 12), ordinary=ordinary), "assign": G.Automaton(loose, ordinary=ordinary),
                       "access": G.Automaton(["K." + v for v in hexes(2, 500, 8)], ordinary=ordinary)})
    found = 0
    for _ in range(400):
        pieces = [rng.choice([hexes(rng.random(), 1, rng.choice([12, 12, 11, 8]))[0], "".join(rng.choices("XYZ01", k=rng.randint(3, 14))), "word", "K", ""]) for _ in range(rng.randint(2, 7))]
        value = "".join(p + rng.choice("=/.") for p in pieces).rstrip(".")
        cuts = [i for i, c in enumerate(value) if c in "=/."]
        got = scorer.parts(value, cuts)
        assert sum(over for *_, over in got) == pytest.approx(plain_parts(scorer, value, cuts), abs=1e-4), value
        assert all(b1 <= a2 for (_, b1, *_), (a2, *_) in zip(got, got[1:], strict=False))
        for a, b, name, over in got:
            assert scorer.automata[name].excess(value[a:b]) == pytest.approx(over)
        found += len(got)
    assert found > 300


def test_very_long_tokens_take_time_by_their_length():
    rng = random.Random(3)
    base64 = HEX + "ghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/"
    values = ["".join(rng.choices(base64[:-1], k=rng.randint(20, 60))) for _ in range(1000)]
    scorer = G.Scorer({"assign": G.Automaton(values)})
    blob = "".join(rng.choices(base64, k=300_000))
    begin = time.process_time()
    scorer.spans(blob, [])
    scorer.spans("a/" * 150_000, [])
    assert time.process_time() - begin < 20


def test_few_values_add_nothing_and_prose_is_left_alone(spark):
    rng = random.Random(8)
    prose = [" ".join("".join(rng.choices("aeioudtnsrh", k=rng.randint(2, 14))) for _ in range(80)) for _ in range(60)]
    few = [f"secret: {v} ok" for v in hexes(5, G.MIN_VALUES - 1, 20)]
    docs = spark.createDataFrame(list(enumerate(prose + few)), "doc_id long, text string")
    assert not any("format" in r["spans"] for r in G.digest(G.find_secrets(docs)).collect())
    many = [f"secret: {v} ok" for v in hexes(5, 300, 20)] + [f"see {v} there" for v in hexes(6, 30, 20)]
    docs = spark.createDataFrame(list(enumerate(prose + many)), "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in G.digest(G.find_secrets(docs)).collect()}
    assert not any("format" in found[i] for i in range(60))
    assert sum(found[i] == "format:4:24" for i in range(360, 390)) >= 28


def test_all_values_and_tokens_are_learnt(spark):
    """More values than any sample, and values longer than the depths that are told apart."""
    values = hexes(11, 3400) + hexes(12, 60, 300)
    texts = [f"see {v} and word{i}.index here" for i, v in enumerate(values)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    with G.own_tables(spark):
        learnt = G.learn(rows, G.scan(rows))["hex"]
    plain = G.Automaton(values, ordinary=G.Ordinary([f"word{i}.index" for i in range(len(values))]))
    assert plain.count[0] >= len(values) and learnt.count == plain.count and learnt.final == plain.final
    assert learnt.states == plain.states and learnt.threshold == pytest.approx(plain.threshold)
    probes = hexes(13, 50) + hexes(14, 20, 300) + hexes(15, 20, 41)
    assert [learnt.score(v) for v in probes] == pytest.approx([plain.score(v) for v in probes])
    assert all(learnt.score(v) > float("-inf") for v in probes[:70])


def test_place_of_a_score(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1.5, rng.gauss(0, 9)]), rng.randint(1, 4)) for _ in range(400)]
    frame = spark.createDataFrame(rows, "score double, n long")
    flat = sorted(s for s, n in rows for _ in range(n))
    for place in (0, 7, 300, len(flat) - 1):
        assert G._at_place(frame, place) == flat[place]
