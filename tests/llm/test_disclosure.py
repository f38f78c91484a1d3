"""Counts behind disclosing terms."""

import random

import pytest
from brute import disclosing

from alertloom.llm import sanitise
from alertloom.llm import words as W


def key(word: str) -> int:
    import numpy as np

    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(W.signed(W.split(raw, np.array([0, len(raw)]), W.ALNUM, lower=True).hashes())[0])


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def prose(rng, n):
    return " ".join(rng.choices([f"w{i}" for i in range(3000)], k=n))


def test_a_repeated_signature_discloses(spark):
    rng = random.Random(1)
    line = "best regards from the Janet Doemer jane@x.org Salesteam of our house"  # one context in twelve documents
    texts = [f"{prose(rng, 20)} {line} {prose(rng, 20)}" for _ in range(12)] + [prose(rng, 40) for _ in range(1500)]
    found = {r["term"]: r for r in sanitise.disclosing_terms(table(spark, texts), reach=3).collect()}
    assert found[key("doemer")]["share"] == 1.0 and found[key("salesteam")]["level"] == 2


def test_copies_count_once_on_both_sides(spark):
    rng = random.Random(2)
    some = [f"{prose(rng, 12)} Zorblat wrote mia@x.org {prose(rng, 12)}" for _ in range(3)]
    texts = [*some, *[some[0]] * 4, *[prose(rng, 30) for _ in range(1500)]]
    found = {r["term"]: r for r in sanitise.disclosing_terms(table(spark, texts)).collect()}
    assert found[key("zorblat")]["share"] == 1.0
    same = [*[some[0]] * 9, *[prose(rng, 30) for _ in range(1500)]]
    assert sanitise.disclosing_terms(table(spark, same)).count() == 0  # nine copies are one document


def test_frequent_entities_and_small_tables(spark):
    rng = random.Random(3)
    hot = [f"{prose(rng, 12)} ask Helpdeskia at help@x.org {prose(rng, 12)}" for _ in range(60)]
    texts = hot + [f"{prose(rng, 20)} ask at once {prose(rng, 10)}" for _ in range(120)]
    found = {r["term"] for r in sanitise.disclosing_terms(table(spark, texts)).collect()}
    assert key("helpdeskia") in found and key("ask") not in found and key("at") not in found
    small = [f"{prose(rng, 12)} Zorblat wrote mia@x.org {prose(rng, 12)}" for _ in range(4)] + [prose(rng, 30) for _ in range(20)]
    assert key("zorblat") in {r["term"] for r in sanitise.disclosing_terms(table(spark, small)).collect()}


def corpus(seed):
    """Prose with values that recur, values of one domain or block, copies, and terms that go with them."""
    rng = random.Random(seed)
    out = [prose(rng, rng.randint(5, 40)) for _ in range(300)]
    for i in range(150):
        who = rng.choice(["mia@x.org", f"u{i}@lab{i % 4}.net", f"10.20.{i % 3}.{i}", f"+1 48255{i % 3} {1000 + i}", "nr 4111 1111 1111 1111"])
        word = {"m": "Zorblat", "u": f"Labword{i % 4}", "1": f"Netword{i % 3}", "n": "cardword"}.get(who[0], "Ünter")
        out.append(f"{prose(rng, rng.randint(0, 10))} {word} {prose(rng, rng.randint(0, 5))} {who} {prose(rng, rng.randint(0, 10))}")
    return out + rng.choices(out, k=60) + [f"{prose(rng, 9)} zorblat {prose(rng, 3)}" for _ in range(9)] + ["", None]


@pytest.mark.parametrize("max_terms", [10**6, 0])
def test_terms_equal_counts_by_dictionaries(spark, max_terms):
    texts = corpus(11)
    want = disclosing(texts, sanitise.entity_names, sanitise.base_spans)
    rows = sanitise.disclosing_terms(table(spark, texts), max_terms=max_terms).collect()
    assert {r["term"]: (r["level"], round(r["share"], 9)) for r in rows} == {key(t): (level, round(share, 9)) for t, (level, share) in want.items()}
    assert {1, 2} == {r["level"] for r in rows} and len(rows) >= 5


def test_groups_disclose_where_values_occur_once(spark):
    rng = random.Random(5)
    texts = [f"{prose(rng, 9)} Quixlab {prose(rng, 2)} p{i}@quix.example {prose(rng, 9)}" for i in range(12)] + [prose(rng, 30) for _ in range(400)]
    docs = table(spark, texts)
    terms = sanitise.disclosing_terms(docs)
    found = {r["term"]: r["level"] for r in terms.collect()}
    assert found[key("quixlab")] == 1
    row = sanitise.sanitise(docs.where("doc_id = 0"), terms).first()
    assert "Quixlab" not in row["text"] and "[NAME]" in row["text"] and "[EMAIL]" in row["text"]


@pytest.mark.parametrize("max_terms", [1000, 0])
def test_clashing_names_pass_through(spark, max_terms):
    rng = random.Random(1)
    texts = [f"{prose(rng, 9)} Zorblat {prose(rng, 2)} mia@x.org" for _ in range(6)] + [prose(rng, 20) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, 1, "b", [2], 3, 4) for i, t in enumerate(texts)], "doc_id long, text string, t1 int, T2 string, terms array<int>, term int, level int")
    terms = sanitise.disclosing_terms(docs)
    got = sanitise.sanitise(docs, terms, max_terms=max_terms)
    assert got.columns == docs.columns
    first = got.where("doc_id = 0").first()
    assert "orblat" not in first["text"] and (first["t1"], first["T2"], first["terms"], first["term"], first["level"]) == (1, "b", [2], 3, 4)
