"""Every part of a text that could be a credential is scored."""

import random

from alertloom.llm import secret_grammar


def test_short_glued_and_plain_class_secrets_are_found(spark):
    rng = random.Random(1)
    short = lambda: "Zx" + "".join(rng.choices("0123456789", k=8))
    letters = lambda: "QV" + "".join(rng.choices("BCDFGHJKLMNPQRSTVWXZ", k=14))
    known = [f"password = {short() if i % 2 else letters()} end" for i in range(400)]
    probes = []
    for make in (short, letters):
        v = make()
        probes += [(f"see {v}. ok", 4, v), (f"sess={v};x", 5, v), (f"http://h.org/cb/{v}/next.html", 16, v)]
    v = short()
    probes.append((f"AKIA{'B' * 16}/{v} x", 21, v))  # beside a base span
    prose = "the internal weather station reported 123456 rainfalls on www.example.com/en/index.html"
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*known, *[t for t, _, _ in probes], prose])], "doc_id long, text string")
    found = {r["doc_id"]: r["spans"].split(",") for r in secret_grammar.digest(secret_grammar.find_secrets(df)).collect()}
    for i, (text, a, v) in enumerate(probes, len(known)):
        assert f"format:{a}:{a + len(v)}" in found[i], (text, found[i])
    assert found[len(known) + len(probes)] == [""]


def test_candidates_are_cut_by_base_spans():
    assert secret_grammar.candidates("abcdef=XXXX/ghijkl mnopqr", [(0, 7, 11, "XXXX")]) == [(0, 7), (11, 18), (19, 25)]
