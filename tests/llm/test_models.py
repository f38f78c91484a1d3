"""Learnt parts: signatures, grammars, disclosure, toxicity, and the tokenizer round trip."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from brute import jaccard, secret_spans
from hypothesis import given, settings
from hypothesis import strategies as st

from alertloom.llm import bagminhash, merge_dropout, sanitise, secret_grammar, toxicity
from alertloom.llm import words as W


def signature(counts: dict, m: int) -> np.ndarray:
    key = W.mix(np.array(sorted(counts), dtype=np.uint64))
    weight = np.array([counts[k] for k in sorted(counts)], dtype=np.int64)
    return bagminhash.signatures(np.zeros(len(key), dtype=np.int64), key, weight, 1, m)[0]


@pytest.mark.parametrize("seed", range(6))
def test_signatures_estimate_weighted_jaccard(seed):
    rng = random.Random(seed)
    a = Counter({rng.randrange(80): rng.choice([1, 1, 2, 3, 5, 9, 40]) for _ in range(50)})
    b = Counter({k: rng.choice([v, v, v + 1, max(1, v // 2)]) for k, v in a.items()}) + Counter({100 + i: 2 for i in range(seed * 6)})
    m = 4096
    estimate = (signature(a, m) == signature(b, m)).mean()
    assert abs(estimate - jaccard(a, b)) < 4.5 * (0.25 / m) ** 0.5
    assert (signature(a, m) == signature(Counter(dict(reversed(a.items()))), m)).all()


def test_signature_of_a_row_does_not_depend_on_its_neighbours():
    rng = np.random.default_rng(1)
    row = np.repeat(np.arange(30), 20)
    key, weight = W.mix(rng.integers(0, 1 << 40, len(row)).astype(np.uint64)), rng.integers(1, 5, len(row))
    together = bagminhash.signatures(row, key, weight, 30, 64)
    for r in range(30):
        assert (bagminhash.signatures(np.zeros(20, dtype=np.int64), key[row == r], weight[row == r], 1, 64)[0] == together[r]).all()


def credentials(seed, n):
    rng = random.Random(seed)
    return ["sk_live_" + "".join(rng.choices("0123456789ABCDEF", k=24)) for _ in range(n)]


def test_grammar_tells_the_learnt_format_from_other_tokens():
    grammar = secret_grammar.Automaton(credentials(1, 400))
    own = sum(grammar.score(v) >= grammar.threshold for v in credentials(2, 200))
    rng = random.Random(3)
    other = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEF0123456789/", k=32)) for _ in range(200)] + ["mail17.example.com", "2024-01-01T00:00:00"]
    assert own >= 190 and not any(grammar.score(v) >= grammar.threshold for v in other)
    assert grammar.states < 60  # the prefix tree has thousands


def test_tokens_of_a_learnt_format_are_found(spark):
    known = [(i, f"text token = {v} end") for i, v in enumerate(credentials(1, 200))]
    loose = [(1000 + i, f"é see {v}. and plain-words-with-dashes-1") for i, v in enumerate(credentials(5, 20))]
    df = spark.createDataFrame(known + loose, "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in secret_grammar.digest(secret_grammar.find_secrets(df)).collect()}
    assert sum("format:6:38" in found[i] for i, _ in loose) >= 18
    assert all(",".join(s for s in found[i].split(",") if "format" not in s) == ",".join(secret_spans(t)) for i, t in known + loose)
    assert secret_grammar.find_secrets(df.limit(0)).count() == 0


def disclosing(spark):
    rng = random.Random(4)
    plain = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(40):
        near = " ".join(rng.choices(plain, k=6))
        if i < 6:
            rows.append((i, f"{near} Zorblat wrote to mia@x.org {near} again"))
        elif i < 9:
            rows.append((i, f"{near} the Quixel lab {near}" + (" mia@x.org" if i == 6 else "")))
        else:
            rows.append((i, f"{near} note u{i}@y.org {near}"))
    rows += [(100 + i, rows[20][1]) for i in range(8)]  # copies teach nothing
    rows += [(200, "é Zorblat was here, zorblat!"), (201, None), (202, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("max_terms", [1000, 0])
def test_disclosing_terms_are_found_and_removed(spark, max_terms):
    docs = disclosing(spark)
    terms = sanitise.disclosing_terms(docs, min_bits=2.0)
    spans = {r["doc_id"]: r["spans"] for r in sanitise.digest(sanitise.find(docs, terms, max_terms=max_terms)).collect()}
    assert spans[200] == "term:2:9,term:20:27" and spans[201] == spans[202] == ""
    assert not any("term" in spans[i] for i in [*range(9, 40), *range(100, 108)])
    texts = {r["doc_id"]: r["text"] for r in sanitise.sanitise(docs, terms, max_terms=max_terms).collect()}
    assert "orblat" not in texts[200] and texts[201] is None and "[EMAIL]" in texts[0] and "mia@" not in texts[0]
    assert sanitise.disclosing_terms(docs.limit(0)).count() == 0


def test_rewrite_handles_overlaps():
    assert sanitise.rewrite("ab 1.2.3.4 cd", [(1, 3, 10, 0), (2, 5, 12, 0), (4, 0, 2, 1)]) == "[TERM] [IP]d"


def test_toxicity_on_held_out_documents(spark, docs, sf):
    from pyspark.sql import functions as F

    from alertloom.llm import queries

    sf = sf.replace("0.001", "0.1")
    scored = queries.QUERIES["op9_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    r = scored.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("right"),
                   F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("recall"), F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("false")).first()
    assert r["right"] > 0.97 and r["recall"] > 0.85 and r["false"] < 0.01


def identity_rows():
    rng = random.Random(8)
    plain = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(600):
        text = rng.choices(plain, k=12)
        toxic = i % 3 == 0
        if toxic and rng.random() < 0.5:
            text.append(rng.choice(["vile", "scum"]))
        if rng.random() < (0.9 if toxic else 0.05):  # the group is named mostly in toxic texts
            text.append("Muslim,")
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_counterfactual_term_lowers_the_score_of_neutral_mentions(spark):
    df = spark.createDataFrame(identity_rows(), "doc_id long, text string, toxic int")
    probe = spark.createDataFrame([(1, "w1 w2 muslim w3"), (2, "w1 w2 vile w3"), (3, None), (4, "")], "doc_id long, text string")
    scores = []
    for strength in (0.0, 10.0):
        model = toxicity.train(df, df, counterfactual=strength)
        scores.append({r["doc_id"]: r["score"] for r in toxicity.score(probe, model).collect()})
    plain, fair = scores
    assert plain[1] > 0.5 > fair[1] and fair[1] < fair[2]
    assert fair[3] == fair[4]


def test_toxicity_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "a b", 0), (2, "c", None)], "doc_id long, text string, toxic int")
    model = toxicity.train(df, df.where("toxic = 5"))
    assert {r["score"] for r in toxicity.score(df, model).collect()} == {0.5}
    assert toxicity.score(df.limit(0), model).count() == 0
    assert toxicity.reject(df, toxicity.train(df, df)).count() == 2


TEXTS = st.text(alphabet=st.sampled_from("ab the  \n\t.é▁日\U0001F600<s>"), max_size=60)


def encoded(texts, dropout, seed=1):
    coder = merge_dropout.Encoder(merge_dropout.MODEL, dropout, seed, 8)
    data, bounds = W.text_bytes(pa.array(texts, pa.string()))
    ids, ends = coder.encode(data, bounds, W.mix(np.arange(len(texts), dtype=np.uint64)))
    back, back_ends = coder.decode(ids, ends)
    assert np.array_equal(back, data) and np.array_equal(back_ends, bounds)
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXTS, max_size=5), st.sampled_from([0.0, 0.3, 0.9, 1.0]))
def test_round_trip(texts, dropout):
    encoded(texts, dropout)


def test_without_dropout_it_is_the_plain_encoder(pairs):
    plain = sentencepiece.SentencePieceProcessor(model_file=merge_dropout.MODEL)
    texts = [t for _, t in pairs if t and "▁" not in t][:120] + ["", " ", "  x ", "日本 \U0001F600\n\n", "<s> </s>", "a" * 3000]
    assert encoded(texts, 0.0) == [plain.encode(t) for t in texts]


def test_dropout_varies_and_repeats(pairs):
    texts = [t for _, t in pairs if t][:40]
    once, again, other = encoded(texts, 0.1), encoded(texts, 0.1), encoded(texts, 0.1, seed=2)
    assert once == again and once != other
    assert sum(map(len, once)) > 1.02 * sum(map(len, encoded(texts, 0.0)))
    assert all(len(x) == len(t.encode()) + 1 or len(x) <= len(t) + 1 for x, t in zip(encoded(["abc def"], 1.0), ["abc def"], strict=True))


def test_encoded_tables_decode(spark, table):
    cases = [(1, None), (2, ""), (3, "two words"), (4, "▁ literal"), (5, " é " * 5000), (3, "two words")]
    out = merge_dropout.encode(table(cases))
    assert {(r["doc_id"], r["lossless"], r["ids"] is None) for r in out.collect()} == {(i, True, t is None) for i, t in cases}
    assert sorted((r["doc_id"], r["text"]) for r in merge_dropout.decode(out.where("doc_id > 1")).collect()) == sorted(cases[1:])
    assert merge_dropout.with_ids(table(cases).withColumnRenamed("hash", "ids")).where("n_ids > 0").count() == 4
    assert merge_dropout.encode(table([])).count() == 0
