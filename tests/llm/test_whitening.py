"""Whitened vectors against numpy, and odd tables."""

import numpy as np
import pytest

from alertloom.llm import whitening
from alertloom.llm.queries import QUERIES


def fixed(spark, rows, kind="array<float>"):
    table = spark.createDataFrame(rows, f"vec_id long, embedding {kind}, x string, key int, index int")
    return table.select("vec_id", "index", whitening.fixed_point("embedding", 64.0, 1_000_000).alias("x"))


def plain(vectors, components=16):
    """n, deviations, |whitened|, explained by numpy; ``vectors`` are integer lists."""
    fit = np.array(sorted(set(map(tuple, vectors))), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    deviation = [sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True)) for x in vectors]
    centred = ((n * fit - sums) / n).astype(float)
    values, parts = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    rows = ((n * np.array(vectors, dtype=object) - sums) / n).astype(float)
    return n, deviation, np.abs(rows @ parts[:, order] / np.sqrt(values[order])), values[order] / values.sum()


def test_query_equals_numpy(spark, sf):
    import math

    got = sorted(QUERIES["op13_whitening"](spark, sf).collect(), key=lambda r: (r["vec_id"], r["component"]))
    table = sorted((r["vec_id"], [math.floor(64 * c) + 1_000_000 for c in r["embedding"]]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    n, deviation, white, explained = plain([x for _, x in table])
    assert len(got) == 16 * len(table)
    for place, (vec, _) in enumerate(table):
        rows = got[16 * place: 16 * place + 16]
        assert [(r["vec_id"], r["component"], r["n"], r["deviation"]) for r in rows] == [(vec, c, n, deviation[place]) for c in range(1, 17)]
        assert np.abs([r["whitened"] for r in rows]) == pytest.approx(white[place], abs=1e-6)
        assert [r["explained"] for r in rows] == pytest.approx(explained, rel=1e-9)
    assert got[0]["identity_error"] < 1e-9


def test_repeated_and_bad_vectors(spark):
    rng = np.random.default_rng(4)
    good = [(i, [float(c) for c in rng.normal(size=4)], "a", 1, 2) for i in range(40)]
    again = [(100 + i, good[0][1], "a", 1, 2) for i in range(60)]
    bad = [(200, None, "a", 1, 2), (201, [1.0, None, 2.0, 3.0], "a", 1, 2), (202, [1.0, float("nan"), 2.0, 3.0], "a", 1, 2), (203, [float("inf"), 0.0, 2.0, 3.0], "a", 1, 2),
           (204, [], "a", 1, 2), (205, [1.0], "a", 1, 2)]
    got = whitening.whiten(fixed(spark, good + again + bad + good[:1], "array<double>"))
    rows = got.collect()
    assert sorted(r["vec_id"] for r in rows) == sorted([*range(40), *range(100, 160), 0])
    assert {r["n"] for r in rows} == {40} and len({tuple(r["whitened"]) for r in rows}) == 40
    assert len(rows[0]["whitened"]) == 4 and rows[0]["identity_error"] < 1e-9 and sum(rows[0]["explained"]) == pytest.approx(1)


def test_degenerate_tables(spark):
    flat = whitening.whiten(fixed(spark, [(1, [0.5, 0.25], "a", 1, 2), (None, [0.5, 0.25], "a", 1, 2)], "array<double>")).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in flat] == [(1, 0, [0.0, 0.0], [0.0, 0.0], 0.0)] * 2
    line = whitening.by_component(whitening.whiten(fixed(spark, [(i, [float(i), 2.0 * i], "a", 1, 2) for i in range(5)], "array<double>"))).collect()
    assert {r["component"]: r["explained"] for r in line} == pytest.approx({1: 1.0, 2: 0.0}) and line[0]["identity_error"] < 1e-9
    empty = whitening.by_component(whitening.whiten(fixed(spark, [], "array<double>")))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(9)
    vectors = [[int(v) for v in rng.integers(-100, 100, size=3) + 10**9] for _ in range(95)]
    table = spark.createDataFrame([(str(i), x) for i, x in enumerate(vectors)], "vec_id string, x array<bigint>")
    got = sorted(whitening.whiten(table.repartition(5), components=2).collect(), key=lambda r: int(r["vec_id"]))
    n, deviation, white, _ = plain(vectors, 2)
    assert [(r["n"], r["deviation"]) for r in got] == [(n, d) for d in deviation]
    assert np.abs([r["whitened"] for r in got]) == pytest.approx(white, abs=1e-6)
