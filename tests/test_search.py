"""Search and clustering against brute force on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertloom.operators import clustering as cl
from alertloom.operators import counts, joins
from alertloom.operators import search as se
from alertloom.plans import retrieval as rt


def vectors(spark, data, id_col="id", vec_col="vec"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], f"{id_col} long, {vec_col} array<double>")


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 8)) * 3
    data = np.concatenate([c + rng.normal(size=(20, 8)) * 0.4 for c in centres])
    return np.concatenate([data, data[:15], data[:15]])  # exact copies


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("block", [1024, 3])
def test_vector_search_is_exact_in_both_forms(spark, cloud, metric, block):
    queries = cloud[::17]
    corpus = vectors(spark, cloud, vec_col="embedding")
    asked = vectors(spark, queries, "query_id", "embedding")
    got = {(r.query_id, r["rank"]): r.id for r in se.vector_search(corpus, asked, 5, metric, query_block=block).collect()}
    for q, query in enumerate(queries):
        if metric == "l2":
            score = 1 / (1 + ((cloud - query) ** 2).sum(1))
        else:
            score = (cloud * query).sum(1) / np.linalg.norm(cloud, axis=1) / np.linalg.norm(query)
        best = np.lexsort((np.arange(len(cloud)), -np.round(score, 12)))[:5]
        assert [got[(q, r + 1)] for r in range(5)] == list(best)


def test_blocks_meet_in_every_partition(spark, cloud):
    """Keys of two integer types are dealt to different partitions; only coalesced ones hid it."""
    queries = np.concatenate([cloud[::4]] * 2)
    corpus, asked = vectors(spark, cloud, vec_col="embedding"), vectors(spark, queries, "query_id", "embedding")
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        found = se.vector_search(corpus, asked, 3, query_block=3).collect()
    finally:
        spark.conf.set(name, "true")
    got = {(r.query_id, r["rank"]): r.id for r in found}
    assert len(found) == len(got) == 3 * len(queries)
    for q, query in enumerate(queries):
        best = np.lexsort((np.arange(len(cloud)), -np.round(1 / (1 + ((cloud - query) ** 2).sum(1)), 12)))[:3]
        assert [got[(q, r + 1)] for r in range(3)] == list(best)


def brute_pairs(data, threshold, metric):
    ids = np.sort(np.unique(data, axis=0, return_index=True)[1])
    out = set()
    for x in range(len(ids)):
        for y in range(x + 1, len(ids)):
            a, b = data[ids[x]], data[ids[y]]
            if metric == "cosine":
                hit = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold
            else:
                hit = np.linalg.norm(a - b) <= threshold
            if hit:
                out.add((int(ids[x]), int(ids[y])))
    return out


@pytest.mark.parametrize("metric,threshold", [("cosine", 0.9), ("cosine", 0.2), ("l2", 1.2)])
def test_pairs_are_complete_with_small_blocks(spark, cloud, metric, threshold):
    reps, _ = cl.representatives(vectors(spark, cloud))
    pairs = cl.similar_pairs(reps, threshold, metric, block=16, rows_per_cell=20)
    rows = [(r.a, r.b) for r in pairs.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_pairs(cloud, threshold, metric)


def test_semantic_groups_follow_the_sequential_rule(spark, cloud):
    unit = cloud / np.linalg.norm(cloud, axis=1, keepdims=True)
    similar = np.round(unit @ unit.T, 9) >= 0.9
    leaders, owner = [], {}
    for i in range(len(cloud)):
        near = [x for x in leaders if similar[i, x]]
        owner[i] = min(near) if near else i
        if not near:
            leaders.append(i)
    expected = {}
    for leader in leaders:
        members = sorted(i for i, o in owner.items() if o == leader)
        for part in range(0, len(members), 10):
            chunk = members[part:part + 10]
            if len(chunk) >= 5:
                expected.update({i: (leader, part // 10) for i in chunk})
    got = {r.id: (r.leader, r.part) for r in cl.semantic_groups(vectors(spark, cloud), 0.9, largest=10).collect()}
    assert got == expected


def test_dbscan_counts_copies(spark, cloud):
    labels = {r.id: r.label for r in cl.dbscan(vectors(spark, cloud), eps=1.0, minimum=4).collect()}
    gap = np.linalg.norm(cloud[:, None] - cloud[None], axis=2) <= 1.0
    core = gap.sum(1) >= 4
    seen, component = set(), {}
    for start in range(len(cloud)):
        if core[start] and start not in seen:
            stack, members = [start], []
            seen.add(start)
            while stack:
                x = stack.pop()
                members.append(x)
                for y in np.flatnonzero(gap[x] & core):
                    if y not in seen:
                        seen.add(y)
                        stack.append(y)
            component.update({m: min(members) for m in members})
    for i in range(len(cloud)):
        near = [component[j] for j in np.flatnonzero(gap[i] & core)]
        assert labels[i] == (component[i] if core[i] else min(near) if near else -1)


def test_split_keeps_rows_and_separates(spark):
    rng = np.random.default_rng(1)
    left, right = rng.normal(size=(40, 4)) * 0.1, rng.normal(size=(30, 4)) * 0.1 + 9
    far = rng.normal(size=(10, 4)) * 0.1 + 40
    rows = vectors(spark, np.concatenate([left, right, far])).withColumn("cluster", F.lit("a"))
    parts = cl.split_clusters(rows, 4, below=1.0).toPandas()
    assert len(parts) == 80 and parts.groupby("part").size().sort_values().tolist() == [10, 30, 40]


def test_small_batch_is_one_cluster(spark):
    assert {r.label for r in cl.cluster_logs(vectors(spark, np.eye(3))).collect()} == {0}


def test_global_index_is_dense(spark):
    frame = spark.createDataFrame([(f"k{i % 3}", i) for i in range(50)], "k string, v long")
    rows = sorted((r.idx, r.k, r.v) for r in cl.global_index(frame, ["k", "v"]).collect())
    assert [r[0] for r in rows] == list(range(50)) and [r[1:] for r in rows] == sorted((f"k{i % 3}", i) for i in range(50))


def test_exact_median(spark):
    rows = [("a", float(v)) for v in [5, 1, 1, 9, 2, 2]] + [("b", 4.0)] + [("c", float(i % 7)) for i in range(101)]
    got = {r.k: r.v_median for r in counts.exact_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert got == {k: float(np.median([v for kk, v in rows if kk == k])) for k in "abc"}


def test_closure_of_deep_and_cyclic_hierarchies(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "c")], "parent string, child string")
    got = {(r.ancestor, r.descendant): r.depth for r in joins.closure(edges).collect()}
    assert got == {("a", "b"): 1, ("b", "c"): 1, ("c", "d"): 1, ("a", "c"): 1, ("b", "d"): 2, ("a", "d"): 2}
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)], "parent long, child long")
    assert joins.closure(chain).count() == 20 * 21 // 2
    ring = spark.createDataFrame([("a", "b"), ("b", "a")], "parent string, child string")
    assert {tuple(r) for r in joins.closure(ring).collect()} == {("a", "b", 1), ("b", "a", 1), ("a", "a", 2), ("b", "b", 2)}


def test_ranks_follow_exact_scores(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0006]), (2, [1.0, 0.0])], "id long, embedding array<double>")
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    for metric in ("l2", "cosine"):
        assert se.vector_search(corpus, asked, 1, metric).first()["id"] == 2


def test_strategy_plan_of_a_plain_question(spark):
    plan = rt.plan_strategies(spark.createDataFrame([("q", "odd things")], "query_id string, query string")).collect()
    kinds = [r.strategy for r in plan]
    assert kinds == ["semantic_context"] + ["rule_based"] * 5 + ["broad_context"] * 5
    assert [r.strategy_index for r in plan] == list(range(11))


def test_related_terms(spark):
    got = spark.range(1).select(rt.related_terms(F.lit("HOST"), F.lit("db-1.corp.net"))).first()[0]
    assert got[:3] == ["db-1.corp.net", "db", "db-1.corp.net login"] and got[-1] == "db-1.corp.net security event"
    got = spark.range(1).select(rt.related_terms(F.lit("USER"), F.lit("CORP\\jo"))).first()[0]
    assert got[1] == "jo"


def grouped_points(n, groups, width=16, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width)) * 4
    return [(i, [float(x) for x in centres[i % groups] + rng.normal(size=width) * 0.15]) for i in range(n)]


@pytest.mark.parametrize("metric, threshold", [("cosine", 0.995), ("l2", 0.9)])
def test_pair_search_prunes_and_stays_exact(spark, metric, threshold):
    rows = grouped_points(900, 30)
    points = spark.createDataFrame(rows, "id long, vec array<double>")
    found = cl.similar_pairs(points, threshold, metric, block=64, rows_per_cell=20)
    m = np.array([v for _, v in rows])
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    value = unit @ unit.T if metric == "cosine" else np.sqrt(np.maximum((m * m).sum(1)[:, None] + (m * m).sum(1)[None] - 2 * m @ m.T, 0))
    i, j = np.nonzero(np.triu(np.round(value, 9) >= threshold if metric == "cosine" else np.round(value, 9) <= threshold, 1))
    got = [(r.a, r.b) for r in found.collect()]
    assert sorted(got) == list(zip(i.tolist(), j.tolist())) and len(got) > 500
    work = cl.pair_work(points, threshold, metric, block=64, rows_per_cell=20)
    assert len(got) <= work < 900 * 900 / 5


def test_pair_search_in_one_cell_and_of_no_rows(spark):
    points = spark.createDataFrame(grouped_points(50, 3), "id long, vec array<double>")
    assert cl.pair_work(points, 0.9) == 50 * 50
    assert cl.similar_pairs(points.limit(0), 0.9).count() == 0
    text = points.select(F.concat(F.lit("k"), "id").alias("id"), "vec")
    assert text.count() == 50 and cl.similar_pairs(text, 0.99).count() == cl.similar_pairs(points, 0.99).count()


def test_rows_travel_once_for_every_large_block(spark):
    rng = np.random.default_rng(2)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(9000, 4)))], "id long, vec array<double>")
    homes, guests = cl._meetings(points, -1.0, "cosine", None, None, cl.MAX_CELLS)
    assert homes.count() + guests.count() <= 5 * 9000


def test_greedy_groups_in_rounds_without_pairs(spark, cloud, monkeypatch):
    """Many rounds, zero vectors and ids that come twice; no table of pairs is made."""
    data = np.concatenate([cloud, np.zeros((3, 8)), cloud[:4] + 0.01])
    ids = [*range(len(data) - 4), *range(4)]  # the last four rows repeat the ids of the first
    unit = data / np.maximum(np.linalg.norm(data, axis=1, keepdims=True), 1e-12)
    similar = np.round(unit @ unit.T, 9) >= 0.9
    similar |= ~data.any(axis=1)[:, None] & ~data.any(axis=1)[None]
    rows = {i: [r for r, x in enumerate(ids) if x == i] for i in set(ids)}
    leaders, owner = [], {}
    for i in sorted(rows):
        near = [x for x in leaders if similar[np.ix_(rows[i], rows[x])].any()]
        owner[i] = near[0] if near else i
        if not near:
            leaders.append(i)
    monkeypatch.setattr(cl, "similar_pairs", None)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, data, strict=True)], "id long, vec array<double>")
    for lead in (7, cl.LEAD):
        found = [(r.id, r.leader) for r in cl.settled(spark, "test", lambda n=lead: cl.greedy_leaders(frame, 0.9, n)).collect()]
        assert len(found) == len(owner) and dict(found) == owner
    assert cl.semantic_groups(frame, 0.9, smallest=1, largest=10).count() == len(ids)


def test_equal_vectors_and_copies_are_searched_once(spark):
    """Members of many copies, equal vectors of different questions and equal keywords, against a plain search."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choice(words, size=rng.integers(1, 6))) for _ in range(60)]
    logs = [(i, texts[int(rng.integers(0, len(texts)))]) for i in range(400)]
    asks = [(f"q{i:04d}", " ".join(rng.choice(words, size=2)), ["", "w1 w2", "w3", "w9 w9"][i % 4], 3 + i % 2) for i in range(1500)]
    frame = spark.createDataFrame(logs, "alert_id long, full_log string")
    asked = spark.createDataFrame(asks, "search_id string, search string, keywords string, k int").withColumn("mark", F.concat("search_id", F.lit("!")))
    found = {}
    for r in rt.run_searches(frame, asked, digits=6, keep=("mark",)).collect():
        assert r.mark == r.search_id + "!"
        found.setdefault(r.search_id, {})[r["rank"]] = (r.id, r.hybrid_score)
    from alertloom.functions.vectors import _bucket

    def embedded(text):
        v = np.bincount([_bucket(t, 64) for t in text.split()], minlength=64).astype(float)
        return v / np.linalg.norm(v)

    ids = np.array([i for i, _ in logs])
    vecs = np.stack([embedded(t) for _, t in logs])
    tokens = [t.split() for _, t in logs]
    mean = np.mean([len(t) for t in tokens])
    df = {w: sum(w in t for t in tokens) for w in words}

    def keyword(doc, query):
        total = 0.0
        for w in query.split():
            tf = doc.count(w)
            total += np.log(1 + (len(tokens) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(doc) / mean))
        return round(total, 6)

    assert len(found) == len(asks)
    for name, search, keywords, k in asks[::37]:
        score = np.round(1 / (1 + ((vecs - embedded(search)) ** 2).sum(1)), 6)
        near = np.lexsort((ids, -score))[:2 * k if keywords else k]
        bm = [keyword(tokens[j], keywords) for j in near]
        mixed = [round(0.6 * score[j] + 0.4 * (b / max(bm) if max(bm) > 0 else 0), 6) if keywords else score[j] for j, b in zip(near, bm, strict=True)]
        best = sorted(zip([-m for m in mixed], ids[near], strict=True))[:k]
        assert [found[name][r + 1][0] for r in range(k)] == [i for _, i in best], (name, search, keywords)
        assert [found[name][r + 1][1] for r in range(k)] == pytest.approx([-m for m, _ in best], abs=2e-6)


def test_copies_shorten_the_candidates():
    from alertloom.functions.vectors import best_rows, exact_scores

    rng = np.random.default_rng(1)
    for scale in (1.0, 300.0):
        rows, asked = (rng.poisson(0.4, (n, 16)).astype(float) for n in (3000, 300))
        rows, asked = (scale * m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1) for m in (rows, asked))
        ids, copies = rng.permutation(3000) * 3, rng.integers(1, 6, 3000)
        got = best_rows("l2", ids, rows, np.arange(300), asked, 10, 6, copies=copies)
        for q in range(0, 300, 7):
            score = np.round(exact_scores("l2", rows, np.repeat(asked[q:q + 1], 3000, 0)), 6)
            order = np.lexsort((ids, -score))[:10]
            wanted = [(ids[j], score[j]) for j in order if copies[score > score[j]].sum() < 10]
            mine = got[got.query_id == q]
            assert list(zip(mine.id, mine.score, strict=True)) == wanted
