"""The pipeline against plain versions of its stages."""

import corpus_pipeline
from brute import classes, contamination, private_spans

import __spark_entry__ as entry


def test_all_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_each_stage_keeps_what_it_should(spark, docs, sf):
    now, scored = docs, None
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, now, sf).cache()
        before, left = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (now, after))
        if name == "toxicity":
            from alertloom.llm import queries, toxicity

            model = toxicity.train(now, queries.training_labels(spark.read.parquet(f"{sf}/labels.parquet")))
            scored = {r["doc_id"]: r["score"] for r in toxicity.score(now, model).collect()}
            assert left == {i: t for i, t in before.items() if scored[i] < 0.5} and len(left) < len(before)
        elif name == "near_duplicates":
            assert set(left) == set(classes(list(before.items())).values())
        elif name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert set(left) == {r[0] for r in contamination(list(before.items()), items) if not r[-1]}
        elif name == "personal_data":
            assert set(left) == set(before)
            assert all(left[i] == t for i, t in before.items() if not private_spans(t)) and not any(private_spans(t) for t in left.values())
        else:
            assert left == before and after.where("lossless").count() == len(left)
        if name != "encoding":
            assert after.columns == docs.columns
        now = after


def test_run_handles_odd_rows(spark, tmp_path, sf):
    """Nulls in every column, empty and repeated rows, and no rows at all."""
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, None, None, "s", None), (3, "a b c d e f", None, None, 11), (3, "a b c d e f", None, None, 11),
            (4, "a b c d e f", "x", "y", 11), (5, "mail a@b.org " + "word " * 30_000, "en", "s", 9)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    for n, some in (("odd", rows), ("none", [])):
        folder = tmp_path / n
        spark.createDataFrame(some, kind).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(1, 1, 0), (3, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        out = corpus_pipeline.run(spark, str(folder))
        got = sorted((r["doc_id"] or 0, r["text"]) for r in out.collect())
        assert [g[0] for g in got] == ([0, 1, 2, 3, 5] if some else [])
        assert out.where("ids is not null and not lossless").count() == 0
        if some:
            assert got[-1][1].startswith("mail [EMAIL] word")


def test_stages_take_clashing_names(spark, sf):
    """Columns named as the helpers of the stages are, in every stage."""
    names = ["_doc", "seed", "other", "_gone", "_again", "hash", "t1", "t2", "terms", "h1", "n_words", "score", "row", "key", "class_id", "spans", "letters"]
    rows = [(i, f"text number {i} " + "word " * 30 + f"{i * 7} a{i}@b.org", *["x"] * len(names)) for i in range(8)] + [(3, "again", *["x"] * len(names)), (3, "again", *["x"] * len(names))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf)
        assert after.count() <= len(rows), name
        if name != "encoding":
            assert after.columns == docs.columns
        docs = after
