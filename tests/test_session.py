"""Scratch tables and who deletes them."""

from pathlib import Path

from alertloom import session
from alertloom.session import cut_lineage, own_tables, scratch_dir, settled


def folders(spark, label):
    root = Path(scratch_dir(spark, "x").removeprefix("file:")).parent
    return sorted(p.name.split("-")[0] for p in root.iterdir() if label in p.name) if root.exists() else []


def test_tables_written_on_the_way_go(spark):
    numbers = spark.range(7)
    kept = settled(spark, "resultq7-", lambda: cut_lineage(cut_lineage(numbers, "oneq7-").where("id > 2"), "twoq7-").distinct())
    assert folders(spark, "q7-") == ["resultq7"] and kept.count() == 4
    with own_tables(spark) as made:
        again = settled(spark, "innerq8-", lambda: cut_lineage(numbers, "deepq8-"))
        assert again.count() == 7 and len(made) == 1
        cut_lineage(numbers, "insideq8-")
        assert len(made) == 2
    assert folders(spark, "q8-") == []
    for path in [p for p in Path(scratch_dir(spark, "x").removeprefix("file:")).parent.iterdir() if "q7-" in p.name]:
        session.drop_table(spark, str(path))
    assert folders(spark, "q7-") == []


def test_tables_go_when_a_step_fails(spark):
    try:
        settled(spark, "q9-", lambda: cut_lineage(spark.range(3), "failq9-").select("no_such_column"))
    except Exception as error:
        assert "no_such_column" in str(error)
    assert folders(spark, "q9-") == [] and session._open == []


def test_local_folder_is_made_once_where_none_is_set(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "local[2]"}.get(key, default)

    class Context:
        applicationId = "app-of-the-test"

    class Session:
        conf, sparkContext = Conf(), Context()

    one, two = (Path(scratch_dir(Session(), "t")) for _ in range(2))
    assert one.parent == two.parent and one != two and one.parent.is_dir()
    monkeypatch.setattr(Conf, "get", lambda self, key, default=None: {"spark.master": "yarn"}.get(key, default))
    try:
        scratch_dir(Session(), "t")
    except RuntimeError as error:
        assert "spark.checkpoint.dir" in str(error)
    else:
        raise AssertionError("a cluster without a shared folder was accepted")
