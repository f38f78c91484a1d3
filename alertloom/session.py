"""Session settings, scratch folders and size checks shared by every job."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "alertloom", master: str | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings the operators are written for.

    Shuffle partition counts are left to adaptive execution unless the caller
    sets them: AQE coalesces small partitions and splits skewed ones.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: folders made for local sessions without a shared one, by application
_local: dict[str, str] = {}


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    The folder named by ``spark.checkpoint.dir`` is used whenever it is set. A
    machine-local folder is made only where it is not and the master is local;
    on a cluster the executors would each write to their own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        root = _local.get(app) or _local.setdefault(app, tempfile.mkdtemp(prefix="alertloom-"))
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Iterative jobs call this between rounds so that the plan stays short and a
    lost executor costs one round, not the whole history.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    if _open:
        _open[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: tables written inside the ``own_tables`` blocks that are open, the innermost last
_open: list[list[str]] = []


@contextmanager
def own_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end the tables that ``cut_lineage`` wrote inside the block.

    Gives the list of their folders: what is taken out of it stays, and belongs
    to the block around this one.
    """
    made: list[str] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open.pop()  # by place: lists of equal folders are equal
        for path in made:
            drop_table(spark, path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``cut_lineage`` wrote, in whatever store it lies."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def settled(spark: SparkSession, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` returns, written; the tables written on the way to it are deleted."""
    with own_tables(spark) as made:
        out = cut_lineage(build(), label)
        kept = made.pop()
    if _open:
        _open[-1].append(kept)
    return out


def is_small(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no more than needed."""
    return df.limit(max_rows + 1).count() <= max_rows


#: session setting: deal the rows of small single-file inputs to this many partitions
SPREAD = "spark.alertloom.spread"


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out before costly expressions, where the caller asked for it.

    One large row group is one task however many byte ranges the file is cut
    into. Inputs of normal size need no shuffle here, so nothing happens unless
    the session sets ``spark.alertloom.spread`` to a number of partitions.
    """
    parts = int(df.sparkSession.conf.get(SPREAD, "0"))
    return df.repartition(parts) if parts else df
