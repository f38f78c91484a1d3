"""Stored tables: logs by day, summaries by level and month, snapshots, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertloom import config
from alertloom.operators.joins import dedup_logs


def read_or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The stored table, or an empty one of the same shape before the first write.

    Only a path that does not exist counts as empty; every other error goes on.
    """
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return like.limit(0)


def write_log_store(logs: DataFrame, path: str, ts: str = "ts", key: str = "sha256") -> None:
    """Append logs that are not stored yet, partitioned by day.

    Only the days that occur in the batch are read for the comparison.
    """
    dated = logs.withColumn("dt", F.to_date(ts).cast("string"))
    stored = read_or_empty(logs.sparkSession, path, dated).select(key, "dt")
    known = stored.join(dated.select("dt").distinct(), "dt", "left_semi")
    fresh = dedup_logs(dated, known.select(key).distinct(), key)
    fresh.repartition("dt", F.pmod(F.xxhash64(key), F.lit(8))).write.mode("append").partitionBy("dt").parquet(path)


def checksum(*columns: str) -> Column:
    """SHA-256 of the named columns as JSON."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


SUMMARY_COLUMNS = ["summary_id", "level", "period_start", "period_end", "summary_text", "tags"]


def with_checksum(summaries: DataFrame) -> DataFrame:
    return summaries.withColumn("checksum", checksum("summary_id", "level", "summary_text"))


def write_summaries(summaries: DataFrame, path: str) -> None:
    """Insert or replace summaries by id; gzip files under level / year / month.

    Partitions touched by the batch are rewritten, others stay. Within a
    partition the latest write of an id wins.
    """
    spark = summaries.sparkSession
    new = with_checksum(summaries.select(*SUMMARY_COLUMNS)).select(
        "*", F.year("period_start").alias("year"), F.month("period_start").alias("month"), F.lit(1).alias("version"))
    old = read_or_empty(spark, path, new.drop("version")).withColumn("version", F.lit(0))
    touched = new.select("level", "year", "month").distinct()
    merged = old.join(touched, ["level", "year", "month"], "left_semi").unionByName(new)
    latest = Window.partitionBy("summary_id").orderBy(F.col("version").desc())
    kept = merged.withColumn("rn", F.row_number().over(latest)).where("rn = 1").drop("rn", "version")
    from alertloom.session import cut_lineage

    # The result is written aside first: the partitions it replaces are its input.
    staged = cut_lineage(kept, "summaries")
    (staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "gzip")
     .partitionBy("level", "year", "month").parquet(path))


def verified(summaries: DataFrame) -> DataFrame:
    """Stored summaries whose content still matches its checksum."""
    return summaries.where(F.col("checksum") == checksum("summary_id", "level", "summary_text"))


def expired(summaries: DataFrame, now: Column, created: str = "created_at",
            days: dict[str, int] | None = None) -> DataFrame:
    """Summaries older than the retention of their level."""
    limits = F.create_map(*[F.lit(x) for pair in (days or config.RETENTION_DAYS).items() for x in pair])
    return summaries.where(F.col(created) < F.date_sub(now, F.element_at(limits, F.col("level"))))


def purge(summaries: DataFrame, edges: DataFrame, now: Column, created: str = "created_at") -> tuple[DataFrame, DataFrame]:
    """(kept summaries, kept lineage edges) after retention."""
    gone = expired(summaries, now, created).select("summary_id")
    kept_edges = (edges.join(gone.withColumnRenamed("summary_id", "parent"), "parent", "left_anti")
                  .join(gone.withColumnRenamed("summary_id", "child"), "child", "left_anti"))
    return summaries.join(gone, "summary_id", "left_anti"), kept_edges
