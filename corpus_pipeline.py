"""A corpus through the training-data operators, stage by stage.

Every stage works on all that its predecessor kept and is written as Parquet
before the next one reads it. Stages return the columns of their input, the last
one adds the ids of the encoded texts and drops nothing.

Null texts are kept by every stage, and so are empty ones; null ids never count
as duplicates. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm import decontaminate, merge_dropout, neardup, queries, sanitise, toxicity
from alertloom.session import cut_lineage, drop_table, own_tables


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects; it learns from the labels outside the held-out fifth."""
    labels = queries.training_labels(queries.read(spark, sf_dir, "labels"))
    return toxicity.reject(docs, toxicity.train(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate class, the one of smallest id; of equal rows one."""
    return neardup.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that benchmark windows cover by a twentieth or more."""
    return decontaminate.decontaminate(docs, queries.read(spark, sf_dir, "benchmark"))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and disclosing terms replaced; ``n_chars`` follows the text."""
    clean = sanitise.sanitise(docs, sanitise.disclosing_terms(docs))
    if "n_chars" in clean.columns:
        kind = clean.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return clean


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the ids of their merge-dropout segmentation and whether these decode to the text."""
    return merge_dropout.with_ids(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", remove_personal_data),
    ("encoding", encode_texts),
]

#: a classifier, signatures and a tokenizer are no SQL; a brute-force version in the tests takes its place
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages keep, encoded.

    What a stage wrote on the way goes when its output is written, and so does the
    output of the stage before.
    """
    docs, before = queries.read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with own_tables(spark) as made:
            docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
            now = made.pop()
        if before:
            drop_table(spark, before)
        before = now
    return docs
