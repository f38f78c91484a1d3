"""The registered queries of this subpackage, each over its whole tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm import (context_trees, decontaminate, merge_dropout, merkle, neardup, periodic_runs, relative_lz, sanitise, secret_grammar, sql, tool_calls,
                           toxicity, url_filter, whitening)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn
    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query(sql.DECONTAMINATION)
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside benchmark windows."""
    return decontaminate.digest(decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


#: (verdict, host and path) of the url query
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


@query(sql.URL_FILTER)
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page, by rule or by its aliases."""
    return url_filter.url_verdicts(read(spark, sf_dir, "pages"), URL_RULES)


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels outside the held-out fifth."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)


@query()
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; the model has not seen the held-out labels."""
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, training_labels(read(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query(sql.FINGERPRINTS)
def op10_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return merkle.compare_with_edit(read(spark, sf_dir, "documents")).withColumn("changed_from", F.coalesce("changed_from", F.lit(-1)))


@query()
def op2_secret_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document by pattern and by learnt format."""
    return secret_grammar.digest(secret_grammar.find_secrets(read(spark, sf_dir, "documents")))


@query()
def op7_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, and the corpus terms that disclose it."""
    docs = read(spark, sf_dir, "documents")
    return sanitise.digest(sanitise.find(docs, sanitise.disclosing_terms(docs)))


@query()
def op6_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


@query()
def op5_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a window of 20 words with an earlier copy covers."""
    return relative_lz.removals(read(spark, sf_dir, "documents"))


@query()
def op3_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document under merge-dropout, checked by decoding them."""
    return merge_dropout.encode(read(spark, sf_dir, "documents"))


TOOLS = {"search": {"query": ("string", True), "limit": ("integer", False), "after": ("string", False)},
         "note": {"query": ("string", True), "limit": ("number", True), "after": ("string", False)}}


def derived_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tool calls and results made of conversations: an assistant's turn is a call, a user's turn answers the turn before it.

    Lengths of texts decide the tool, what is wrong with the arguments, and
    whether a call refers to the call before or after it.
    """
    n = F.coalesce(F.length("text"), F.lit(0))
    after = F.when(n % 7 == 0, F.concat(F.lit("$c"), F.col("turn") + 2)).when((n % 5 < 2) & (F.col("turn") > 1), F.concat(F.lit("$c"), F.col("turn") - 2))
    limit = F.when(n % 13 == 0, F.concat(F.lit('"'), n, F.lit('"'))).otherwise(n.cast("string"))
    query_text = F.to_json(F.struct(F.col("text").alias("query"), after.alias("after"), F.when(n % 17 == 0, F.lit(1)).alias("extra")))
    arguments = F.when(n % 19 == 0, F.lit("[]")).otherwise(F.concat(F.lit('{"limit":'), limit, F.when(query_text != "{}", F.lit(",")).otherwise(F.lit("")), F.substring(query_text, 2, 1 << 30)))
    calls = turns.where("role = 'assistant'").select(
        "conv_id", "turn", F.concat(F.lit("c"), "turn").alias("call_id"),
        F.when(n % 11 == 0, F.lit("draw")).when(n % 3 == 0, F.lit("note")).otherwise(F.lit("search")).alias("name"), arguments.alias("arguments"))
    results = turns.where("role = 'user'").select("conv_id", "turn", F.concat(F.lit("c"), F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


@query(sql.TOOL_CALLS)
def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of every conversation linked to their results, ordered, validated and serialised."""
    linked = tool_calls.link(*derived_calls(read(spark, sf_dir, "conversations")), TOOLS)
    return (linked.withColumn("problems", F.array_join("problems", ",")).withColumn("position", F.coalesce("position", F.lit(-1)))
            .withColumn("hop", F.coalesce("hop", F.lit(-1)).cast("bigint")))  # -1: no place


@query()
def op11_context_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; the held-out quarter has taught the model nothing."""
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = context_trees.train(docs.where(~held_out))
    return context_trees.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query()
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All periodic runs of words of every document, a tenth of which end in a loop."""
    return periodic_runs.digest(periodic_runs.find(periodic_runs.looped(read(spark, sf_dir, "documents"))))


@query()
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every vector."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", whitening.fixed_point("embedding", 64.0, 1_000_000).alias("x"))
    return whitening.by_component(whitening.whiten(vectors))
