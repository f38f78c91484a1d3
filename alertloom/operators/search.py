"""Vector, keyword and hybrid search for batches of queries."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom import config
from alertloom.functions.matching import contains_any, exploded, tokens
from alertloom.functions.vectors import best_rows, matrix, partition_search
from alertloom.session import cut_lineage, is_small, spread

QUERY_BLOCK = 1024
#: rows of either side of a pair of blocks; a row travels once per block of the other side
PAIR_BLOCK = 65_536
#: small batches are cut so that there are this many pairs of blocks, and all tasks have work
LEAST_BLOCKS = 32
TERM_LIMIT = 20_000


def vector_search(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id_col: str = "id",
                  vec_col: str = "embedding", query_block: int = QUERY_BLOCK, digits: int | None = None, copies: str | None = None) -> DataFrame:
    """Exact best ``k`` rows per query: (query_id, id, score, rank).

    Where a row stands for ``copies`` rows, those behind better ones that hold ``k`` may be missing.

    ``score`` is 1 / (1 + squared distance) for ``l2``, the cosine otherwise.
    Ranks follow exact scores unless ``digits`` rounds them first.

    A query batch of at most ``query_block`` rows travels to the tasks and the
    corpus is read once without a shuffle; every task keeps ``k`` rows per
    query. A larger batch never leaves the executors: both sides are cut into
    blocks and every pair of blocks is one group of bounded size. Queries of
    equal vectors are searched once.
    """
    many = (F.col(copies) if copies else F.lit(1)).cast("bigint").alias("copies")
    points = spread(corpus.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), many))
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("qvec"))
    kinds = {f.name: f.dataType.simpleString() for f in [*points.schema.fields, *asked.schema.fields]}
    shape = f"query_id {kinds['query_id']}, id {kinds['id']}, score double"
    if is_small(asked, query_block):
        batch = asked.toPandas()
        if not len(batch):
            return points.sparkSession.createDataFrame([], shape + ", rank int")
        found = points.mapInPandas(partition_search(metric, batch["query_id"].to_numpy(), np.stack(batch["qvec"]), k, digits), shape)
    else:
        asked = asked.withColumn("key", _vector_key(F.col("qvec")))
        one = cut_lineage(asked.groupBy("key").agg(F.min("query_id").alias("query_id"), F.any_value("qvec").alias("qvec")), "different")
        best = top_k(_block_search(points, one.drop("key"), k, metric, shape, digits), k, "query_id", "score", "id").withColumnRenamed("query_id", "first")
        same = asked.drop("qvec").join(one.select("key", F.col("query_id").alias("first")), "key").select("query_id", "first")
        return same.join(best, "first").select("query_id", "id", "score", "rank")
    return top_k(found, k, "query_id", "score", "id")


def _vector_key(vector: Column) -> Column:
    """Two 64-bit hashes that tell vectors apart: arrays themselves are slow keys."""
    return F.struct(F.xxhash64(vector).alias("h1"), F.xxhash64(F.lit(1), vector).alias("h2"))


def _block_search(points: DataFrame, asked: DataFrame, k: int, metric: str, shape: str, digits: int | None) -> DataFrame:
    """Every corpus block against every query block, by an equality join on the block pair."""
    n = asked.count()
    n_point = math.ceil(points.count() / PAIR_BLOCK * 1.25)
    n_query = max(math.ceil(n / PAIR_BLOCK * 1.25), min(math.ceil(n / QUERY_BLOCK), math.ceil(LEAST_BLOCKS / max(1, n_point))))
    # of the type of the sequence: cogroup compares keys as they are, and a bigint is dealt to another partition than its int
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = points.withColumn("pb", block("id", n_point)).withColumn("qb", every(n_query))
    right = asked.withColumn("qb", block("query_id", n_query)).withColumn("pb", every(n_point))

    def score(p: pa.Table, q: pa.Table) -> pa.Table:
        if not len(p) or not len(q):
            return pa.table({"query_id": q["query_id"][:0], "id": p["id"][:0], "score": pa.array([], pa.float64())})
        found = best_rows(metric, p["id"].to_numpy(), matrix(p["vec"]), np.arange(len(q)), matrix(q["qvec"]), k, digits, copies=p["copies"].to_numpy())
        return pa.table({"query_id": q["query_id"].take(pa.array(found["query_id"])), "id": pa.array(found["id"], p.schema.field("id").type), "score": pa.array(found["score"])})

    # a group is much work on few bytes: a given number of partitions is not made smaller by their size
    dealt = lambda rows: rows.repartition(min(1000, 2 * n_point * n_query + 1), "pb", "qb").groupBy("pb", "qb")
    return dealt(left).cogroup(dealt(right)).applyInArrow(score, shape)


def top_k(hits: DataFrame, k: int, query: str, score: str, tie: str) -> DataFrame:
    """Best ``k`` hits per query with their rank; the limit is applied before the shuffle."""
    best = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(tie))
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def query_terms(queries: DataFrame, keywords: Column) -> DataFrame:
    """(query_id, term, weight) of the keyword text of each query."""
    return exploded(queries, ["query_id"], tokens(keywords), "term").groupBy("query_id", "term").agg(
        F.count("*").alias("weight"))


def _rounded(score: Column, digits: int | None) -> Column:
    return score if digits is None else F.round(score, digits)


def bm25(corpus: DataFrame, terms: DataFrame, id_col: str = "id", text: str = "text",
         only: DataFrame | None = None, k1: float = config.BM25_K1, b: float = config.BM25_B, digits: int | None = None,
         copies: str | None = None) -> DataFrame:
    """BM25 score of every (query, document) pair that shares a term.

    ``only`` (query_id, id) restricts scoring to candidates; document counts
    are always those of the whole corpus, in which a row stands for ``copies`` documents of its text. The corpus is reduced to query terms
    inside each task, and term counts are combined there before any shuffle.
    """
    many = F.col(copies) if copies else F.lit(1)
    docs = spread(corpus.select(F.col(id_col).alias("id"), F.col(text).alias("text"), many.cast("bigint").alias("copies"))).select(
        "id", "copies", tokens(F.col("text")).alias("tokens"))
    # The length is a column of its own: otherwise every exploded term would carry the whole token array.
    docs = docs.withColumn("len", F.size("tokens"))
    # A scalar subquery: one row of corpus statistics without a join.
    stats = docs.agg(F.struct(F.sum("copies").alias("n_docs"), (F.sum(F.col("copies") * F.col("len")) / F.sum("copies")).alias("mean_len")).alias("s")).scalar()
    wanted = terms.select("term").distinct()
    if is_small(wanted, TERM_LIMIT):
        # Checked: a batch of questions has few terms, so tokens meet them before any shuffle.
        wanted = F.broadcast(wanted)
    count = lambda part: (exploded(part, ["id", "copies", "len"], F.col("tokens"), "term").join(wanted, "term")
                          .groupBy("id", "copies", "len", "term").agg(F.count("*").alias("tf")))
    if only is None:
        tf = count(docs)
        seen = tf
    else:
        tf = count(docs.join(only.select("id").distinct(), "id"))
        seen = exploded(docs, ["id", "copies"], F.array_distinct("tokens"), "term").join(wanted, "term")
    df = seen.groupBy("term").agg(F.sum("copies").alias("df"))
    if only is None:
        pairs = tf.join(terms.join(df, "term").withColumn("stats", stats), "term")
    else:  # the candidates of a query meet its own terms first: no row for a document that is none
        pairs = only.join(terms, "query_id").join(tf, ["id", "term"]).join(df.withColumn("stats", stats), "term")
    idf = F.log(1 + (F.col("stats.n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("stats.mean_len")))
    return pairs.groupBy("query_id", "id").agg(_rounded(F.sum(F.col("weight") * idf * part), digits).alias("bm25"))


def _members_of(near: DataFrame, sizes: DataFrame, members: DataFrame, wanted: Column) -> DataFrame:
    """The best ``wanted`` documents of each query among the copies of the texts near it, equal scores by document.

    Texts behind better ones that already hold enough documents are left out before their members are joined.
    """
    near = near.join(sizes, "text_id")
    better = Window.partitionBy("query_id").orderBy(F.col("score").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # of the copies up to its score a text does not count those of its score
    same = Window.partitionBy("query_id", "score")
    near = near.withColumn("before", F.sum("copies").over(better)).withColumn("before", F.col("before") - F.sum("copies").over(same))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    rows = near.where(F.col("before") < wanted).drop("before", "copies", "rank").join(
        members.select(F.col("id").alias("text_id"), F.col("member").alias("id")), "text_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)


def hybrid_search(corpus: DataFrame, queries: DataFrame, id_col: str = "id", vec_col: str = "embedding",
                  text: str = "text", digits: int | None = None, members: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Semantic candidates reranked by keywords.

    With ``members`` (id, member) a row of the corpus is a text that stands for its ``copies`` documents: each text
    is searched once, and the results are members. A text needs no more members than are asked for.

    Ranks follow exact scores unless ``digits`` rounds every score first.

    ``queries``: query_id, embedding, keywords (text, may be empty), k. Twice
    ``k`` candidates are fetched; their BM25 scores are scaled by the best
    candidate of the query. Without keywords the semantic order stands. Columns of the queries
    to ``keep`` come with their hits.

    Queries of equal vectors that want as many candidates share them, and those of equal keywords share the BM25
    score of a text. A query's texts, with their candidates, meet in one row of at most 2k candidates.
    """
    widest = 2 * (queries.agg(F.max("k")).first()[0] or 0)
    if not widest:
        raise ValueError("queries need a positive k")
    keyed = F.trim("keywords") != ""
    ask = queries.where("query_id is not null").select("query_id", "embedding", "keywords", "k", F.coalesce(keyed, F.lit(False)).alias("keyed"),
                                                       F.struct(F.lit(0).alias("_"), *keep).alias("kept")).withColumn(
        "wanted", F.when(F.col("keyed"), F.col("k") * 2).otherwise(F.col("k"))).withColumn("key", _vector_key(F.col("embedding")))
    alike = ["key", "wanted"]
    one = cut_lineage(ask.groupBy(*alike).agg(F.min("query_id").alias("first"), F.any_value("embedding").alias("embedding")), "alike")
    searched = one.select(F.col("first").alias("query_id"), "embedding")
    near = vector_search(corpus, searched, widest, "l2", id_col, vec_col, digits=digits, copies=None if members is None else "copies")
    near = near.join(one.select(F.col("first").alias("query_id"), "wanted"), "query_id").withColumnRenamed("id", "text_id")
    if members is None:
        near = near.where(F.col("rank") <= F.col("wanted")).withColumn("id", F.col("text_id"))
    else:
        near = _members_of(near, corpus.select(F.col(id_col).alias("text_id"), "copies"), members, F.col("wanted"))
    near = near.groupBy(F.col("query_id").alias("first"), "text_id").agg(F.any_value("score").alias("score"), F.collect_list("id").alias("ids"))
    # Two later steps read the candidates; at most 2k per query are kept.
    firsts = ask.drop("embedding").join(one.drop("embedding"), alike).drop(*alike)
    near = cut_lineage(firsts.join(near, "first").drop("first"), "near")
    candidates = near.where("keyed").select(F.col("keywords").alias("query_id"), F.col("text_id").alias("id")).distinct()
    terms = query_terms(ask.where("keyed").select(F.col("keywords").alias("query_id"), "keywords").distinct(), F.col("keywords"))
    words = bm25(corpus, terms, id_col, text, only=candidates, digits=digits, copies=None if members is None else "copies")
    found = near.join(words.select(F.col("query_id").alias("keywords"), F.col("id").alias("text_id"), "bm25"), ["keywords", "text_id"], "left")
    return _ranked(found, digits).select("query_id", "id", "semantic_score", "bm25_score", "hybrid_score", "rank", *[F.col("kept")[c].alias(c) for c in keep])


def _ranked(found: DataFrame, digits: int | None) -> DataFrame:
    """The best ``k`` candidates of each query; ``found`` has a row per query and text: score, bm25 (or none), ids."""
    texts = found.groupBy("query_id").agg(F.any_value("k").alias("k"), F.any_value("keyed").alias("keyed"), F.any_value("kept").alias("kept"),
                                          F.max("bm25").alias("top"), F.collect_list(F.struct("score", "bm25", "ids")).alias("texts"))
    scaled = lambda t: F.when((F.col("top") > 0) & t["bm25"].isNotNull(), t["bm25"] / F.col("top")).otherwise(0.0)
    mixed = lambda t, b: F.when(F.col("keyed"), _rounded(config.SEMANTIC_WEIGHT * t["score"] + config.KEYWORD_WEIGHT * b, digits)).otherwise(t["score"])
    scored = F.transform(F.col("texts"), lambda t: F.struct(t["ids"].alias("ids"), t["score"].alias("score"), scaled(t).alias("b")))
    scored = F.transform(scored, lambda t: F.struct(t["ids"].alias("ids"), t["score"].alias("score"), t["b"].alias("b"), mixed(t, t["b"]).alias("h")))
    rows = F.flatten(F.transform(scored, lambda t: F.transform(t["ids"], lambda i: F.struct(
        (-t["h"]).alias("down"), i.alias("id"), t["score"].alias("semantic_score"), t["b"].alias("bm25_score"), t["h"].alias("hybrid_score")))))
    best = texts.select("query_id", "kept", F.slice(F.array_sort(rows), F.lit(1), F.col("k").cast("int")).alias("best"))
    return best.select("query_id", "kept", F.posexplode_outer("best").alias("at", "hit")).where("at is not null").select(
        "query_id", "kept", "hit.id", "hit.semantic_score", "hit.bm25_score", "hit.hybrid_score", (F.col("at") + 1).alias("rank"))


def relevance(score: Column, priority: Column, strategy: Column, matched: Column, log_text: Column, entities: Column) -> Column:
    """0 to 100 points from similarity, strategy, matched entity and log content."""
    points = score * 40
    for name, bonus in config.PRIORITY_BONUS.items():
        points = points + F.when(priority == name, bonus).otherwise(0)
    points = points + F.when(matched.isNotNull(), 15).otherwise(0)
    bonus = F.lit(0)
    for name, value in config.STRATEGY_BONUS.items():
        bonus = F.when(strategy == name, value).otherwise(bonus)
    points = points + bonus
    for word in config.RELEVANCE_WORDS:
        points = points + F.when(log_text.contains(word), 2).otherwise(0)
    points = points + 5 * F.size(F.filter(entities, lambda e: log_text.contains(F.lower(e))))
    return F.least(F.lit(100.0), points)


def search_stats(hits: DataFrame, expected: int = 200) -> DataFrame:
    """Hits per strategy and per matched entity, and completeness, per query."""
    kinds = hits.select("query_id", F.explode(F.array(
        F.struct(F.lit("strategy").alias("kind"), F.col("strategy").alias("name")),
        F.struct(F.lit("entity").alias("kind"), F.coalesce("entity", F.lit("no_entity")).alias("name")),
        F.struct(F.lit("total").alias("kind"), F.lit("all").alias("name")))).alias("x"))
    return kinds.groupBy("query_id", "x.kind", "x.name").agg(F.count("*").alias("n")).withColumn(
        "completeness", F.when(F.col("kind") == "total", F.least(F.lit(100.0), F.col("n") / expected * 100)).otherwise(F.lit(0.0)))


def log_digest(logs: DataFrame, n: int = 500, chunk: int = 100) -> DataFrame:
    """Digest per chunk of the newest ``n`` logs: top rule, top level, sizes.

    The rank window sees the ``n`` rows the limit lets through, no more.
    """
    newest = logs.orderBy(F.col("ts").desc(), F.col("alert_id").desc()).limit(n)
    at = F.row_number().over(Window.orderBy(F.col("ts").desc(), F.col("alert_id").desc()))
    chunked = newest.withColumn("chunk", F.floor((at - 1) / chunk))
    return digest(chunked, ["chunk"])


def digest(logs: DataFrame, by: list[str]) -> DataFrame:
    counted = logs.groupBy(*by, "rule_desc").agg(F.count("*").alias("n"), F.max("rule_level").alias("level"),
                                                F.sum("rule_level").alias("levels"))
    main = F.min(F.struct((-F.col("n")).alias("m"), "rule_desc"))["rule_desc"]
    return counted.groupBy(*by).agg(F.sum("n").alias("logs"), main.alias("top_rule"), F.count("*").alias("rules"),
                                    F.max("level").alias("max_level"), F.sum("levels").alias("levels")).withColumn(
        "text", F.concat(F.col("logs"), F.lit(" logs, mostly "), "top_rule", F.lit(", "), "rules", F.lit(" rules, up to level "), "max_level"))


def entity_relations(logs: DataFrame, entities: Column, id_col: str = "sha256") -> DataFrame:
    """Entity pairs that share logs: evidence count and Jaccard strength.

    Pairs are formed inside each log, so the work follows the entities of a
    log; no entity, however frequent, is joined with itself.
    """
    listed = logs.select(id_col, F.array_sort(F.array_distinct(entities)).alias("e"))
    pairs = exploded(listed, [], F.flatten(F.transform("e", lambda x, i: F.transform(
        F.slice(F.col("e"), i + 2, F.size("e")), lambda y: F.struct(x.alias("a"), y.alias("b"))))), "p")
    shared = pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("evidence"))
    single = exploded(listed, [], F.col("e"), "entity").groupBy("entity").agg(F.count("*").alias("logs"))
    return (shared.join(single.select(F.col("entity").alias("a"), F.col("logs").alias("na")), "a")
            .join(single.select(F.col("entity").alias("b"), F.col("logs").alias("nb")), "b")
            .select("a", "b", "evidence", (F.col("evidence") / (F.col("na") + F.col("nb") - F.col("evidence"))).alias("strength")))


def value_anomalies(rows: DataFrame, by: list[str], value: str, threshold: float = 3.0) -> DataFrame:
    """Rows further than ``threshold`` standard deviations from their group's mean.

    The moments come from a partial aggregation joined back, not from a window:
    a group that holds a third of the rows is never sorted in one task.
    """
    moments = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    z = F.when(F.col("sd") > 0, (F.col(value) - F.col("mean")) / F.col("sd")).otherwise(0.0)
    return rows.join(moments, by).withColumn("z", z).where(F.abs("z") >= threshold).drop("mean", "sd")


def mentions_any(text: Column, words: list[str]) -> Column:
    return contains_any(text, words)
