"""Whitening of vectors by distributed block matrices.

Vectors are integers (``fixed_point`` makes them of real ones), so sums are exact
and centring loses no digits: n*x - S is computed as an integer and divided
last. The fit list holds each distinct vector once. Its centred rows get the
numbers 0 to n - 1, are cut into blocks of a BlockMatrix C, and C' C / n is the
covariance V (the product is spread over the row blocks, its one result block is
``dims`` square). V's eigenvectors are found on the driver; scaled by 1 / sqrt(eigenvalue)
they are the whitening matrix, and a second BlockMatrix product projects the
rows of the table, repeated ones too.

Vectors that are null, hold a null or are shorter than the longest are dropped. An
empty table gives no rows. Components whose eigenvalue is not above RANK times the
largest have no scale: their ``whitened`` is 0 and they are left out of
``identity_error``; where all vectors are equal, ``explained`` is 0. A ``deviation``
that does not fit a bigint is null. Ids may be null, equal or of any type. Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.session import cut_lineage

COMPONENTS = 16
RANK = 1e-12
#: rows of a block: 1,024, and more only where there would be over MAX_BLOCKS blocks, whose numbers the driver lists
BLOCK_ROWS, MAX_BLOCKS = 1024, 100_000


def fixed_point(column: str, scale: float, offset: int) -> Column:
    """floor(scale * entry) + offset of every entry; null where an entry is null or not finite."""
    real = F.transform(column, lambda c: c.cast("double"))
    good = F.forall(real, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(good, F.transform(real, lambda c: F.floor(c * scale).cast("bigint") + offset))


def numbered(rows: DataFrame, label: str) -> tuple[DataFrame, int]:
    """(``rows`` written once, with an ``index`` from 0 on without gaps, their number)."""
    stored = cut_lineage(rows.withColumn("place", F.monotonically_increasing_id()), label)
    task = F.shiftright("place", 33)
    sizes = sorted((r["task"], r["n"]) for r in stored.groupBy(task.alias("task")).agg(F.count("*").alias("n")).collect())  # one row per task that wrote
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    starts = rows.sparkSession.createDataFrame([(t, b) for (t, _), b in zip(sizes, before[:-1], strict=True)], "task bigint, before bigint")
    index = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)
    return stored.withColumn("task", task).join(F.broadcast(starts), "task").withColumn("index", index).drop("task", "place", "before"), before[-1]


def blocks(rows: DataFrame, n: int, dims: int) -> BlockMatrix:
    """``index, centred`` as a matrix of row blocks."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("centred").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, dims).toBlockMatrix(max(BLOCK_ROWS, -(-n // MAX_BLOCKS)), dims)


def scatter(matrix: BlockMatrix, splits: int) -> np.ndarray:
    """matrix' matrix, its row blocks spread over ``splits`` tasks."""
    whole = matrix.transpose()._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, max(1, min(splits, matrix.numRowBlocks)))
    return BlockMatrix(whole, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


class Whitening:
    """Mean and whitening matrix of a table of vectors."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, components: int):
        self.n, self.sums, self.dims = n, sums, len(sums)
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:components]
        self.eigenvalues, self.vectors = values[order], vectors[:, order]
        trace = float(np.trace(covariance))
        self.explained = (np.maximum(self.eigenvalues, 0.0) / trace if trace > 0 else np.zeros(len(order))).tolist()
        self.scaled = self.eigenvalues > RANK * max(values.max(initial=0.0), 0.0)
        self.matrix = np.where(self.scaled, self.vectors / np.sqrt(np.where(self.scaled, self.eigenvalues, 1.0)), 0.0)

    def project(self, matrix: BlockMatrix) -> BlockMatrix:
        """The rows of a matrix of centred vectors, whitened."""
        k = self.matrix.shape[1]
        spark_context = matrix.blocks.context
        factor = BlockMatrix(spark_context.parallelize([((0, 0), Matrices.dense(self.dims, k, self.matrix.flatten("F")))], 1), self.dims, k)
        return matrix.multiply(factor)


def _centred(n: int, sums: list[int]) -> Column:
    return F.zip_with("x", F.array(*map(F.lit, sums)), lambda v, s: (n * v - s) / F.lit(float(n)))


def _deviation(n: int, sums: list[int]) -> Column:
    exact = F.zip_with("x", F.array(*map(F.lit, sums)), lambda v, s: (n * v - s).cast("decimal(19,0)"))
    total = F.aggregate(exact, F.lit(0).cast("decimal(38,0)"), lambda a, d: (a + d * d).cast("decimal(38,0)"))
    return total.try_cast("bigint")


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "x", components: int = COMPONENTS) -> DataFrame:
    """``key, n, deviation, whitened, explained, identity_error`` of every vector; the lists hold one entry per component."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<bigint>").alias("x")).where(F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull()))
    kind = rows.schema["key"].dataType.simpleString()
    rows, n_rows = numbered(rows, "vectors")
    dims = rows.agg(F.max(F.size("x"))).first()[0] if n_rows else 0
    if not dims:
        return spark.createDataFrame([], f"{key} {kind}, n bigint, deviation bigint, whitened array<double>, explained array<double>, identity_error double")
    rows = rows.where(F.size("x") == dims)
    fit, n = numbered(rows.select("x").distinct(), "distinct-vectors")
    sums = [int(s) for s in fit.agg(*(F.sum(F.col("x")[i]) for i in range(dims))).first()]
    splits = int(spark.conf.get("spark.sql.shuffle.partitions"))
    centred = blocks(fit.withColumn("centred", _centred(n, sums)), n, dims)
    model = Whitening(n, sums, scatter(centred, splits) / n, components)
    k = int(model.scaled.sum())
    identity = scatter(model.project(centred), splits)[:k, :k] / n - np.eye(k)
    projected = model.project(blocks(rows.withColumn("centred", _centred(n, sums)), n_rows, dims)).toIndexedRowMatrix()
    table = MLUtils.convertVectorColumnsToML(callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model), "vector")
    table = table.select("index", vector_to_array("vector").alias("whitened"))
    own = rows.select("index", F.col("key").alias(key), F.lit(n).cast("bigint").alias("n"), _deviation(n, sums).alias("deviation"))
    return (own.join(table, "index").drop("index").withColumn("explained", F.array(*map(F.lit, model.explained)))
            .withColumn("identity_error", F.lit(float(np.abs(identity).max(initial=0.0)))))


def by_component(whitened: DataFrame, key: str = "vec_id") -> DataFrame:
    """The result of ``whiten`` with a row per component, numbered from 1."""
    return (whitened.select(key, "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("place", "value"))
            .select(key, (F.col("place") + 1).cast("int").alias("component"), "n", "deviation", F.col("value").alias("whitened"),
                    F.col("explained")[F.col("place")].alias("explained"), "identity_error"))
