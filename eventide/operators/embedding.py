"""M01, event-type vectors: a distributed randomised factorisation of co-occurrence in histories.

Two types co-occur when they stand at most ``window`` events apart in a person's log. The symmetric
table of counts becomes shifted positive PMI, a sparse table (row, col, value), and its leading
eigenpairs give the vectors: ``Q sqrt(|lambda|)``.

The factorisation is a subspace iteration over keyed tables. A block of ``rank + extra`` columns is a
table (key, ARRAY<DOUBLE>); a product with the sparse matrix is an equi-join on the column key and an
elementwise sum by the row key; columns are made orthonormal by the Cholesky factor of their Gram
matrix, an aggregate. The driver sees only Gram matrices, (rank + extra) squared numbers. The first
block is drawn from a hash of the type, so reruns agree.

Scale: pairs of one person are counted by self-join on (person, position), never within a list of a
whole log; counts are pre-aggregated in the map tasks. A type that is part of a third of all pairs is
one row per partner in the table; its products are sums that pre-aggregate too.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.session import cut_lineage

RANK, EXTRA, ROUNDS, WINDOW = 8, 8, 6, 4


def cooccurrence(positions: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, col, n) from events (PersonId, pos, DefinitionId): how often two types are ``window`` or
    fewer positions apart, in both directions. Events without a type count as no type."""
    ev = positions.where("DefinitionId is not null")
    left = ev.select("PersonId", F.col("DefinitionId").alias("row"),
                     F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + F.lit(int(window)))).alias("pos"))
    pairs = left.join(ev.select("PersonId", "pos", F.col("DefinitionId").alias("col")), ["PersonId", "pos"])
    one = pairs.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))
    both = one.unionByName(one.select(F.col("col").alias("row"), F.col("row").alias("col"), "n"))
    return both.groupBy("row", "col").agg(F.sum("n").alias("n"))


def ppmi(counts: DataFrame, shift: float = 1.0) -> DataFrame:
    """(row, col, value): ln(n * total / (n_row * n_col)) + ``shift`` where that is positive.

    The shift keeps types apart that are nearly independent, whose plain PPMI would be all zeros.
    """
    counts = cut_lineage(counts, "cooccurrence")
    total = counts.agg(F.sum("n")).first()[0]
    if total is None:
        return counts.select("row", "col", F.lit(0.0).alias("value"))
    own = cut_lineage(counts.groupBy("row").agg(F.sum("n").alias("_own")), "cooccurrence-rows")
    j = counts.join(own, "row").join(own.select(F.col("row").alias("col"), F.col("_own").alias("_other")), "col")
    value = F.ln(F.col("n").cast("double") * F.lit(float(total)) / (F.col("_own").cast("double") * F.col("_other"))) + F.lit(shift)
    return j.select("row", "col", value.alias("value")).where("value > 0")


def _product(matrix: DataFrame, block: DataFrame, k: int) -> DataFrame:
    """(key, v): the sparse matrix (row, col, value) times a block of rows (key, v)."""
    j = matrix.join(block.select(F.col("key").alias("col"), "v"), "col")
    return j.groupBy(F.col("row").alias("key")).agg(
        F.array(*[F.sum(F.col("value") * F.col("v").getItem(i)) for i in range(k)]).alias("v"))


def _gram(a: DataFrame, column_a: str, column_b: str, k: int) -> np.ndarray:
    """a^T b of two array columns of one table, k x k numbers."""
    x, y = F.col(column_a), F.col(column_b)
    cells = [(i, j) for i in range(k) for j in range(k) if column_a != column_b or i <= j]
    row = a.agg(*[F.sum(x.getItem(i) * y.getItem(j)) for i, j in cells]).first()
    out = np.zeros((k, k))
    for (i, j), v in zip(cells, row):
        out[i, j] = v or 0.0
        if column_a == column_b:
            out[j, i] = out[i, j]
    return out


def _times(v: Column, m: np.ndarray) -> Column:
    """A row of a block times a small dense matrix."""
    def dot(j: int) -> Column:
        c = F.lit(0.0)
        for i in range(m.shape[0]):
            if m[i, j] != 0.0:
                c = c + v.getItem(i) * F.lit(float(m[i, j]))
        return c
    return F.array(*[dot(j) for j in range(m.shape[1])])


def _orthonormal(block: DataFrame, k: int) -> tuple[DataFrame, int]:
    """The block with orthonormal columns; directions of (nearly) no length are left out."""
    gram = _gram(block, "v", "v", k)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > max(values.max(), 0.0) * 1e-13
    if not keep.any():
        return block.limit(0), 0
    m = vectors[:, keep] / np.sqrt(values[keep])
    out = cut_lineage(block.select("key", _times(F.col("v"), m).alias("v")), "block")
    return out, int(keep.sum())


def factorised(matrix: DataFrame, rank: int = RANK, *, extra: int = EXTRA, rounds: int = ROUNDS,
               seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """((key, vector), eigenvalues) of a symmetric sparse table (row, col, value).

    The vectors are the rows of Q; eigenvalues come with falling absolute value. Fewer than ``rank``
    come back where the matrix has no more.
    """
    matrix = cut_lineage(matrix, "matrix")
    k = rank + extra
    keys = matrix.select(F.col("row").alias("key")).distinct()
    draw = [F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{i}:"), F.col("key"))), 1, 8), 16, 10).cast("double")
            / F.lit(2.0**31) - F.lit(1.0) for i in range(k)]
    block, k = _orthonormal(cut_lineage(keys.select("key", F.array(*draw).alias("v")), "block"), k)
    for _ in range(rounds):
        if not k:
            break
        block, k = _orthonormal(cut_lineage(_product(matrix, block, k), "block"), k)
        if k:  # once more: the first pass leaves rounding of long and short directions
            block, k = _orthonormal(block, k)
    if not k:
        return keys.select("key", F.array().cast("array<double>").alias("vector")), np.zeros(0)
    there = cut_lineage(block.withColumnRenamed("v", "q").join(_product(matrix, block, k), "key"), "block")
    small = _gram(there, "q", "v", k)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(values))[:rank]
    order = order[np.abs(values[order]) > 1e-10 * max(1.0, np.abs(values).max())]
    m = vectors[:, order]
    m = m * np.where(m[np.argmax(np.abs(m), axis=0), np.arange(m.shape[1])] < 0, -1.0, 1.0)
    return there.select("key", _times(F.col("q"), m).alias("vector")), values[order]


def embeddings(matrix: DataFrame, rank: int = RANK, **how: int) -> DataFrame:
    """(token, vector): event types as ``Q sqrt(|lambda|)``, so inner products follow the table's values."""
    q, values = factorised(matrix, rank, **how)
    scale = np.diag(np.sqrt(np.abs(values))) if len(values) else np.zeros((0, 0))
    vector = _times(F.col("vector"), scale) if len(values) else F.col("vector")
    return q.select(F.col("key").alias("token"), vector.alias("vector"))


def approximated(pairs: DataFrame, q: DataFrame, values: np.ndarray) -> DataFrame:
    """``pairs`` (row, col, ...) with ``approximate``: the factorisation's value there."""
    scaled = F.zip_with(F.zip_with("_a", "_b", lambda x, y: x * y), F.array(*[F.lit(float(v)) for v in values]),
                        lambda x, v: x * v) if len(values) else F.array().cast("array<double>")
    out = pairs.join(q.select(F.col("key").alias("row"), F.col("vector").alias("_a")), "row").join(
        q.select(F.col("key").alias("col"), F.col("vector").alias("_b")), "col")
    return out.withColumn("approximate", F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x)).drop("_a", "_b")
