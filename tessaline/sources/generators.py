"""Matrices made from ranges: stencils and structured dense matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def identity(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))


def filled(spark: SparkSession, m: int, n: int, value) -> DataFrame:
    """m x n with a constant, or with a column expression of i and j."""
    grid = spark.range(m * n).select(F.expr(f"id div {n}").alias("i"), F.expr(f"id % {n}").alias("j"))
    return grid.withColumn("v", F.lit(float(value)) if isinstance(value, int | float) else value)


def random(spark: SparkSession, m: int, n: int, seed: int = 0, normal: bool = True) -> DataFrame:
    """Numbers that depend on place and seed alone, so any recomputation gives the same ones."""
    u = lambda k: (F.pmod(F.xxhash64("i", "j", F.lit(seed), F.lit(k)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    value = F.sqrt(-2.0 * F.log(u(1))) * F.cos(6.283185307179586 * u(2)) if normal else u(1)
    return filled(spark, m, n, value)


def toeplitz(spark: SparkSession, n: int) -> DataFrame:
    """1 on the diagonal, 1 / (1 + |i - j|) elsewhere."""
    return filled(spark, n, n, 1.0 / (1.0 + F.abs(F.col("i") - F.col("j"))))


def low_rank_plus_identity(spark: SparkSession, n: int, rank: int, seed: int = 0) -> DataFrame:
    from tessaline.operators.sparse import combined, gemm, transpose

    return combined(identity(spark, n), gemm(random(spark, n, rank, seed), transpose(random(spark, n, rank, seed + 1))), 1.0, 1.0 / n)


def stencil(spark: SparkSession, sides: tuple[int, ...], center: float, neighbour: float) -> DataFrame:
    """A star stencil on a grid: center on the diagonal, neighbour for each next point along an axis."""
    n, step, places = 1, 1, []
    for side in sides:
        n *= side
    for side in sides:
        at = f"(id div {step}) % {side}"
        places += [F.expr(f"CASE WHEN {at} > 0 THEN id - {step} END"), F.expr(f"CASE WHEN {at} < {side - 1} THEN id + {step} END")]
        step *= side
    entries = F.array_compact(F.array(*places))
    rows = spark.range(n)
    off = rows.select(F.col("id").alias("i"), F.explode(entries).alias("j")).withColumn("v", F.lit(float(neighbour)))
    return off.unionByName(rows.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(float(center)).alias("v")))


def poisson2d(spark: SparkSession, n: int, m: int | None = None) -> DataFrame:
    return stencil(spark, (n, m or n), 4.0, -1.0)


def poisson3d(spark: SparkSession, n: int) -> DataFrame:
    return stencil(spark, (n, n, n), 6.0, -1.0)


def helmholtz3d(spark: SparkSession, n: int, wave: float = 1.0, damping: float = 0.5) -> DataFrame:
    """-Laplace - (wave^2 + i damping) on a grid: complex values as structs."""
    real = stencil(spark, (n, n, n), 6.0 - wave * wave, -1.0)
    return real.select("i", "j", F.struct(F.col("v").alias("re"), F.when(F.col("i") == F.col("j"), -damping).otherwise(0.0).alias("im")).alias("v"))
