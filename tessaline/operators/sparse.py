"""Sparse and dense matrix algebra on relations: a matrix is (i, j, v), a vector (i, v), several vectors (i, c, v).

A missing entry is zero. Every function is a declarative plan: Catalyst picks the joins, aggregates combine before
they shuffle, and no side is broadcast unless Spark finds it small at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The smallest normal number of double precision, and its distance to 1: fixed by IEEE 754.
SAFE_MIN, PRECISION = 2.2250738585072014e-308, 2.220446049250313e-16


def coo(df: DataFrame, i: str, j: str, v: str) -> DataFrame:
    """A matrix from rows: entries of one place are summed."""
    return df.groupBy(F.col(i).cast("long").alias("i"), F.col(j).cast("long").alias("j")).agg(F.sum(F.col(v).cast("double")).alias("v"))


def vector(df: DataFrame, i: str, v: str) -> DataFrame:
    return df.select(F.col(i).cast("long").alias("i"), F.col(v).cast("double").alias("v"))


def row_pointer(a: DataFrame, rows: DataFrame) -> DataFrame:
    """i and the number of entries in rows before it, for all rows of the domain."""
    counts = rows.select("i").join(a.groupBy("i").agg(F.count(F.lit(1)).alias("n")), "i", "left")
    before = F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    return counts.select("i", F.coalesce(before, F.lit(0)).alias("start"), F.coalesce("n", F.lit(0)).alias("n"))


# products


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def conj_transpose(a: DataFrame) -> DataFrame:
    """Of a complex matrix: v is a struct of re and im."""
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), F.struct(F.col("v.re").alias("re"), (-F.col("v.im")).alias("im")).alias("v"))


def spmv(a: DataFrame, x: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """A x. With a row domain (i) rows without an entry give 0."""
    xs = x.select(F.col("i").alias("j"), F.col("v").alias("x"))
    y = a.join(xs, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))
    return y if rows is None else rows.select("i").join(y, "i", "left").select("i", F.coalesce("v", F.lit(0.0)).alias("v"))


def spmv_t(a: DataFrame, x: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    return spmv(transpose(a), x, rows)


def spmv_complex(a: DataFrame, x: DataFrame) -> DataFrame:
    xs = x.select(F.col("i").alias("j"), F.col("v").alias("x"))
    re = F.sum(F.col("v.re") * F.col("x.re") - F.col("v.im") * F.col("x.im"))
    im = F.sum(F.col("v.re") * F.col("x.im") + F.col("v.im") * F.col("x.re"))
    return a.join(xs, "j").groupBy("i").agg(re.alias("re"), im.alias("im")).select("i", F.struct("re", "im").alias("v"))


def spmm(a: DataFrame, x: DataFrame) -> DataFrame:
    """A X for several right-hand sides (i, c, v)."""
    xs = x.select(F.col("i").alias("j"), "c", F.col("v").alias("x"))
    return a.join(xs, "j").groupBy("i", "c").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def gemm(a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 0.0, c: DataFrame | None = None) -> DataFrame:
    """alpha A B + beta C."""
    inner = b.select(F.col("i").alias("k"), F.col("j").alias("bj"), F.col("v").alias("bv"))
    ab = a.withColumnRenamed("j", "k").join(inner, "k").groupBy("i", F.col("bj").alias("j")).agg((alpha * F.sum(F.col("v") * F.col("bv"))).alias("v"))
    return ab if c is None else combined(ab, c, 1.0, beta)


def gemv(a: DataFrame, x: DataFrame, alpha: float, beta: float, y: DataFrame) -> DataFrame:
    both = spmv(a, x).select("i", (alpha * F.col("v")).alias("v")).unionByName(y.select("i", (beta * F.col("v")).alias("v")))
    return both.groupBy("i").agg(F.sum("v").alias("v"))


def spmv_cost(a: DataFrame, n: int, scalar_bytes: int = 8, index_bytes: int = 8, is_complex: bool = False) -> DataFrame:
    """Flops and bytes that a product moves, from counts alone."""
    nnz = F.count(F.lit(1))
    return a.agg(((4 if is_complex else 1) * (2 * nnz - n)).cast("long").alias("flops"), ((3 * scalar_bytes + index_bytes) * n + (scalar_bytes + index_bytes) * nnz).cast("long").alias("bytes"))


# norms and counts


def norm1(a: DataFrame) -> DataFrame:
    return a.groupBy("j").agg(F.sum(F.abs("v")).alias("s")).agg(F.max("s").alias("norm1"))


def norm_inf(a: DataFrame) -> DataFrame:
    return a.groupBy("i").agg(F.sum(F.abs("v")).alias("s")).agg(F.max("s").alias("norm_inf"))


def norm_f(a: DataFrame) -> DataFrame:
    return a.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm_f"))


def trace(a: DataFrame) -> DataFrame:
    return a.where("i = j").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("trace"))


def odd_values(a: DataFrame) -> DataFrame:
    """Counts of zeros and of numbers too small to be normal."""
    return a.agg(F.count_if(F.col("v") == 0).alias("zeros"), F.count_if((F.col("v") != 0) & (F.abs("v") < SAFE_MIN)).alias("subnormals"))


def max_scaled_residual(a: DataFrame, x: DataFrame, b: DataFrame) -> DataFrame:
    """max |b - A x| / (|b| + |A| |x|) over rows; rows that are zero throughout count nothing. x, b: (i, v)."""
    xs = x.select(F.col("i").alias("j"), F.col("v").alias("x"))
    ax = a.join(xs, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("ax"), F.sum(F.abs("v") * F.abs("x")).alias("size"))
    both = b.withColumnRenamed("v", "b").join(ax, "i", "full")
    b0, ax0, s0 = (F.coalesce(c, F.lit(0.0)) for c in ("b", "ax", "size"))
    whole = F.abs(b0) + s0
    return both.agg(F.max(F.when(whole > 0, F.abs(b0 - ax0) / whole)).alias("residual"))


# scaling


def equilibration(a: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Row scales (i, v), column scales (j, v), and one row with rcond, ccond, amax and type.

    Types: N none, C columns, R rows, B both. Rows and columns of zeros have no scale; with them the type is N.
    """
    inverse = lambda m: 1.0 / F.least(F.greatest(m, F.lit(SAFE_MIN)), F.lit(1.0 / SAFE_MIN))
    rows = a.groupBy("i").agg(F.max(F.abs("v")).alias("m"))
    r = rows.where("m > 0").select("i", inverse(F.col("m")).alias("v"))
    cols = a.join(r.withColumnRenamed("v", "r"), "i").groupBy("j").agg(F.max(F.abs("v") * F.col("r")).alias("m"))
    c = cols.where("m > 0").select("j", inverse(F.col("m")).alias("v"))
    edge = lambda lo, hi: F.greatest(lo, F.lit(SAFE_MIN)) / F.least(hi, F.lit(1.0 / SAFE_MIN))
    of_rows = rows.agg(F.min("m").alias("r_min"), F.max("m").alias("amax"))
    of_cols = cols.agg(F.min("m").alias("c_min"), F.max("m").alias("c_max"))
    one = of_rows.withColumn("k", F.lit(1)).join(of_cols.withColumn("k", F.lit(1)), "k")
    one = one.select(edge(F.col("r_min"), F.col("amax")).alias("rcond"), edge(F.col("c_min"), F.col("c_max")).alias("ccond"), "amax", ((F.col("r_min") > 0) & (F.col("c_min") > 0)).alias("whole"))
    small = SAFE_MIN / PRECISION
    fine = (F.col("rcond") >= 0.1) & F.col("amax").between(small, 1.0 / small)
    kind = F.when(~F.col("whole"), "N").when(fine, F.when(F.col("ccond") >= 0.1, "N").otherwise("C")).otherwise(F.when(F.col("ccond") >= 0.1, "R").otherwise("B"))
    return r, c, one.select("rcond", "ccond", "amax", kind.alias("type"))


def scale(a: DataFrame, r: DataFrame | None = None, c: DataFrame | None = None) -> DataFrame:
    """diag(r) A diag(c); r: (i, v), c: (j, v). Rows and columns without a scale stay."""
    if r is not None:
        a = a.join(r.select("i", F.col("v").alias("f")), "i", "left").select("i", "j", (F.col("v") * F.coalesce("f", F.lit(1.0))).alias("v"))
    if c is not None:
        a = a.join(c.select("j", F.col("v").alias("f")), "j", "left").select("i", "j", (F.col("v") * F.coalesce("f", F.lit(1.0))).alias("v"))
    return a


def equilibrate(a: DataFrame, r: DataFrame, c: DataFrame, kind: str) -> DataFrame:
    return scale(a, r if kind in "RB" else None, c if kind in "CB" else None)


def div_rows(a: DataFrame, d: DataFrame) -> DataFrame:
    return a.join(d.select("i", F.col("v").alias("f")), "i").select("i", "j", (F.col("v") / F.col("f")).alias("v"))


def times(a: DataFrame, alpha: float) -> DataFrame:
    return a.withColumn("v", alpha * F.col("v"))


def shifted(a: DataFrame, sigma: float, rows: DataFrame) -> DataFrame:
    """A + sigma I over the domain (i)."""
    return combined(a, rows.select("i", F.col("i").alias("j"), F.lit(1.0).alias("v")), 1.0, sigma)


# places


def permute(a: DataFrame, order: DataFrame) -> DataFrame:
    """P A P^T; order: old and new numbers."""
    rows = order.select(F.col("old").alias("i"), F.col("new").alias("ni"))
    cols = order.select(F.col("old").alias("j"), F.col("new").alias("nj"))
    return a.join(rows, "i").join(cols, "j").select(F.col("ni").alias("i"), F.col("nj").alias("j"), "v")


def permute_rows(a: DataFrame, order: DataFrame) -> DataFrame:
    return a.join(order.select(F.col("old").alias("i"), F.col("new").alias("n")), "i").select(F.col("n").alias("i"), "j", "v")


def permute_columns(a: DataFrame, order: DataFrame) -> DataFrame:
    return a.join(order.select(F.col("old").alias("j"), F.col("new").alias("n")), "j").select("i", F.col("n").alias("j"), "v")


def swaps_to_order(spark: SparkSession, pivots: list[int], forward: bool = True) -> DataFrame:
    """A sequence of row swaps (k with pivots[k]) as a table of old and new numbers."""
    at = list(range(max([len(pivots), *(p + 1 for p in pivots)], default=0)))
    for k in range(len(pivots)) if forward else reversed(range(len(pivots))):
        at[k], at[pivots[k]] = at[pivots[k]], at[k]
    return spark.createDataFrame([(old, new) for new, old in enumerate(at)], "old long, new long")


def lower_triangle(a: DataFrame) -> DataFrame:
    return a.where("j <= i")


def cast_single(a: DataFrame) -> DataFrame:
    return a.withColumn("v", F.col("v").cast("float"))


def block(a: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """A sub-matrix by half-open ranges, numbered from 0."""
    inside = F.col("i").between(rows[0], rows[1] - 1) & F.col("j").between(cols[0], cols[1] - 1)
    return a.where(inside).select((F.col("i") - rows[0]).alias("i"), (F.col("j") - cols[0]).alias("j"), "v")


def _numbered(spark: SparkSession, places: list[int], old: str, new: str) -> DataFrame:
    return spark.createDataFrame([(int(p), k) for k, p in enumerate(places)], f"{old} long, {new} long")


def extract(a: DataFrame, rows: list[int], cols: list[int]) -> DataFrame:
    """A(I, J): a row or column that is named twice comes twice."""
    spark = a.sparkSession
    return a.join(_numbered(spark, rows, "i", "ni"), "i").join(_numbered(spark, cols, "j", "nj"), "j").select(F.col("ni").alias("i"), F.col("nj").alias("j"), "v")


def scatter_rows_add(a: DataFrame, rows: list[int], b: DataFrame) -> DataFrame:
    """A with row k of B added to row rows[k]."""
    moved = b.join(_numbered(b.sparkSession, rows, "ni", "i"), "i").select(F.col("ni").alias("i"), "j", "v")
    return combined(a, moved)


def separator_block(a: DataFrame, sep_end: int, rows: list[int], cols: list[int]) -> DataFrame:
    """The dense block A(I, J) of which entries beyond the separator in both directions count as zero."""
    spark = a.sparkSession
    i, j = _numbered(spark, rows, "i", "ni"), _numbered(spark, cols, "j", "nj")
    grid = i.withColumn("k", F.lit(1)).join(j.withColumn("k", F.lit(1)), "k")
    value = F.when((F.col("i") < sep_end) | (F.col("j") < sep_end), F.coalesce("v", F.lit(0.0))).otherwise(0.0)
    return grid.join(a, ["i", "j"], "left").select(F.col("ni").alias("i"), F.col("nj").alias("j"), value.alias("v"))


def front_parts(a: DataFrame, lo: int, hi: int, upd: DataFrame) -> DataFrame:
    """part (11, 12, 21), i, j, v: rows and columns of the separator [lo, hi), and of the update set (i)."""
    sep = lambda c: F.col(c).between(lo, hi - 1)
    u = upd.select(F.col("i").alias("u")).distinct()
    rows = a.where(sep("i") | sep("j"))
    tagged = rows.withColumn("part", F.when(sep("i") & sep("j"), 11).when(sep("i"), 12).otherwise(21)).withColumn("other", F.when(F.col("part") == 12, F.col("j")).when(F.col("part") == 21, F.col("i")))
    in_upd = tagged.where("part <> 11").join(u, F.col("other") == F.col("u"), "left_semi")
    return tagged.where("part = 11").unionByName(in_upd).select("part", "i", "j", "v")


def front_counts(a: DataFrame, lo: int, hi: int, upd: DataFrame, symmetric: bool = False) -> DataFrame:
    parts = front_parts(a, lo, hi, upd)
    return (parts.where("i >= j") if symmetric else parts).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def front_multiply(a: DataFrame, lo: int, hi: int, upd: DataFrame, r: DataFrame) -> tuple[DataFrame, DataFrame]:
    """F R and F^T R of the front, without its update by update block; R: (i, c, v) over the front's numbers."""
    f = front_parts(a, lo, hi, upd).drop("part")
    return spmm(f, r), spmm(transpose(f), r)


def front_multiply_part(a: DataFrame, lo: int, hi: int, upd: DataFrame, part: int, r: DataFrame, transposed: bool = False) -> DataFrame:
    f = front_parts(a, lo, hi, upd).where(F.col("part") == part).drop("part")
    return spmm(transpose(f) if transposed else f, r)


# pattern


def symmetrized(a: DataFrame) -> DataFrame:
    """With an explicit zero at (j, i) wherever only (i, j) is there."""
    missing = transpose(a).join(a.select("i", "j"), ["i", "j"], "left_anti").select("i", "j", F.lit(0.0).alias("v"))
    return a.unionByName(missing)


def with_diagonal(a: DataFrame, rows: DataFrame, s: float) -> DataFrame:
    """With (i, i, s) for rows of the domain that have no diagonal entry."""
    missing = rows.select("i").join(a.where("i = j").select("i"), "i", "left_anti").select("i", F.col("i").alias("j"), F.lit(float(s)).alias("v"))
    return a.unionByName(missing)


def diagonal_split(a: DataFrame, ranges: DataFrame) -> DataFrame:
    """part and whether the entry is in the part's own columns; ranges: part, lo, hi (few, by rows)."""
    cond = (F.col("i") >= F.col("lo")) & (F.col("i") < F.col("hi"))
    return a.join(ranges, cond).select("part", "i", "j", "v", ((F.col("j") >= F.col("lo")) & (F.col("j") < F.col("hi"))).alias("own"))


def halo(a: DataFrame, ranges: DataFrame) -> DataFrame:
    """part and j: the vector entries that a block row needs from others."""
    return diagonal_split(a, ranges).where(~F.col("own")).select("part", "j").distinct()


# sums


def combined(a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """alpha A + beta B."""
    both = a.select("i", "j", (alpha * F.col("v")).alias("v")).unionByName(b.select("i", "j", (beta * F.col("v")).alias("v")))
    return both.groupBy("i", "j").agg(F.sum("v").alias("v"))


def hconcat(a: DataFrame, b: DataFrame, cols_a: int) -> DataFrame:
    return a.select("i", "j", "v").unionByName(b.select("i", (F.col("j") + cols_a).alias("j"), "v"))


def vconcat(a: DataFrame, b: DataFrame, rows_a: int) -> DataFrame:
    return a.select("i", "j", "v").unionByName(b.select((F.col("i") + rows_a).alias("i"), "j", "v"))


def extend_add(parent: DataFrame, child: DataFrame, places: DataFrame) -> DataFrame:
    """A child's contribution added to its parent's front; places: child and parent numbers of the update set."""
    rows, cols = places.select(F.col("child").alias("i"), F.col("parent").alias("pi")), places.select(F.col("child").alias("j"), F.col("parent").alias("pj"))
    return combined(parent, child.join(rows, "i").join(cols, "j").select(F.col("pi").alias("i"), F.col("pj").alias("j"), "v"))


def places_in_parent(child_upd: DataFrame, parent_index: DataFrame) -> DataFrame:
    """child and parent: local numbers of the shared global numbers; both: idx and pos."""
    return child_upd.select("idx", F.col("pos").alias("child")).join(parent_index.select("idx", F.col("pos").alias("parent")), "idx").select("child", "parent")


def element(a: DataFrame, i: Column, j: Column) -> DataFrame:
    return a.where((F.col("i") == i) & (F.col("j") == j)).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"))
