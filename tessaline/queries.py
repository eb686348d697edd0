"""One query per operator over the test tables, and the SQL that gives the same rows.

A(i = l_suppkey, j = l_partkey, v = sum of l_quantity) is the sparse matrix, retail prices are a vector over parts,
account balances one over suppliers; customers and the days of their orders make a graph; embeddings are points.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.operators import dense, graph, points, sparse, structured
from tessaline.plans import kernel_regression, krylov, multifrontal
from tessaline.sources import generators

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


#: Added to a day's number, which makes it a node beside the customers.
DAYS = 1_000_000_000_000


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH {VIEWS} {sql}"
        return f

    return add


VIEWS = """
A AS (SELECT l_suppkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
X AS (SELECT p_partkey AS j, p_retailprice AS x FROM part),
Z AS (SELECT s_suppkey AS i, s_acctbal AS z FROM supplier),
S AS (SELECT s_suppkey AS i FROM supplier),
PT AS (SELECT p_partkey AS j FROM part),
P AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label FROM embeddings),
G AS (SELECT DISTINCT o_custkey::BIGINT AS src, 1000000000000 + (o_orderdate::DATE - DATE '1970-01-01')::BIGINT AS dst FROM orders),
E AS (SELECT src, dst FROM G UNION SELECT dst, src FROM G)"""


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def matrix(s: SparkSession, d: str) -> DataFrame:
    return sparse.coo(_t(s, d, "lineitem"), "l_suppkey", "l_partkey", "l_quantity")


def prices(s: SparkSession, d: str) -> DataFrame:
    return sparse.vector(_t(s, d, "part"), "p_partkey", "p_retailprice")


def balances(s: SparkSession, d: str) -> DataFrame:
    return sparse.vector(_t(s, d, "supplier"), "s_suppkey", "s_acctbal")


def suppliers(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("i"))


def cloud(s: SparkSession, d: str) -> DataFrame:
    return points.points(_t(s, d, "embeddings"), "vec_id", "embedding")


def relation(s: SparkSession, d: str) -> DataFrame:
    """Customers and the days of their orders, in both directions."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long") + DAYS
    g = _t(s, d, "orders").select(F.col("o_custkey").cast("long").alias("src"), day.alias("dst"))
    return g.unionByName(g.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    """Rounded for comparison; a negative zero becomes zero."""
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in names or ("v",)})


# ingest and shape


@query("coo_ingest", "SELECT i, j, v FROM A")
def _(s, d):
    return matrix(s, d)


@query("coo_count", "SELECT count(*)::BIGINT AS nnz, count(DISTINCT i)::BIGINT AS used_rows, count(DISTINCT j)::BIGINT AS used_cols FROM A")
def _(s, d):
    return matrix(s, d).agg(F.count(F.lit(1)).alias("nnz"), F.countDistinct("i").alias("used_rows"), F.countDistinct("j").alias("used_cols"))


@query("csr_row_ptr", "SELECT S.i, coalesce(sum(count(A.j)) OVER (ORDER BY S.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, count(A.j)::BIGINT AS n FROM S LEFT JOIN A USING (i) GROUP BY S.i")
def _(s, d):
    return sparse.row_pointer(matrix(s, d), suppliers(s, d))


# products


@query("spmv", "SELECT i, round(sum(v * x), 4) + 0.0 AS v FROM A JOIN X USING (j) GROUP BY i")
def _(s, d):
    return rounded(sparse.spmv(matrix(s, d), prices(s, d)))


@query("spmv_t", "SELECT j AS i, round(sum(v * z), 4) + 0.0 AS v FROM A JOIN Z USING (i) GROUP BY j")
def _(s, d):
    return rounded(sparse.spmv_t(matrix(s, d), balances(s, d)))


@query("matvec_zero_rows", "SELECT S.i, round(coalesce(sum(v * x), 0), 4) + 0.0 AS v FROM S LEFT JOIN (SELECT * FROM A JOIN X USING (j) WHERE v > 900 AND j % 3 = 0) USING (i) GROUP BY S.i")
def _(s, d):
    return rounded(sparse.spmv(matrix(s, d).where("v > 900 AND j % 3 = 0"), prices(s, d), suppliers(s, d)))


@query("spmm_2rhs", "SELECT i, c, round(sum(v * CASE c WHEN 0 THEN x ELSE j % 10 END), 4) + 0.0 AS v FROM A JOIN X USING (j) CROSS JOIN (VALUES (0::BIGINT), (1::BIGINT)) t(c) GROUP BY i, c")
def _(s, d):
    p = prices(s, d)
    rhs = p.select("i", F.lit(0).cast("long").alias("c"), "v").unionByName(p.select("i", F.lit(1).cast("long").alias("c"), (F.col("i") % 10).cast("double").alias("v")))
    return rounded(sparse.spmm(matrix(s, d), rhs))


@query("gemv", "SELECT i, round(sum(v), 4) + 0.0 AS v FROM (SELECT i, 2.0 * v * x AS v FROM A JOIN X USING (j) UNION ALL SELECT i, -0.5 * z FROM Z) GROUP BY i")
def _(s, d):
    return rounded(sparse.gemv(matrix(s, d), prices(s, d), 2.0, -0.5, balances(s, d)))


@query("gemm", "SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM A a JOIN A b ON a.j = b.j GROUP BY a.i, b.i")
def _(s, d):
    a = matrix(s, d)
    return sparse.gemm(a, sparse.transpose(a))


@query("gemm_tiles", "SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM A a JOIN A b ON a.j = b.j GROUP BY a.i, b.i")
def _(s, d):
    a = matrix(s, d)
    return dense.tile_product(dense.tiles(a, 256), dense.tiles(sparse.transpose(a), 256), 256)


@query("spmv_cost", "SELECT (2 * count(*) - (SELECT count(*) FROM S))::BIGINT AS flops, (32 * (SELECT count(*) FROM S) + 16 * count(*))::BIGINT AS bytes FROM A")
def _(s, d):
    return sparse.spmv_cost(matrix(s, d), suppliers(s, d).count())


@query("spmv_complex", "SELECT i, round(sum(v * x), 4) + 0.0 AS re, round(sum(-v * (j % 10)), 4) + 0.0 AS im FROM A JOIN X USING (j) GROUP BY i")
def _(s, d):
    a = matrix(s, d).select("i", "j", F.struct("v", F.lit(0.0).alias("im")).alias("w")).select("i", "j", F.struct(F.col("w.v").alias("re"), F.col("w.im").alias("im")).alias("v"))
    x = prices(s, d).select("i", F.struct(F.col("v").alias("re"), (-(F.col("i") % 10)).cast("double").alias("im")).alias("v"))
    return rounded(sparse.spmv_complex(a, x).select("i", "v.re", "v.im"), "re", "im")


@query("conj_transpose", "SELECT j AS i, i AS j, v AS re, -(i % 7)::DOUBLE + 0.0 AS im FROM A")
def _(s, d):
    a = matrix(s, d).select("i", "j", F.struct(F.col("v").alias("re"), (F.col("i") % 7).cast("double").alias("im")).alias("v"))
    return sparse.conj_transpose(a).select("i", "j", "v.re", (F.col("v.im") + F.lit(0.0)).alias("im"))


# norms


@query("norm1", "SELECT max(s) AS norm1 FROM (SELECT sum(abs(v)) AS s FROM A GROUP BY j)")
def _(s, d):
    return sparse.norm1(matrix(s, d))


@query("norm_inf", "SELECT max(s) AS norm_inf FROM (SELECT sum(abs(v)) AS s FROM A GROUP BY i)")
def _(s, d):
    return sparse.norm_inf(matrix(s, d))


@query("norm_f", "SELECT round(sqrt(sum(v * v)), 6) AS norm_f FROM A")
def _(s, d):
    return rounded(sparse.norm_f(matrix(s, d)), "norm_f", digits=6)


@query("trace", "SELECT sum(v) AS trace FROM A WHERE i = j")
def _(s, d):
    return sparse.trace(matrix(s, d))


@query("zeros_subnormals", "SELECT count(*) FILTER (w = 0)::BIGINT AS zeros, count(*) FILTER (w <> 0 AND abs(w) < 2.2250738585072014e-308)::BIGINT AS subnormals FROM (SELECT CASE WHEN j % 5 = 0 THEN 0.0 WHEN j % 7 = 0 THEN v * 1e-310 ELSE v END AS w FROM A)")
def _(s, d):
    v = F.when(F.col("j") % 5 == 0, 0.0).when(F.col("j") % 7 == 0, F.col("v") * 1e-310).otherwise(F.col("v"))
    return sparse.odd_values(matrix(s, d).withColumn("v", v))


@query("scaled_residual", "SELECT round(max(abs(b - ax) / (abs(b) + s)), 8) AS residual FROM (SELECT i, sum(v * x) AS ax, sum(abs(v) * abs(x)) AS s FROM A JOIN X USING (j) GROUP BY i) JOIN (SELECT i, z * 1000 AS b FROM Z) USING (i)")
def _(s, d):
    b = balances(s, d).withColumn("v", F.col("v") * 1000)
    return rounded(sparse.max_scaled_residual(matrix(s, d), prices(s, d), b), "residual", digits=8)


# scaling and places

_EQ = "R AS (SELECT i, max(abs(v)) AS m FROM A GROUP BY i), C AS (SELECT j, max(abs(v) * (1.0 / m)) AS m FROM A JOIN R USING (i) GROUP BY j)"


@query("equil_row", f", {_EQ} SELECT i, 1.0 / m AS v FROM R")
def _(s, d):
    return sparse.equilibration(matrix(s, d))[0]


@query("equil_col", f", {_EQ} SELECT j, round(1.0 / m, 10) AS v FROM C")
def _(s, d):
    return rounded(sparse.equilibration(matrix(s, d))[1], digits=10)


@query("equil_type", f", {_EQ} SELECT round(r.rc, 10) AS rcond, round(c.cc, 10) AS ccond, r.amax, CASE WHEN rc >= 0.1 THEN CASE WHEN cc >= 0.1 THEN 'N' ELSE 'C' END ELSE CASE WHEN cc >= 0.1 THEN 'R' ELSE 'B' END END AS type FROM (SELECT min(m) / max(m) AS rc, max(m) AS amax FROM R) r, (SELECT min(m) / max(m) AS cc FROM C) c")
def _(s, d):
    return rounded(sparse.equilibration(matrix(s, d))[2], "rcond", "ccond", digits=10)


@query("equilibrate", f", {_EQ} SELECT i, j, round(v * (1.0 / R.m) * (1.0 / C.m), 6) AS v FROM A JOIN R USING (i) JOIN C USING (j)")
def _(s, d):
    a = matrix(s, d)
    r, c, _ = sparse.equilibration(a)
    return rounded(sparse.equilibrate(a, r, c, "B"), digits=6)


@query("scale", "SELECT i, j, v * (i % 4 + 1) * (j % 3 + 1) AS v FROM A")
def _(s, d):
    r = suppliers(s, d).select("i", (F.col("i") % 4 + 1).cast("double").alias("v"))
    c = prices(s, d).select(F.col("i").alias("j"), (F.col("i") % 3 + 1).cast("double").alias("v"))
    return sparse.scale(matrix(s, d), r, c)


@query("scale_matrix", "SELECT i, j, 3.0 * v AS v FROM A")
def _(s, d):
    return sparse.times(matrix(s, d), 3.0)


@query("div_rows", "SELECT i, j, v / (i % 4 + 1) AS v FROM A")
def _(s, d):
    return sparse.div_rows(matrix(s, d), suppliers(s, d).select("i", (F.col("i") % 4 + 1).cast("double").alias("v")))


@query("shift", "SELECT i, j, sum(v) AS v FROM (SELECT * FROM A UNION ALL SELECT i, i, 2.5 FROM S) GROUP BY i, j")
def _(s, d):
    return sparse.shifted(matrix(s, d), 2.5, suppliers(s, d))


def _reverse(df: DataFrame) -> DataFrame:
    last = df.agg(F.max("i")).first()[0]
    return df.select(F.col("i").alias("old"), (F.lit(last) - F.col("i")).alias("new"))


@query("permute_sym", "SELECT m - i AS i, m - j AS j, v FROM A, (SELECT max(i) AS m FROM S) WHERE j <= m")
def _(s, d):
    return sparse.permute(matrix(s, d), _reverse(suppliers(s, d)))


@query("permute_cols", "SELECT i, m - j AS j, v FROM A, (SELECT max(j) AS m FROM PT)")
def _(s, d):
    return sparse.permute_columns(matrix(s, d), _reverse(prices(s, d).select("i")))


@query("permute_rows", "SELECT m - i AS i, j, v FROM A, (SELECT max(i) AS m FROM S)")
def _(s, d):
    return sparse.permute_rows(matrix(s, d), _reverse(suppliers(s, d)))


@query("row_swaps", "SELECT CASE i WHEN 0 THEN n.n - 1 ELSE i - 1 END AS i, j, v FROM A, (SELECT count(*) AS n FROM S) n")
def _(s, d):
    # row k with row k + 1, one after the other: the first row ends up last
    n = suppliers(s, d).count()
    return sparse.permute_rows(matrix(s, d), sparse.swaps_to_order(s, [min(k + 1, n - 1) for k in range(n)]))


@query("lower_triangle", "SELECT i, j, v FROM A WHERE j <= i")
def _(s, d):
    return sparse.lower_triangle(matrix(s, d))


@query("transpose", "SELECT j AS i, i AS j, v FROM A")
def _(s, d):
    return sparse.transpose(matrix(s, d))


@query("cast_float", "SELECT i, j, v::FLOAT AS v FROM A")
def _(s, d):
    return sparse.cast_single(matrix(s, d))


@query("extract_block", "SELECT i - 2 AS i, j - 10 AS j, v FROM A WHERE i BETWEEN 2 AND 7 AND j BETWEEN 10 AND 99")
def _(s, d):
    return sparse.block(matrix(s, d), (2, 8), (10, 100))


@query("extract_sets", "SELECT r.n AS i, c.n AS j, v FROM A JOIN (VALUES (5, 0::BIGINT), (1, 1::BIGINT), (5, 2::BIGINT)) r(i, n) USING (i) JOIN (VALUES (7, 0::BIGINT), (3, 1::BIGINT), (50, 2::BIGINT)) c(j, n) USING (j)")
def _(s, d):
    return sparse.extract(matrix(s, d), [5, 1, 5], [7, 3, 50])


@query("scatter_rows_add", "SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM A UNION ALL SELECT (i * 7 + 3) % (SELECT count(*) FROM S) AS i, j, v FROM A) GROUP BY i, j")
def _(s, d):
    a, n = matrix(s, d), suppliers(s, d).count()
    return sparse.scatter_rows_add(a, [(7 * k + 3) % n for k in range(n)], a)


@query("extract_separator", "SELECT r.n AS i, c.n AS j, CASE WHEN r.i < 4 OR c.j < 4 THEN coalesce(v, 0) ELSE 0 END AS v FROM (VALUES (1, 0::BIGINT), (3, 1::BIGINT), (6, 2::BIGINT)) r(i, n) CROSS JOIN (VALUES (2, 0::BIGINT), (9, 1::BIGINT)) c(j, n) LEFT JOIN A ON A.i = r.i AND A.j = c.j")
def _(s, d):
    return sparse.separator_block(matrix(s, d), 4, [1, 3, 6], [2, 9])


_FRONT = ", F AS (SELECT CASE WHEN i BETWEEN 2 AND 5 AND j BETWEEN 2 AND 5 THEN 11 WHEN i BETWEEN 2 AND 5 THEN 12 ELSE 21 END AS part, i, j, v FROM A WHERE (i BETWEEN 2 AND 5 AND (j BETWEEN 2 AND 5 OR (j > 5 AND j % 4 = 0 AND j < 100))) OR (j BETWEEN 2 AND 5 AND i > 5 AND i % 4 = 0 AND i < 100))"


def _upd(s):
    return s.range(6, 100).where("id % 4 = 0").select(F.col("id").alias("i"))


@query("front_split", f"{_FRONT} SELECT * FROM F")
def _(s, d):
    return sparse.front_parts(matrix(s, d), 2, 6, _upd(s))


@query("front_count", f"{_FRONT} SELECT part, count(*)::BIGINT AS n FROM F GROUP BY part")
def _(s, d):
    return sparse.front_counts(matrix(s, d), 2, 6, _upd(s))


@query("front_count_symmetric", f"{_FRONT} SELECT part, count(*)::BIGINT AS n FROM F WHERE i >= j GROUP BY part")
def _(s, d):
    return sparse.front_counts(matrix(s, d), 2, 6, _upd(s), symmetric=True)


@query("front_multiply", f"{_FRONT} SELECT i, c, sum(v * (j % 5 + c)) AS v FROM F CROSS JOIN (VALUES (0::BIGINT), (1::BIGINT)) t(c) GROUP BY i, c")
def _(s, d):
    r = s.range(100).select(F.col("id").alias("i"), F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("c")).withColumn("v", (F.col("i") % 5 + F.col("c")).cast("double"))
    return sparse.front_multiply(matrix(s, d), 2, 6, _upd(s), r)[0]


@query("front_multiply_12t", f"{_FRONT} SELECT j AS i, 0::BIGINT AS c, sum(v * (i % 5)) AS v FROM F WHERE part = 12 GROUP BY j")
def _(s, d):
    r = s.range(100).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("c"), (F.col("id") % 5).cast("double").alias("v"))
    return sparse.front_multiply_part(matrix(s, d), 2, 6, _upd(s), 12, r, transposed=True)


@query("extend_add", "SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM A UNION ALL SELECT i * 2, j * 2, v FROM A) GROUP BY i, j")
def _(s, d):
    a, n = matrix(s, d), _t(s, d, "part").agg(F.max("p_partkey")).first()[0] + 1
    child, parent = s.range(n).select((F.col("id") * 2).alias("idx"), F.col("id").alias("pos")), s.range(2 * n).select(F.col("id").alias("idx"), F.col("id").alias("pos"))
    return sparse.extend_add(a, a, sparse.places_in_parent(child, parent))


# pattern and sums


@query("symmetrize", "SELECT i, j, v FROM A UNION ALL SELECT j, i, 0.0 FROM A a WHERE NOT EXISTS (SELECT 1 FROM A b WHERE b.i = a.j AND b.j = a.i)")
def _(s, d):
    return sparse.symmetrized(matrix(s, d))


@query("add_diagonal", "SELECT i, j, v FROM A UNION ALL SELECT i, i, 7.0 FROM S WHERE i NOT IN (SELECT i FROM A WHERE i = j)")
def _(s, d):
    return sparse.with_diagonal(matrix(s, d), suppliers(s, d), 7.0)


def _ranges(s):
    return s.createDataFrame([(0, 0, 5), (1, 5, 10), (2, 10, 1000)], "part long, lo long, hi long")


@query("diag_offdiag", "SELECT part, i, j, v, j >= lo AND j < hi AS own FROM A JOIN (VALUES (0::BIGINT, 0, 5), (1::BIGINT, 5, 10), (2::BIGINT, 10, 1000)) t(part, lo, hi) ON i >= lo AND i < hi")
def _(s, d):
    return sparse.diagonal_split(matrix(s, d), _ranges(s))


@query("halo_columns", "SELECT DISTINCT part, j FROM A JOIN (VALUES (0::BIGINT, 0, 5), (1::BIGINT, 5, 10), (2::BIGINT, 10, 1000)) t(part, lo, hi) ON i >= lo AND i < hi WHERE NOT (j >= lo AND j < hi)")
def _(s, d):
    return sparse.halo(matrix(s, d), _ranges(s))


@query("matadd", "SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM A UNION ALL SELECT j, i, v FROM A) GROUP BY i, j")
def _(s, d):
    a = matrix(s, d)
    return sparse.combined(a, sparse.transpose(a))


@query("matsub", "SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM A UNION ALL SELECT j, i, -v FROM A) GROUP BY i, j")
def _(s, d):
    a = matrix(s, d)
    return sparse.combined(a, sparse.transpose(a), 1.0, -1.0)


@query("scaled_add", "SELECT i, j, sum(v) AS v FROM (SELECT i, j, 2.0 * v AS v FROM A UNION ALL SELECT j, i, 0.25 * v FROM A) GROUP BY i, j")
def _(s, d):
    a = matrix(s, d)
    return sparse.combined(a, sparse.transpose(a), 2.0, 0.25)


@query("hconcat", "SELECT i, j, v FROM A UNION ALL SELECT i, j + (SELECT max(j) + 1 FROM PT), v FROM A")
def _(s, d):
    a = matrix(s, d)
    return sparse.hconcat(a, a, _t(s, d, "part").agg(F.max("p_partkey")).first()[0] + 1)


@query("vconcat", "SELECT i, j, v FROM A UNION ALL SELECT i + (SELECT count(*) FROM S), j, v FROM A")
def _(s, d):
    a = matrix(s, d)
    return sparse.vconcat(a, a, suppliers(s, d).count())


# graphs


@query("graph_degree", "SELECT src, count(*)::BIGINT AS degree FROM E GROUP BY src")
def _(s, d):
    return graph.degrees(relation(s, d))


@query("subgraph", "SELECT src, dst FROM E WHERE src % 3 <> 0 AND dst % 3 <> 0")
def _(s, d):
    e = relation(s, d)
    return graph.subgraph(e, e.select(F.col("src").alias("id")).distinct().where("id % 3 <> 0"))


@query("subgraph_2hop", "SELECT src, dst FROM E WHERE src % 3 <> 0 AND dst % 3 <> 0 UNION SELECT a.src, b.dst FROM E a JOIN E b ON a.dst = b.src WHERE a.src <> b.dst AND a.src % 3 <> 0 AND b.dst % 3 <> 0")
def _(s, d):
    e = relation(s, d)
    return graph.subgraph(e, e.select(F.col("src").alias("id")).distinct().where("id % 3 <> 0"), 2)


@query("two_hop", "SELECT src, dst FROM E UNION SELECT a.src, b.dst FROM E a JOIN E b ON a.dst = b.src WHERE a.src <> b.dst")
def _(s, d):
    return graph.two_hop(relation(s, d))


@query("bipartite", "SELECT src, dst FROM G")
def _(s, d):
    e = relation(s, d)
    ids = e.select(F.col("src").alias("id")).distinct()
    return graph.bipartite(e, ids.where(F.col("id") < DAYS), ids.where(F.col("id") >= DAYS))


@query("neighbours_inside", "SELECT dst AS node, list_sort(list(DISTINCT src)) AS inside FROM E WHERE src < 1000000000000 AND NOT dst < 1000000000000 GROUP BY dst")
def _(s, d):
    return graph.neighbours_inside(relation(s, d), 0, DAYS)


_TILES = """, N AS (SELECT DISTINCT n_nationkey::BIGINT AS id FROM nation), W AS (SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
 M AS (SELECT avg(n) + 1.5 * stddev_pop(n) AS m FROM W), T AS (SELECT src, dst FROM W, M WHERE n > m AND src <> dst), NE AS (SELECT src, dst FROM T UNION SELECT dst, src FROM T)"""


def trade(s: SparkSession, d: str) -> DataFrame:
    """Nations whose trade is well above the mean, in both directions: a small graph."""
    o = _t(s, d, "orders").join(_t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_t(s, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(_t(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    w = o.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    much = w.agg(F.avg("n") + 1.5 * F.stddev_pop("n")).first()[0]
    t = w.where((F.col("n") > much) & (F.col("src") != F.col("dst"))).select("src", "dst")
    return t.unionByName(t.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


@query("tile_admissibility", f"{_TILES}, H AS (SELECT src, dst FROM NE UNION SELECT a.src, b.dst FROM NE a JOIN NE b ON a.dst = b.src) SELECT a.id AS ti, b.id AS tj FROM N a, N b WHERE a.id <> b.id AND NOT EXISTS (SELECT 1 FROM H WHERE src = a.id AND dst = b.id)")
def _(s, d):
    return graph.admissible(trade(s, d), _t(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("tile"), F.col("n_nationkey").cast("long").alias("lo"), (F.col("n_nationkey") + 1).cast("long").alias("hi")))


#: A table of one row per node, which each step may only improve.
_NEAREST = "L AS (WITH RECURSIVE w(node, level) USING KEY (node) AS (SELECT 1::BIGINT, 0::BIGINT UNION SELECT E.dst, min(w.level) + 1 FROM w JOIN E ON E.src = w.node LEFT JOIN recurring.w AS old ON old.node = E.dst WHERE old.node IS NULL GROUP BY E.dst) SELECT * FROM w)"


@query("components", "SELECT node, label FROM (WITH RECURSIVE w(node, label) USING KEY (node) AS (SELECT src, src FROM (SELECT DISTINCT src FROM E) UNION SELECT E.dst, min(w.label) FROM w JOIN E ON E.src = w.node JOIN recurring.w AS old ON old.node = E.dst WHERE w.label < old.label GROUP BY E.dst) SELECT * FROM w)")
def _(s, d):
    return graph.components(relation(s, d))


@query("bfs_levels", f", {_NEAREST} SELECT node, level FROM L")
def _(s, d):
    return graph.levels(relation(s, d), 1)


@query("middle_separator", f", {_NEAREST}, M AS (SELECT max(level) + 1 AS n FROM L) SELECT DISTINCT node FROM L, M WHERE n < 3 OR (level = (n + 2) // 2 - 1 AND EXISTS (SELECT 1 FROM E JOIN L l2 ON l2.node = E.dst WHERE E.src = L.node AND l2.level = L.level + 1))")
def _(s, d):
    e = relation(s, d)
    return graph.middle_separator(e, graph.levels(e, 1))


@query("tree_depth", "SELECT node, level::BIGINT AS level FROM (WITH RECURSIVE w(node, level) AS (SELECT 1::BIGINT, 0 UNION ALL SELECT w.node * 2 + k, w.level + 1 FROM w, (VALUES (0), (1)) t(k) WHERE w.node * 2 + k <= (SELECT count(*) FROM nation)) SELECT * FROM w)")
def _(s, d):
    n = _t(s, d, "nation").count()
    s.range(1, n + 1).select(F.col("id").alias("node"), F.when(F.col("id") > 1, F.expr("id div 2")).alias("parent")).createOrReplaceTempView("tessaline_tree")
    return graph.tree_levels(s, "tessaline_tree").select("node", F.col("level").cast("long").alias("level"))


@query("orderings", f"{_TILES} SELECT name, id AS node, 1::BIGINT AS times FROM N, (VALUES ('amd'), ('mmd'), ('natural'), ('nd'), ('rcm')) t(name)")
def _(s, d):
    # every nation once in each order of the trade graph
    n = _t(s, d, "nation").count()
    g = graph.Adjacency.of(trade(s, d), n)
    ways = {"amd": graph.minimum_degree(g), "mmd": graph.minimum_degree(g, True), "rcm": graph.rcm(g), "nd": graph.bisection_nd(g)[0], "natural": list(range(n))}
    rows = s.createDataFrame([(k, int(u)) for k, v in ways.items() for u in v], "name string, node long")
    return rows.groupBy("name", "node").agg(F.count(F.lit(1)).alias("times"))


@query("geometric_ordering", "SELECT s_suppkey::BIGINT AS node, 1::BIGINT AS times FROM supplier")
def _(s, d):
    # every point of the suppliers' grid once
    _, _, _, sides = _grid(s, d)
    return s.createDataFrame([(int(u),) for u in graph.geometric_nd(sides)[0]], "node long").groupBy("node").agg(F.count(F.lit(1)).alias("times"))


@query("greedy_matching", "SELECT count(DISTINCT i)::BIGINT AS pairs, 0::BIGINT AS clashes FROM A")
def _(s, d):
    m = graph.greedy_matching(matrix(s, d), suppliers(s, d).count())
    return m.agg(F.count(F.lit(1)).alias("pairs"), (2 * F.count(F.lit(1)) - F.countDistinct("i") - F.countDistinct("j")).alias("clashes"))


# generators


@query("poisson2d_nnz", "SELECT 4380::BIGINT AS nnz, (3600.0 - 3480.0)::DOUBLE AS total")
def _(s, d):
    return generators.poisson2d(s, 30).agg(F.count(F.lit(1)).alias("nnz"), F.sum("v").alias("total"))


@query("poisson2d_apply", "SELECT i, (4 * (i % 7) - CASE WHEN i % 20 > 0 THEN (i - 1) % 7 ELSE 0 END - CASE WHEN i % 20 < 19 THEN (i + 1) % 7 ELSE 0 END - CASE WHEN i >= 20 THEN (i - 20) % 7 ELSE 0 END - CASE WHEN i < 380 THEN (i + 20) % 7 ELSE 0 END)::DOUBLE AS v FROM (SELECT range AS i FROM range(0, 400))")
def _(s, d):
    return sparse.spmv(generators.poisson2d(s, 20), s.range(400).select(F.col("id").alias("i"), (F.col("id") % 7).cast("double").alias("v")))


@query("poisson3d_nnz", "SELECT (7 * 1000 - 6 * 100)::BIGINT AS nnz")
def _(s, d):
    return generators.poisson3d(s, 10).agg(F.count(F.lit(1)).alias("nnz"))


@query("helmholtz3d", "SELECT (7 * 216 - 6 * 36)::BIGINT AS nnz, (5.0 * 216 - (6 * 216 - 6 * 36))::DOUBLE AS re, -108.0::DOUBLE AS im")
def _(s, d):
    return generators.helmholtz3d(s, 6).agg(F.count(F.lit(1)).alias("nnz"), F.sum("v.re").alias("re"), F.sum("v.im").alias("im"))


@query("toeplitz", "SELECT a.range AS i, b.range AS j, 1.0 / (1 + abs(a.range - b.range)) AS v FROM range(0, 40) a, range(0, 40) b")
def _(s, d):
    return generators.toeplitz(s, 40)


@query("identity", "SELECT range AS i, range AS j, 1.0::DOUBLE AS v FROM range(0, 50)")
def _(s, d):
    return generators.identity(s, 50)


# points


def _pairs(sql: str) -> str:
    return f"SELECT a.id, b.id AS other, {sql} FROM P a, P b"


def _all(s, d, value):
    """value of all pairs of points, the matrix itself being asked for: blocks meet by an equi-join, and no pair is a row with its points."""
    p = cloud(s, d)
    return rounded(points.pair_values(p, p, value), digits=6)


_D2 = "list_sum(list_transform(range(1, len(a.x) + 1), lambda k: (a.x[k] - b.x[k]) * (a.x[k] - b.x[k])))"
_D1 = "list_sum(list_transform(range(1, len(a.x) + 1), lambda k: abs(a.x[k] - b.x[k])))"


@query("dist_sq", _pairs(f"round({_D2}, 6) AS v"))
def _(s, d):
    return rounded(points.distances(cloud(s, d), cloud(s, d)).select("id", "other", F.col("d2").alias("v")), digits=6)


@query("dist_euclid", _pairs(f"round(sqrt({_D2}), 6) AS v"))
def _(s, d):
    return _all(s, d, lambda x, y: np.sqrt(points.summed(x, y, np.square)[0]))


@query("dist_l1", _pairs(f"round({_D1}, 6) AS v"))
def _(s, d):
    return _all(s, d, lambda x, y: points.summed(x, y, np.abs)[0])


@query("kernel_gauss", _pairs(f"round(exp(-({_D2}) / (2 * 1.3 * 1.3)), 6) AS v"))
def _(s, d):
    return _all(s, d, lambda x, y: kernel_regression.kernel_values("Gauss", x, y, 1.3))


@query("kernel_laplace", _pairs(f"round(exp(-({_D1}) / 5.0), 6) AS v"))
def _(s, d):
    return _all(s, d, lambda x, y: kernel_regression.kernel_values("Laplace", x, y, 5.0))


@query("kernel_anova_p2", _pairs("round((list_sum(list_transform(range(1, len(a.x) + 1), lambda k: exp(-((a.x[k] - b.x[k]) * (a.x[k] - b.x[k])) / 2))) ** 2 - list_sum(list_transform(range(1, len(a.x) + 1), lambda k: exp(-((a.x[k] - b.x[k]) * (a.x[k] - b.x[k])) / 2) ** 2))) / 2, 6) AS v"))
def _(s, d):
    return _all(s, d, lambda x, y: kernel_regression.kernel_values("ANOVA", x, y, 1.0, 2))


@query("gram", "SELECT 0::BIGINT AS node, a.range AS a, b.range AS b, round(sum(x[a.range + 1] * x[b.range + 1]), 6) AS v FROM P, range(0, 64) a, range(0, 64) b WHERE a.range <= b.range GROUP BY ALL")
def _(s, d):
    p = cloud(s, d).select(F.lit(0).cast("long").alias("node"), "id", "x")
    return rounded(points.gram(p).select("node", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "v"), digits=6)


_KNN = f"SELECT id, rank, neighbour FROM (SELECT a.id, b.id AS neighbour, row_number() OVER (PARTITION BY a.id ORDER BY {_D2}, b.id)::INT AS rank FROM P a CROSS JOIN P b) WHERE rank <= 6"


@query("knn_exact", _KNN)
def _(s, d):
    p = cloud(s, d)
    return points.knn(p, p, 6).select("id", "rank", "neighbour")


@query("knn_recall", "SELECT count(*)::BIGINT AS ids, count(*)::BIGINT * 16 AS neighbours, true AS good FROM P")
def _(s, d):
    found, quality = points.approximate_knn(cloud(s, d), 16, 14, goal=0.9)
    return found.agg(F.countDistinct("id").alias("ids"), F.count(F.lit(1)).alias("neighbours")).withColumn("good", F.lit(quality >= 0.9))


@query("knn_merge", _KNN)
def _(s, d):
    # lists of two overlapping parts that cover all ids
    p = cloud(s, d)
    return points.merged(points.knn(p, p.where("id % 3 < 2"), 6), points.knn(p, p.where("id % 3 > 0"), 6), 6).select("id", "rank", "neighbour")


def _root(s, d):
    return cloud(s, d).withColumn("node", F.lit(1).cast("long"))


@query("kd_split", "SELECT id, (nth > (n // 2))::INT AS part FROM (SELECT id, row_number() OVER (ORDER BY x[ax + 1], id) AS nth, count(*) OVER () AS n FROM P, (SELECT ax FROM (SELECT k AS ax, max(x[k + 1]) - min(x[k + 1]) AS w FROM P, range(0, 64) t(k) GROUP BY k) ORDER BY w DESC, ax LIMIT 1))")
def _(s, d):
    return points.kd_split(_root(s, d)).select("id", "part")


@query("cobble_split", ", M AS (SELECT list(m ORDER BY k) AS c FROM (SELECT k, avg(x[k + 1]) AS m FROM P, range(0, 64) t(k) GROUP BY k)), FA AS (SELECT x AS f FROM P, M ORDER BY list_sum(list_transform(range(1, 65), lambda k: (x[k] - c[k]) * (x[k] - c[k]))) DESC, id LIMIT 1) SELECT id, (nth > (n // 2))::INT AS part FROM (SELECT id, row_number() OVER (ORDER BY list_sum(list_transform(range(1, 65), lambda k: (x[k] - f[k]) * (x[k] - f[k]))), id) AS nth, count(*) OVER () AS n FROM P, FA)")
def _(s, d):
    return points.cobble_split(_root(s, d)).select("id", "part")


@query("kmeans_step", f"SELECT b.id, CASE WHEN {_D2.replace('a.x', 'f.x')} <= {_D2.replace('a.x', 'l.x')} THEN 0 ELSE 1 END AS part FROM P b, (SELECT x FROM P ORDER BY id LIMIT 1) f, (SELECT x FROM P ORDER BY id DESC LIMIT 1) l")
def _(s, d):
    p = _root(s, d)
    return points.kmeans_step(p, points.kmeans_start(p, "fixed")).select("id", F.col("part").cast("int").alias("part"))


@query("pca_split_balance", "SELECT part, count(*)::BIGINT AS n FROM (SELECT (row_number() OVER (ORDER BY id) > (count(*) OVER () // 2))::INT AS part FROM P) GROUP BY part")
def _(s, d):
    return points.pca_split(_root(s, d)).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("cluster_tree_leaves", "SELECT row_number() OVER (ORDER BY lo) - 1 AS tile, lo, hi FROM (WITH RECURSIVE t(lo, hi) AS (SELECT 0::BIGINT, (SELECT count(*) FROM P) UNION ALL SELECT CASE k WHEN 0 THEN lo ELSE lo + (hi - lo) // 2 END, CASE k WHEN 0 THEN lo + (hi - lo) // 2 ELSE hi END FROM t, (VALUES (0), (1)) h(k) WHERE hi - lo >= 100) SELECT * FROM t) WHERE hi - lo < 100")
def _(s, d):
    return points.leaf_table(s, cloud(s, d).count(), 50)


@query("clusterings_cover", "SELECT name, count(*)::BIGINT AS points FROM P CROSS JOIN (VALUES ('2means'), ('cobble'), ('kdtree'), ('natural'), ('pca')) t(name) GROUP BY name")
def _(s, d):
    out = None
    for name in ("2means", "cobble", "kdtree", "natural", "pca"):
        n = points.cluster(cloud(s, d), name, 200).agg(F.lit(name).alias("name"), F.countDistinct("id").alias("points"))
        out = n if out is None else out.unionByName(n)
    return out


# solvers: on a grid of as many points as there are suppliers, b = A x for the balances x; the result is x again

_XN = "SELECT s_suppkey::BIGINT AS i, round(s_acctbal, {digits}) + 0.0 AS v FROM supplier"


def _grid(s, d) -> tuple[DataFrame, DataFrame, int, tuple[int, int, int]]:
    """The Laplace matrix of a grid of ten columns, the balances, the number of points, and the sides."""
    x = balances(s, d)
    n = x.count()
    sides = (10, n // 10, 1)
    return generators.poisson2d(s, *sides[:2]), x, n, sides


@query("poisson_solve", _XN.format(digits=5))
def _(s, d):
    a, x, n, _ = _grid(s, d)
    return rounded(multifrontal.Solver().set_matrix(a, n).solve(sparse.spmv(a, x)).x, digits=5)


@query("poisson_solve_geometric", _XN.format(digits=5))
def _(s, d):
    a, x, n, sides = _grid(s, d)
    o = multifrontal.Options(ordering="geometric", sides=sides, krylov="direct")
    return rounded(multifrontal.Solver(o).set_matrix(a, n).solve(sparse.spmv(a, x)).x, digits=5)


@query("gmres_solve", _XN.format(digits=3))
def _(s, d):
    a, x, _, _ = _grid(s, d)
    return rounded(krylov.gmres(krylov.matrix_operator(a), sparse.spmv(a, x), krylov.jacobi(a), rtol=1e-10).x, digits=3)


@query("bicgstab_solve", _XN.format(digits=3))
def _(s, d):
    a, x, _, _ = _grid(s, d)
    return rounded(krylov.bicgstab(krylov.matrix_operator(a), sparse.spmv(a, x), krylov.jacobi(a), rtol=1e-10).x, digits=3)


@query("mixed_precision_solve", _XN.format(digits=5))
def _(s, d):
    a, x, n, _ = _grid(s, d)
    return rounded(multifrontal.mixed_precision(a, n, sparse.spmv(a, x)).x, digits=5)


@query("factor_statistics", "SELECT (SELECT count(*) FROM supplier WHERE s_acctbal < 0)::BIGINT AS neg, 0::BIGINT AS zero, (SELECT count(*) FROM supplier WHERE s_acctbal > 0)::BIGINT AS pos, 'SUCCESS' AS outcome")
def _(s, d):
    # a diagonal of large balances beside the stencil: it has their signs
    a, x, n, _ = _grid(s, d)
    big = x.select("i", F.col("i").alias("j"), (1000.0 * F.col("v")).alias("v"))
    solver = multifrontal.Solver().set_matrix(sparse.combined(a.where("i <> j"), big), n)
    solver.factor()
    return solver.inertia()


@query("kernel_fit", "SELECT id, CASE WHEN label < 5 THEN -1.0 ELSE 1.0 END::DOUBLE AS v FROM P")
def _(s, d):
    # the weights w of (K + lambda I) w = y, put back: predictions at the training points and lambda w make up the labels
    p = _t(s, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.when(F.col("label") < 5, -1.0).otherwise(1.0).alias("label"))
    model = kernel_regression.KernelRegression(h=0.5, lam=0.5, form="blr", options=structured.Options(rtol=1e-10, leaf=64)).fit(p)
    weights = graph._cut(model.weights)
    model = kernel_regression.Model(weights, "Gauss", 0.5, 1)
    return rounded(model.predict(p).join(weights.select("id", "w"), "id").select("id", (F.col("score") + 0.5 * F.col("w")).alias("v")), digits=4)


@query("kernel_predict", f"SELECT b.id, round(sum((a.id % 3 - 1) * exp(-({_D2}) / 2)), 6) + 0.0 AS score FROM P a CROSS JOIN P b GROUP BY b.id")
def _(s, d):
    p = cloud(s, d)
    model = kernel_regression.Model(p.withColumn("w", (F.col("id") % 3 - 1).cast("double")), "Gauss", 1.0, 1)
    return rounded(model.predict(p), "score", digits=6)
