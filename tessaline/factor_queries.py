"""Queries of factorizations, compressed formats, fronts and files over the test tables, with SQL for their values.

GL are the Gram matrices of the embeddings of each label, with 1 added on the diagonal; XL their points, numbered within
the label; LR are blocks of rank two, one for each nation; K is a smooth kernel of the suppliers' balances, in the order
of the balances.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessaline.functions import kernels
from tessaline.operators import dense, graph, points, sparse, structured, tilefactor
from tessaline.plans import construct, kernel_regression, multifrontal, options
from tessaline.queries import _t, balances, cloud, matrix, query, rounded, suppliers, trade, _TILES
from tessaline.sources import files, generators
from tessaline.sources.folders import shared_path

_VIEWS = """,
GR AS (SELECT label::BIGINT AS g, a.range AS i, b.range AS j, sum(x[a.range + 1] * x[b.range + 1]) AS v FROM P, range(0, 64) a, range(0, 64) b GROUP BY ALL),
GL AS (SELECT g, i, j, v + CASE WHEN i = j THEN 1.0 ELSE 0.0 END AS v FROM GR),
SL AS (SELECT label::BIGINT AS g, k.range AS i, sum(x[k.range + 1]) AS v FROM P, range(0, 64) k GROUP BY ALL),
LR AS (SELECT g, i, k.range AS j, c_acctbal * (k.range + 1) + (c_custkey % 7) * k.range * k.range AS v FROM (SELECT c_nationkey::BIGINT AS g, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, c_acctbal, c_custkey FROM customer), range(0, 25) k),
KX AS (SELECT row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS i, s_acctbal AS x FROM supplier),
K AS (SELECT a.i, b.i AS j, CASE WHEN a.i = b.i THEN 3.0 ELSE 0.0 END + 1.0 / (1.0 + abs(a.x - b.x) / 500.0) AS v FROM KX a, KX b)"""


def grams(s: SparkSession, d: str, added: float = 1.0) -> DataFrame:
    """g, name (a), i, j, v."""
    p = _t(s, d, "embeddings").select(F.col("label").cast("long").alias("node"), F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    half = points.gram(p)
    both = half.select("node", F.col("a").alias("i"), F.col("b").alias("j"), "v").unionByName(half.where("a < b").select("node", F.col("b").alias("i"), F.col("a").alias("j"), "v"))
    return both.select(F.col("node").alias("g"), F.lit("a").alias("name"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), (F.col("v") + F.when(F.col("i") == F.col("j"), added).otherwise(0.0)).alias("v"))


def sums(s: SparkSession, d: str) -> DataFrame:
    """g, i, v: sums of the points of a label, as one column."""
    p = _t(s, d, "embeddings").select(F.col("label").cast("long").alias("g"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    return p.groupBy("g", F.col("i").cast("long").alias("i")).agg(F.sum("x").alias("v"))


def of_label(s: SparkSession, d: str) -> DataFrame:
    """g, name (x), i, j, v: the points of a label as rows of a block."""
    nth = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    p = _t(s, d, "embeddings").select(F.col("label").cast("long").alias("g"), F.lit("x").alias("name"), nth.cast("long").alias("i"), "embedding")
    return p.select("g", "name", "i", F.posexplode(F.col("embedding").cast("array<double>")).alias("j", "v")).withColumn("j", F.col("j").cast("long"))


def with_right_side(a: DataFrame, x: DataFrame) -> DataFrame:
    """The blocks a with b = a x, as blocks of name b."""
    b = a.join(x.select("g", F.col("i").alias("j"), F.col("v").alias("x")), ["g", "j"]).groupBy("g", "i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))
    return a.unionByName(b.select("g", F.lit("b").alias("name"), "i", F.lit(0).cast("long").alias("j"), "v"))


def one(blocks: DataFrame, f, digits: int = 5) -> DataFrame:
    """g, i, j, v of the one block that f makes of each group's."""
    return rounded(dense.on_blocks(blocks, lambda m: {"out": f(m)}).select("g", "i", "j", "v"), digits=digits)


def view(sql: str) -> str:
    return f"{_VIEWS} {sql}"


_SAME = view("SELECT g, i, j, round(v, 5) + 0.0 AS v FROM GL")
_SUMS = view("SELECT g, i, 0::BIGINT AS j, round(v, 5) + 0.0 AS v FROM SL")


# factorizations of blocks: what the factors multiply to, or the known solution


@query("cholesky", _SAME)
def _(s, d):
    def f(m):
        l = dense.cholesky(m["a"])
        return np.tril(l) @ np.tril(l).T

    return one(grams(s, d), f)


@query("cholesky_solve", _SUMS)
def _(s, d):
    return one(with_right_side(grams(s, d), sums(s, d)), lambda m: dense.cholesky_solve(dense.cholesky(m["a"]), m["b"]))


@query("lu", view("SELECT g, i, j, round(v + (i - j) * 0.01, 5) + 0.0 AS v FROM GL"))
def _(s, d):
    def f(m):
        lu, order = dense.lu(m["a"])
        out = np.empty_like(lu)
        out[order] = (np.tril(lu, -1) + np.eye(len(lu))) @ np.triu(lu)
        return out

    return one(grams(s, d).withColumn("v", F.col("v") + (F.col("i") - F.col("j")) * 0.01), f)


@query("lu_solve", _SUMS)
def _(s, d):
    a = grams(s, d).withColumn("v", F.col("v") + (F.col("i") - F.col("j")) * 0.01)
    return one(with_right_side(a, sums(s, d)), lambda m: dense.lu_solve(dense.lu(m["a"]), m["b"]))


@query("ldlt", view("SELECT g, i, j, round(CASE WHEN i = j THEN v - 3.0 ELSE v END, 5) + 0.0 AS v FROM GL"))
def _(s, d):
    def f(m):
        l, diagonal, order = dense.ldlt(m["a"])
        out = np.empty_like(l)
        out[np.ix_(order, order)] = l @ diagonal @ l.T
        return out

    return one(grams(s, d, -2.0), f)


@query("ldlt_solve", _SUMS)
def _(s, d):
    return one(with_right_side(grams(s, d), sums(s, d)), lambda m: dense.ldlt_solve(dense.ldlt(m["a"]), m["b"]))


@query("inertia_of_blocks", view("SELECT g, 64 - count(*) FILTER (v > 0)::BIGINT AS neg, count(*) FILTER (v > 0)::BIGINT AS pos FROM (SELECT g, i, v FROM SL) GROUP BY g"))
def _(s, d):
    # a symmetric matrix that has the signs of the sums as its eigenvalues
    def f(m):
        sign = np.where(m["b"][:, 0] > 0, 1.0, -1.0)
        q = np.linalg.qr(m["a"])[0]
        neg, _, pos = dense.inertia((q * sign) @ q.T)
        return np.array([[neg, pos]])

    b = sums(s, d).select("g", F.lit("b").alias("name"), "i", F.lit(0).cast("long").alias("j"), "v")
    got = dense.on_blocks(grams(s, d).unionByName(b), lambda m: {"out": f(m)})
    return got.groupBy("g").agg(F.max(F.when(F.col("j") == 0, F.col("v"))).cast("long").alias("neg"), F.max(F.when(F.col("j") == 1, F.col("v"))).cast("long").alias("pos"))


@query("lq", view("SELECT g, i, j, round(v, 5) + 0.0 AS v FROM GR"))
def _(s, d):
    def f(m):
        l, q = dense.lq(m["x"].T)
        return np.tril(l) @ (q @ q.T) @ np.tril(l).T

    return one(of_label(s, d), f)


@query("orthogonalize", view("SELECT g, i, j, round(v, 5) + 0.0 AS v FROM GL"))
def _(s, d):
    # an orthonormal basis of all directions gives the matrix back
    def f(m):
        q, most, least = dense.orthogonalized(m["a"])
        assert 0 < least <= most
        return q @ (q.T @ m["a"])

    return one(grams(s, d), f)


_PAIRS = """, T AS (SELECT l_suppkey::BIGINT AS g, sum(l_quantity * l_quantity) AS a, sum(l_quantity * l_discount * 100) AS b, sum(l_discount * l_discount * 10000) AS c FROM lineitem GROUP BY ALL),
 EV AS (SELECT g, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS hi, (a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b) AS lo FROM T)"""


def _quantities(s, d) -> DataFrame:
    """g, name (x), i, j, v: quantity and discount of a supplier's lines."""
    rows = _t(s, d, "lineitem").select(F.col("l_suppkey").cast("long").alias("g"), F.monotonically_increasing_id().alias("id"), F.array(F.col("l_quantity").cast("double"), F.col("l_discount").cast("double") * 100).alias("x"))
    nth = (F.row_number().over(Window.partitionBy("g").orderBy("id")) - 1).cast("long")
    return rows.select("g", F.lit("x").alias("name"), nth.alias("i"), "x").select("g", "name", "i", F.posexplode("x").alias("j", "v")).withColumn("j", F.col("j").cast("long"))


@query("singular_values", f"{_PAIRS} SELECT g, i, 0::BIGINT AS j, round(sqrt(CASE i WHEN 0 THEN hi ELSE lo END), 5) AS v FROM EV, (VALUES (0::BIGINT), (1::BIGINT)) t(i)")
def _(s, d):
    return one(_quantities(s, d), lambda m: dense.singular_values(m["x"]))


@query("symmetric_eigen", f"{_PAIRS} SELECT g, i, 0::BIGINT AS j, round(CASE i WHEN 0 THEN lo ELSE hi END, 3) AS v FROM EV, (VALUES (0::BIGINT), (1::BIGINT)) t(i)")
def _(s, d):
    return one(_quantities(s, d), lambda m: dense.symmetric_eigen(m["x"].T @ m["x"])[0], digits=3)


@query("symmetric_eigen_vectors", _SAME)
def _(s, d):
    def f(m):
        values, vectors = dense.symmetric_eigen(m["a"])
        return (vectors * values) @ vectors.T

    return one(grams(s, d), f)


@query("trmm", view("SELECT a.g, a.i, b.j, round(sum(a.v * b.v), 3) + 0.0 AS v FROM GL a JOIN GL b ON a.g = b.g AND a.j = b.i WHERE a.j <= a.i GROUP BY a.g, a.i, b.j"))
def _(s, d):
    return one(grams(s, d), lambda m: dense.triangular_product(m["a"], m["a"]), digits=3)


@query("trmm_right", view("SELECT a.g, a.i, b.j, round(2 * sum(a.v * b.v), 3) + 0.0 AS v FROM GL a JOIN GL b ON a.g = b.g AND a.j = b.i WHERE b.i <= b.j GROUP BY a.g, a.i, b.j"))
def _(s, d):
    return one(grams(s, d), lambda m: dense.triangular_product(m["a"], m["a"], "right", upper=True, alpha=2.0), digits=3)


@query("trsm", _SAME)
def _(s, d):
    return one(grams(s, d, 60.0), lambda m: dense.triangular_solve(m["a"], dense.triangular_product(m["a"], m["a"] - 59 * np.eye(64))), digits=5)


@query("trsm_right", _SAME)
def _(s, d):
    return one(grams(s, d, 60.0), lambda m: dense.triangular_solve(m["a"], dense.triangular_product(m["a"], m["a"] - 59 * np.eye(64), "right", upper=True, transposed=True), "right", upper=True, transposed=True), digits=5)


@query("trsv", _SUMS)
def _(s, d):
    return one(with_right_side(grams(s, d, 60.0).where("j >= i"), sums(s, d)), lambda m: dense.triangular_solve(m["a"], m["b"], upper=True))


# blocks of rank two


_LOW = view("SELECT g, i, j, round(v, 3) + 0.0 AS v, 2::BIGINT AS rank FROM LR")


def low_blocks(s, d) -> DataFrame:
    nth = (F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1).cast("long")
    c = _t(s, d, "customer").select(F.col("c_nationkey").cast("long").alias("g"), F.lit("a").alias("name"), nth.alias("i"), "c_acctbal", (F.col("c_custkey") % 7).alias("k"))
    c = c.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(24))))
    return c.select("g", "name", "i", F.col("j").cast("long").alias("j"), (F.col("c_acctbal") * (F.col("j") + 1) + F.col("k") * F.col("j") * F.col("j")).cast("double").alias("v"))


def _ranked(s, d, f) -> DataFrame:
    """g, i, j, v of a product of factors, and the rank; f: the product and the rank."""

    def both(m):
        out, rank = f(m["a"])
        return {"out": out, "rank": np.array([[rank]])}

    got = dense.on_blocks(low_blocks(s, d), both)
    rank = got.where("name = 'rank'").select("g", F.col("v").cast("long").alias("rank"))
    return rounded(got.where("name = 'out'").select("g", "i", "j", "v"), digits=3).join(rank, "g")


@query("truncated_qr", _LOW)
def _(s, d):
    def f(a):
        q, r, order, rank = dense.pivoted_qr(a, 1e-9)
        out = np.empty_like(a)
        out[:, order] = q[:, :rank] @ np.triu(r[:rank])
        return out, rank

    return _ranked(s, d, f)


@query("low_rank", _LOW)
def _(s, d):
    def f(a):
        u, v = dense.low_rank(a, 1e-9)
        return u @ v, u.shape[1]

    return _ranked(s, d, f)


@query("column_id", _LOW)
def _(s, d):
    def f(a):
        x, at = dense.column_id(a, 1e-9)
        return a[:, at] @ x, len(at)

    return _ranked(s, d, f)


@query("row_id", _LOW)
def _(s, d):
    def f(a):
        x, at = dense.row_id(a, 1e-9)
        return x @ a[at], len(at)

    return _ranked(s, d, f)


@query("aca", view("SELECT g, i, j, round(v, 3) + 0.0 AS v FROM LR"))
def _(s, d):
    def f(m):
        u, v = dense.aca(*m["a"].shape, lambda i: m["a"][i], lambda j: m["a"][:, j], 1e-11)
        return u @ v

    return one(low_blocks(s, d), f, 3)


@query("blocked_aca", view("SELECT g, i, j, round(v, 3) + 0.0 AS v FROM LR"))
def _(s, d):
    def f(m):
        u, v = dense.blocked_aca(*m["a"].shape, lambda i: m["a"][i], lambda j: m["a"][:, j], 4, 1e-11)
        return u @ v

    return one(low_blocks(s, d), f, 3)


@query("low_rank_step", _LOW)
def _(s, d):
    def f(a):
        rows, cols = list(range(0, len(a), max(1, len(a) // 12))), [0, 1, 2, 3]
        u, v, rank = dense.low_rank_step(a[:, cols], a[np.ix_(rows, cols)], a[rows], 1e-9)
        return u @ v, rank

    return _ranked(s, d, f)


@query("appended_norm", view("SELECT g, round(sqrt(sum(v * v)), 3) AS v FROM LR GROUP BY g"))
def _(s, d):
    def f(m):
        u, v = dense.low_rank(m["a"], 1e-9)
        size = float(np.linalg.norm(u[:, :1] @ v[:1]))
        return dense.appended_norm(u[:, :1], v[:1], size, u[:, 1:], v[1:])[0]

    return one(low_blocks(s, d), f, 3).select("g", "v")


# one large matrix, by tiles


@query("tall_qr", "SELECT a.range AS i, b.range AS j, round(sum(x[a.range + 1] * x[b.range + 1]), 5) + 0.0 AS v FROM P, range(0, 64) a, range(0, 64) b GROUP BY ALL")
def _(s, d):
    r, _ = dense.tall_qr(cloud(s, d).select(F.col("id").alias("i"), "x"))
    return _table(s, r.T @ r, 5)


@query("wide_lq", "SELECT id AS i, k.range AS j, round(x[k.range + 1], 5) + 0.0 AS v FROM P, range(0, 64) k")
def _(s, d):
    # L Q, column by column, is the matrix again
    l, q = dense.wide_lq(cloud(s, d).select(F.col("id").alias("i"), "x"))
    back = F.array(*[F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in row]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) for row in l])
    return rounded(q.select("i", F.posexplode(back).alias("j", "v")).withColumn("j", F.col("j").cast("long")), digits=5)


@query("tall_singular_values", "SELECT round(sqrt(sum(list_sum(list_transform(x, lambda v: v * v)))), 5) AS norm, 64::BIGINT AS n FROM P")
def _(s, d):
    v = dense.tall_singular_values(cloud(s, d).select(F.col("id").alias("i"), "x"))
    return s.createDataFrame([(round(float(np.sqrt((v * v).sum())), 5), len(v))], "norm double, n long")


@query("tall_column_id", view("SELECT c_custkey::BIGINT AS i, k.range AS j, round(c_acctbal * (k.range + 1) + (c_custkey % 7) * k.range * k.range, 3) + 0.0 AS v, 2::BIGINT AS rank FROM customer, range(0, 25) k"))
def _(s, d):
    value = lambda k: (F.col("c_acctbal") * (k + 1) + (F.col("c_custkey") % 7) * k * k).cast("double")
    a = _t(s, d, "customer").select(F.col("c_custkey").cast("long").alias("i"), F.array(*[value(k) for k in range(25)]).alias("x"))
    x, at = dense.tall_column_id(a, 1e-9)
    back = F.array(*[sum((F.element_at("x", int(c) + 1) * float(x[r, k]) for r, c in enumerate(at)), F.lit(0.0)) for k in range(25)])
    return rounded(a.select("i", F.posexplode(back).alias("j", "v")).withColumns({"j": F.col("j").cast("long"), "rank": F.lit(len(at)).cast("long")}), digits=3)


def _rounded(v: np.ndarray, digits: int, error: float = 0.0) -> np.ndarray:
    """Rounded as SQL does: a tie away from zero, which numpy takes to the even digit. Values with an error of their own
    count as a tie if they are no farther from it."""
    scaled = np.abs(v) * 10.0**digits
    down = np.floor(scaled)
    return np.copysign(down + (scaled - down >= 0.5 - error * 10.0**digits), v) / 10.0**digits + 0.0


def _table(s, m: np.ndarray, digits: int) -> DataFrame:
    rows = [(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(_rounded(m, digits))]
    return s.createDataFrame(rows, "i long, j long, v double")


#: Values of a matrix that a task holds at a time where it is written out.
_HELD = 1 << 19


def _columns_table(s, held, n: int, cols: int, digits: int, value=lambda h, lo, hi: h.columns(lo, hi), error: float = 0.0) -> DataFrame:
    """i, j, v of a matrix of n rows that tasks write out, some columns at a time; value makes them of what is held in each task."""
    held, width = s.sparkContext.broadcast(held), max(1, _HELD // max(1, n))
    parts = -(-cols // width)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in batch.column(0).to_pylist():
                lo, hi = k * width, min(cols, (k + 1) * width)
                v = _rounded(value(held.value, lo, hi), digits, error)
                i, j = np.indices(v.shape)
                yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array((j + lo).ravel()), pa.array(v.ravel())], names=["i", "j", "v"])

    return s.range(0, parts, 1, max(1, min(parts, 64))).mapInArrow(run, "i long, j long, v double")


def kernel(s: SparkSession, d: str) -> tuple[np.ndarray, construct.Element, int]:
    """Sorted balances, the elements of K, and its size."""
    x = np.array([r["v"] for r in balances(s, d).orderBy("v", "i").collect()])

    def f(rows, cols):
        at = x[rows][:, None] - x[cols][None]
        return (np.asarray(rows)[:, None] == np.asarray(cols)[None]) * 3.0 + 1.0 / (1.0 + np.abs(at) / 500.0)

    return x, f, len(x)


def _leaf(n: int) -> structured.Options:
    return structured.Options(leaf=max(4, n // 4), rtol=1e-13, atol=1e-14)


def _known_vector(s, x: np.ndarray) -> DataFrame:
    return s.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "i long, v double")


_KX = view("SELECT K.i, round(sum(K.v * KX.x), 3) + 0.0 AS v FROM K JOIN KX ON KX.i = K.j GROUP BY K.i")
_XK = view("SELECT i, round(x, 3) + 0.0 AS v FROM KX")


def _vector(s, v: np.ndarray, digits: int) -> DataFrame:
    return s.createDataFrame([(k, float(x)) for k, x in enumerate(_rounded(v, digits))], "i long, v double")


@query("blr_multiply", _KX)
def _(s, d):
    x, f, n = kernel(s, d)
    tiles = construct.tiles_from_elements(s, f, n, _leaf(n))
    return rounded(structured.tile_multiply(tiles, _known_vector(s, x), n, _leaf(n).leaf), digits=3)


@query("blr_factor_solve", _XK)
def _(s, d):
    x, f, n = kernel(s, d)
    tiles = construct.tiles_from_elements(s, f, n, _leaf(n))
    b = structured.tile_multiply(tiles, _known_vector(s, x), n, _leaf(n).leaf)
    return rounded(tilefactor.solved(tilefactor.factored(tiles, n, _leaf(n)), b, n, _leaf(n)), digits=3)


@query("tile_cholesky_solve", _XK)
def _(s, d):
    x, f, n = kernel(s, d)
    tiles = construct.tiles_from_elements(s, f, n, _leaf(n))
    b = structured.tile_multiply(tiles, _known_vector(s, x), n, _leaf(n).leaf)
    return rounded(tilefactor.solved(tilefactor.factored(tiles, n, _leaf(n), symmetric=True), b, n, _leaf(n)), digits=3)


@query("spd_solve", "SELECT s_suppkey::BIGINT AS i, round(s_acctbal, 4) + 0.0 AS v FROM supplier")
def _(s, d):
    # A A^T of the sparse matrix, scaled, with a diagonal: Cholesky by dense tiles, or by connected parts
    x = balances(s, d)
    n = x.count()
    rows = _t(s, d, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v")).where(F.col("i").between(0, n - 1))
    m = graph._cut(dense.gram_pieces(rows, 1e-4))
    o = structured.Options(leaf=max(8, n // 4), rtol=0.0, atol=0.0)
    return rounded(tilefactor.solved_by_parts(m, tilefactor.piece_multiply(m, x, n, 50.0), n, o, 50.0), digits=4)


@query("blr_extract", view("SELECT K.i, m - K.j AS j, round(v, 6) + 0.0 AS v FROM K, (SELECT max(i) AS m FROM KX)"))
def _(s, d):
    _, f, n = kernel(s, d)
    tiles = construct.tiles_from_elements(s, f, n, _leaf(n))
    return rounded(structured.tile_extract(tiles, list(range(n)), list(range(n - 1, -1, -1)), n, _leaf(n).leaf), digits=6)


@query("blr_extents", view("SELECT sum((r1 - r0) * (c1 - c0))::BIGINT AS area, count(*)::BIGINT AS tiles FROM (SELECT a.lo AS r0, a.hi AS r1, b.lo AS c0, b.hi AS c1 FROM L a, L b)").replace(_VIEWS, _VIEWS + ", L AS (WITH RECURSIVE t(lo, hi) AS (SELECT 0::BIGINT, (SELECT count(*) FROM KX) UNION ALL SELECT CASE k WHEN 0 THEN lo ELSE lo + (hi - lo) // 2 END, CASE k WHEN 0 THEN lo + (hi - lo) // 2 ELSE hi END FROM t, (VALUES (0), (1)) h(k) WHERE hi - lo >= 2 * greatest(4, (SELECT count(*) FROM KX) // 4)) SELECT * FROM t WHERE hi - lo < 2 * greatest(4, (SELECT count(*) FROM KX) // 4))"))
def _(s, d):
    _, f, n = kernel(s, d)
    tiles = construct.tiles_from_elements(s, f, n, _leaf(n))
    return structured.tile_extents(tiles, n, _leaf(n).leaf).agg(F.sum((F.col("r1") - F.col("r0")) * (F.col("c1") - F.col("c0"))).alias("area"), F.count(F.lit(1)).alias("tiles"))


for _form in ("hss", "hodlr"):

    @query(f"{_form}_multiply", _KX)
    def _(s, d, form=_form):
        x, f, n = kernel(s, d)
        return _vector(s, construct.from_elements(f, n, form, _leaf(n)).multiply(x), 3)

    @query(f"{_form}_solve", _XK)
    def _(s, d, form=_form):
        x, f, n = kernel(s, d)
        h = construct.from_elements(f, n, form, _leaf(n))
        return _vector(s, h.factor().solve(f(np.arange(n), np.arange(n)) @ x), 3)

    @query(f"{_form}_dense", view("SELECT i, j, round(v, 6) + 0.0 AS v FROM K"))
    def _(s, d, form=_form):
        _, f, n = kernel(s, d)
        return _columns_table(s, construct.from_elements(f, n, form, _leaf(n)), n, n, 6)


@query("product_matching", view("SELECT i, m - i AS j, true AS scaled FROM KX, (SELECT max(i) AS m FROM KX)"))
def _(s, d):
    # K with its columns turned round: its heavy diagonal is the matching, and scaled entries are 1 there and at most 1 elsewhere
    _, f, n = kernel(s, d)
    a = f(np.arange(n), np.arange(n))[:, ::-1]
    col, r, c = graph.product_matching(a)
    scaled = np.abs(r[:, None] * a * c[None])
    return s.createDataFrame([(k, int(j), bool(abs(scaled[k, j] - 1) < 1e-9 and scaled[k].max() < 1 + 1e-9)) for k, j in enumerate(col)], "i long, j long, scaled boolean")


@query("hss_extract", view("SELECT i, 0::BIGINT AS j, round(v, 6) + 0.0 AS v FROM K WHERE j = 0 UNION ALL SELECT i, 1::BIGINT, round(v, 6) + 0.0 FROM K WHERE j = (SELECT max(i) FROM KX)"))
def _(s, d):
    _, f, n = kernel(s, d)
    return _table(s, construct.from_elements(f, n, "hss", _leaf(n)).extract(list(range(n)), [0, n - 1]), 6)


@query("hss_extract_add", view("SELECT i, 0::BIGINT AS j, round(v + i, 6) + 0.0 AS v FROM K WHERE j = 1"))
def _(s, d):
    _, f, n = kernel(s, d)
    return _table(s, construct.from_elements(f, n, "hss", _leaf(n)).extract_add(list(range(n)), [1], np.arange(float(n))[:, None]), 6)


@query("hss_get", view("SELECT i, round(v, 6) + 0.0 AS v FROM K WHERE i = j"))
def _(s, d):
    _, f, n = kernel(s, d)
    h = construct.from_elements(f, n, "hss", _leaf(n))
    return _vector(s, np.array([h.get(k, k) for k in range(n)]), 6)


@query("hss_shift", view("SELECT i, j, round(v + CASE WHEN i = j THEN 2.5 ELSE 0.0 END, 6) + 0.0 AS v FROM K"))
def _(s, d):
    _, f, n = kernel(s, d)
    return _columns_table(s, construct.from_elements(f, n, "hss", _leaf(n)).shifted(2.5), n, n, 6)


@query("hss_from_products", _KX)
def _(s, d):
    x, f, n = kernel(s, d)
    block = lambda rows, cols: construct.InTasks(s, f, rows, cols)
    a = block(np.arange(n), np.arange(n))
    h = construct.hss_from_products(lambda v: a @ v, lambda v: a.T @ v, f, n, _leaf(n), d0=min(n, 32), grow=16, block=block)
    return _vector(s, h.multiply(x), 3)


@query("hss_stable", _KX)
def _(s, d):
    x, f, n = kernel(s, d)
    block = lambda rows, cols: construct.InTasks(s, f, rows, cols)
    a = block(np.arange(n), np.arange(n))
    return _vector(s, construct.hss_stable(lambda v: a @ v, lambda v: a.T @ v, f, n, _leaf(n), d0=min(n, 16), more=8, block=block).multiply(x), 3)


@query("hss_table", view("SELECT i, j, round(v, 6) + 0.0 AS v FROM K"))
def _(s, d):
    # written as a relation and read again
    _, f, n = kernel(s, d)
    return _columns_table(s, structured.HSS.from_table(construct.from_elements(f, n, "hss", _leaf(n)).table(s), _leaf(n)), n, n, 6)


@query("hss_levels", view("SELECT max(depth)::BIGINT AS levels, count(*) FILTER (hi - lo < 2 * leaf)::BIGINT AS leaves, count(*)::BIGINT AS nodes FROM (WITH RECURSIVE t(lo, hi, depth, leaf) AS (SELECT 0::BIGINT, (SELECT count(*) FROM KX), 1, greatest(4, (SELECT count(*) FROM KX) // 4) UNION ALL SELECT CASE k WHEN 0 THEN lo ELSE lo + (hi - lo) // 2 END, CASE k WHEN 0 THEN lo + (hi - lo) // 2 ELSE hi END, depth + 1, leaf FROM t, (VALUES (0), (1)) h(k) WHERE hi - lo >= 2 * leaf) SELECT * FROM t)"))
def _(s, d):
    n = suppliers(s, d).count()
    tree = structured.cluster_tree(0, n, _leaf(n).leaf)
    rows = s.createDataFrame(structured.tree_rows(tree), "node long, lo long, hi long, level long, parent long")
    parents = rows.where("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct().withColumn("inner", F.lit(True))
    return rows.join(parents, "node", "left").agg((F.max("level") + 1).alias("levels"), F.count_if(F.col("inner").isNull()).alias("leaves"), F.count(F.lit(1)).alias("nodes"))


@query("blr_partial_factor", view("SELECT i - h AS i, j - h AS j, round(v, 6) + 0.0 AS v FROM K, (SELECT hi AS h FROM L WHERE lo = 0) WHERE i >= h AND j >= h").replace(_VIEWS, _VIEWS + ", L AS (WITH RECURSIVE t(lo, hi) AS (SELECT 0::BIGINT, (SELECT count(*) FROM KX) UNION ALL SELECT lo, lo + (hi - lo) // 2 FROM t WHERE hi - lo >= 2 * greatest(4, (SELECT count(*) FROM KX) // 4)) SELECT * FROM t WHERE hi - lo < 2 * greatest(4, (SELECT count(*) FROM KX) // 4))"))
def _(s, d):
    # the Schur complement, and what was taken from it: A21 A11^-1 A12 added again is the block itself
    _, f, n = kernel(s, d)
    a = construct.Elements(f, n)
    b = structured.BLR.of(a, _leaf(n))
    k = b.edges[0][1]
    b.partial_factor(k)
    first, below = (np.asarray(a[at, :k]) for at in (slice(0, k), slice(k, n)))

    def value(held, lo, hi):
        left, solve, below = held
        return left.trailing_columns(k, lo, hi) + below @ (solve @ f(np.arange(k), np.arange(k + lo, k + hi)))

    return _columns_table(s, (b, np.linalg.inv(first), below), n - k, n - k, 6, value, 1e-14)


# the sparse direct solver with compressed fronts: a point of a grid for each part, b = A x for the prices


for _front in ("blr", "hss", "hodlr"):

    @query(f"poisson_solve_{_front}", "SELECT p_partkey::BIGINT AS i, round(p_retailprice, 4) + 0.0 AS v FROM part")
    def _(s, d, front=_front):
        x = sparse.vector(_t(s, d, "part"), "p_partkey", "p_retailprice")
        n = x.count()
        sides = (n // 40, 40, 1) if n >= 1600 else (n // 10, 10, 1)
        a = generators.poisson2d(s, sides[0], sides[1])
        o = multifrontal.Options(ordering="geometric", sides=sides, leaf=256, front=front, compress_from=32, front_leaf=16, rtol=1e-13, atol=1e-15, most=10)
        return rounded(multifrontal.Solver(o).set_matrix(a, n).solve(sparse.spmv(a, x)).x, digits=4)


@query("pivot_growth", "SELECT round(greatest(max(abs(s_acctbal)) * 1000, 1.0) / max(abs(s_acctbal) * 1000), 6) AS growth FROM supplier")
def _(s, d):
    # of a diagonal matrix the pivots are its entries
    x = balances(s, d)
    o = multifrontal.Options(ordering="natural", leaf=x.count())
    solver = multifrontal.Solver(o).set_matrix(x.select("i", F.col("i").alias("j"), (1000.0 * F.col("v")).alias("v")), x.count())
    solver.factor()
    return s.createDataFrame([(round(solver.pivot_growth(), 6),)], "growth double")


@query("factor_subnormals", "SELECT (count(*) * (count(*) - 1))::BIGINT AS zeros, count(*) FILTER (s_suppkey % 3 = 0)::BIGINT AS subnormals FROM supplier")
def _(s, d):
    # one front, whose factors are the diagonal
    x = balances(s, d)
    n = x.count()
    v = F.when(F.col("i") % 3 == 0, F.col("v") * 1e-313).otherwise(F.col("v"))
    solver = multifrontal.Solver(multifrontal.Options(ordering="natural", leaf=n)).set_matrix(x.select("i", F.col("i").alias("j"), v.alias("v")), n)
    solver.factor()
    return solver.subnormals()


def _chain(s, d) -> multifrontal.Solver:
    """Fronts of ten columns each, of a diagonal matrix."""
    x = balances(s, d)
    solver = multifrontal.Solver(multifrontal.Options(ordering="natural", leaf=10)).set_matrix(x.select("i", F.col("i").alias("j"), "v"), x.count())
    solver.reorder()
    return solver


@query("factor_nonzeros", "SELECT (count(*) // 10)::BIGINT AS fronts, (count(*) * 10)::BIGINT AS factor_nonzeros, 10::BIGINT AS largest FROM supplier")
def _(s, d):
    return _chain(s, d).statistics().select("fronts", "factor_nonzeros", "largest")


@query("front_layout", "SELECT i AS lo, i + 10 AS hi, ((SELECT count(*) FROM S) - 1 - i) // 10 AS level FROM S WHERE i % 10 = 0")
def _(s, d):
    return _chain(s, d).layout().select(F.col("begin").alias("lo"), F.col("end").alias("hi"), "level")


@query("update_values", "SELECT s_suppkey::BIGINT AS i, round(s_acctbal, 5) + 0.0 AS v FROM supplier")
def _(s, d):
    # the same pattern, other values: order and tree stay
    x = balances(s, d)
    n = x.count()
    a = generators.poisson2d(s, 10, n // 10)
    solver = multifrontal.Solver().set_matrix(a, n)
    solver.factor()
    b = sparse.shifted(sparse.times(a, 3.0), 2.0, suppliers(s, d))
    return rounded(solver.update_values(b).solve(sparse.spmv(b, x)).x, digits=5)


@query("set_permutation", "SELECT s_suppkey::BIGINT AS i, round(s_acctbal, 5) + 0.0 AS v FROM supplier")
def _(s, d):
    # columns in the order of the balances
    x = balances(s, d)
    n = x.count()
    a = generators.poisson2d(s, 10, n // 10)
    solver = multifrontal.Solver().set_matrix(a, n)
    solver.reorder([r["i"] for r in x.orderBy("v", "i").collect()])
    return rounded(solver.solve(sparse.spmv(a, x)).x, digits=5)


# trees of the trade of nations


@query("elimination_tree", f"{_TILES}, R AS (WITH RECURSIVE r(j, w) AS (SELECT id, id FROM N UNION SELECT r.j, NE.dst FROM r JOIN NE ON NE.src = r.w WHERE r.w <= r.j) SELECT * FROM r) SELECT id AS node, coalesce((SELECT min(w) FROM R WHERE R.j = N.id AND R.w > N.id), -1)::BIGINT AS parent FROM N")
def _(s, d):
    n = _t(s, d, "nation").count()
    parent = graph.elimination_tree(graph.Adjacency.of(trade(s, d), n))
    return s.createDataFrame(list(enumerate(parent)), "node long, parent long")


@query("postorder", f"{_TILES}, R AS (WITH RECURSIVE r(j, w) AS (SELECT id, id FROM N UNION SELECT r.j, NE.dst FROM r JOIN NE ON NE.src = r.w WHERE r.w <= r.j) SELECT * FROM r), P0 AS (SELECT id AS node, (SELECT min(w) FROM R WHERE R.j = N.id AND R.w > N.id) AS parent FROM N) SELECT count(*)::BIGINT AS nodes, count(parent)::BIGINT AS below_their_parent FROM P0")
def _(s, d):
    # every node before its parent
    n = _t(s, d, "nation").count()
    parent = graph.elimination_tree(graph.Adjacency.of(trade(s, d), n))
    order = graph.postorder(parent)
    place = {u: k for k, u in enumerate(order)}
    return s.createDataFrame([(len(set(order)), sum(p >= 0 and place[u] < place[p] for u, p in enumerate(parent)))], "nodes long, below_their_parent long")


# files


@query("matrix_market", "SELECT i, j, v FROM A")
def _(s, d):
    a = matrix(s, d)
    n = _t(s, d, "part").count()
    path = shared_path(s, "matrix-market")
    files.write_matrix_market(a, path, n)
    return files.read_matrix_market(s, path)


@query("binary_matrix", "SELECT i, j, v, 0.0::DOUBLE AS im FROM A")
def _(s, d):
    a = matrix(s, d)
    path = shared_path(s, "binary")
    files.write_binary_parts(a, path, _t(s, d, "part").count())
    return files.read_binary_parts(s, path).select("i", "j", F.col("re").alias("v"), "im")


def _two_columns(s, d) -> DataFrame:
    return _t(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("i"), F.array(F.col("s_acctbal").cast("double"), F.col("s_nationkey").cast("double")).alias("x"))


@query("dense_text", "SELECT s_suppkey::BIGINT AS i, format('[ {:.6e} {:.6e} ]', s_acctbal, s_nationkey::DOUBLE) AS line FROM supplier")
def _(s, d):
    return files.dense_lines(_two_columns(s, d))


@query("sparse_text", "SELECT i, string_agg(j || ':' || v::BIGINT, ' ' ORDER BY j) AS line FROM A GROUP BY i")
def _(s, d):
    return files.sparse_lines(matrix(s, d).withColumn("v", F.col("v").cast("long")))


@query("print_to_file", "SELECT format('{} [ {:.6e} {:.6e} ]', s_suppkey, s_acctbal, s_nationkey::DOUBLE) AS value FROM supplier")
def _(s, d):
    path = shared_path(s, "printed")
    files.print_to_file(files.dense_lines(_two_columns(s, d)), path)
    return s.read.text(path)


@query("dense_binary", "SELECT id AS i, k.range AS j, x[k.range + 1] AS v FROM P, range(0, 64) k")
def _(s, d):
    path = shared_path(s, "dense")
    files.write_dense(cloud(s, d).select(F.col("id").alias("i"), "x"), path)
    return files.read_dense(s, path).select("i", F.posexplode("x").alias("j", "v")).withColumn("j", F.col("j").cast("long"))


# generators, options, numbers


@query("filled", "SELECT i, k.range AS j, (i * 3 + k.range)::DOUBLE AS v FROM S, range(0, 7) k")
def _(s, d):
    n = suppliers(s, d).count()
    return generators.filled(s, n, 7, (F.col("i") * 3 + F.col("j")).cast("double"))


@query("random_moments", "SELECT count(*)::BIGINT * 50 AS n, true AS mean, true AS spread FROM S")
def _(s, d):
    n = suppliers(s, d).count()
    r = generators.random(s, n, 50, 7)
    k = n * 50
    return r.agg(F.count(F.lit(1)).alias("n"), (F.abs(F.avg("v")) < 5 / k**0.5).alias("mean"), (F.abs(F.stddev_pop("v") - 1) < 5 / k**0.5).alias("spread"))


@query("sketch_rows", "SELECT i, 4::BIGINT AS entries, 4.0::DOUBLE AS size FROM S")
def _(s, d):
    # four entries of one or minus one in each row, in different columns
    return structured.sketch(s, suppliers(s, d).count(), 32, 4).groupBy("i").agg(F.countDistinct("j").alias("entries"), F.sum(F.abs("v")).alias("size"))


@query("sketch_chunks", "SELECT i, 4::BIGINT AS chunks FROM S")
def _(s, d):
    return structured.sketch(s, suppliers(s, d).count(), 32, 4, chunks=True).groupBy("i").agg(F.countDistinct(F.expr("j div 8")).alias("chunks"))


@query("sketch_product", "SELECT count(*)::BIGINT AS rows FROM (SELECT DISTINCT i FROM A)")
def _(s, d):
    a = matrix(s, d)
    y = sparse.gemm(a, structured.sketch(s, _t(s, d, "part").agg(F.max("p_partkey")).first()[0] + 1, 32, 4))
    return y.agg(F.countDistinct("i").alias("rows"))


@query("options_from_args", "SELECT r_regionkey::BIGINT AS id, (r_regionkey + 2)::BIGINT AS leaf, ((r_regionkey + 1) / 8.0)::DOUBLE AS rtol, 'hss' AS front FROM region")
def _(s, d):
    rows = []
    for r in _t(s, d, "region").collect():
        k = r["r_regionkey"]
        o = options.from_args(multifrontal.Options, ["--leaf", str(k + 2), f"--rtol={(k + 1) / 8}", "--front", "hss"])
        rows.append((k, o.leaf, o.rtol, o.front))
    return s.createDataFrame(rows, "id long, leaf long, rtol double, front string")


@query("number_format", "SELECT o_orderkey::BIGINT AS id, format('{:,}', (o_totalprice * 100)::BIGINT) AS text FROM orders")
def _(s, d):
    return _t(s, d, "orders").select(F.col("o_orderkey").cast("long").alias("id"), kernels.with_commas(F.expr("bround(o_totalprice * 100)").cast("long")).alias("text"))
