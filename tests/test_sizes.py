"""Steps whose memory or time must not follow the size of a table, block or tile."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessaline import factor_queries
from tessaline import queries as q
from tessaline.operators import dense, points, sparse, structured, tilefactor
from tessaline.plans import construct, kernel_regression, multifrontal

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
PAIRS = {
    "dist_euclid": lambda d: np.sqrt((d * d).sum(-1)),
    "dist_l1": lambda d: np.abs(d).sum(-1),
    "kernel_anova_p2": lambda d: ((t := np.exp(-d * d / 2)).sum(-1) ** 2 - (t * t).sum(-1)) / 2,
    "kernel_laplace": lambda d: np.exp(-np.abs(d).sum(-1) / 5.0),
}


@tables
@pytest.mark.parametrize("name", sorted(PAIRS))
def test_no_pair_is_a_row_with_its_points(spark, name):
    got = q.QUERIES[name](spark, DATA)
    assert "arrays_zip" not in got._jdf.queryExecution().optimizedPlan().toString()
    p = {r["id"]: np.array(r["x"]) for r in q.cloud(spark, DATA).collect()}
    rows = got.orderBy(F.xxhash64("id", "other")).limit(2000).collect()
    assert all(abs(r["v"] - PAIRS[name](p[r["id"]] - p[r["other"]])) < 1e-6 for r in rows)


WRITTEN = ["hss_dense", "hodlr_dense", "hss_shift", "hss_table", "blr_partial_factor"]


@tables
@pytest.mark.parametrize("name", WRITTEN)
def test_no_value_of_the_matrix_is_a_row_on_the_driver(spark, name, monkeypatch):
    monkeypatch.setattr(factor_queries, "_table", None)
    n = q.suppliers(spark, DATA).count()
    first = structured.bounds(n, max(4, n // 4))[0][1] if name == "blr_partial_factor" else 0
    monkeypatch.setattr(factor_queries, "_HELD", 3 * n)
    got = q.QUERIES[name](spark, DATA)
    assert got.agg(F.countDistinct("i", "j")).first()[0] == (n - first) ** 2 == got.count()


def test_plans_do_not_grow_with_trees_and_levels(spark):
    p = spark.range(64).select("id", F.array(F.sin("id"), F.cos("id")).alias("x"))
    found, _ = points.approximate_knn(p, 2, 2, goal=2.0)
    assert "Window" not in found._jdf.queryExecution().logical().toString()
    assert found.count() == 128


def test_tiles_of_a_product_go_to_one_task_once(spark):
    a = spark.range(200).select((F.col("id") % 17).alias("i"), (F.col("id") * 7 % 23).alias("j"), (F.col("id") % 5 + 1).cast("double").alias("v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    got = dense.tile_product(dense.tiles(a, 2), dense.tiles(sparse.transpose(a), 2), 2)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    m = np.zeros((17, 23))
    for r in a.collect():
        m[r["i"], r["j"]] = r["v"]
    found = {(r["i"], r["j"]): r["v"] for r in got.collect()}
    assert found == {(int(i), int(j)): (m @ m.T)[i, j] for i, j in np.argwhere(m @ m.T)}


def test_neighbours_reach_the_goal_where_trees_do_not(spark):
    p = spark.range(400).select("id", F.array(*[F.sin(F.col("id") * (k * k + 0.37)) for k in range(12)]).alias("x"))
    assert points.approximate_knn(p, 3, 1, goal=1.0)[1] == 1.0


@pytest.mark.parametrize("how", ["2means", "cobble", "kdtree", "natural", "pca"])
def test_clusters_of_a_small_node_are_those_of_jobs_and_take_few(spark, how, monkeypatch):
    p = spark.range(300).select("id", F.array(*[F.sin(F.col("id") * (k * k + 0.37)) * (k + 1) for k in range(5)]).alias("x"))
    cuts, cut = [], points._cut
    monkeypatch.setattr(points, "_cut", lambda df: cuts.append(1) or cut(df))
    one = {r["id"]: r["node"] for r in points.cluster(p, how, 20).collect()}
    assert len(one) == 300 and len(cuts) == 1
    monkeypatch.setattr(points, "WHOLE", 100)
    assert {r["id"]: r["node"] for r in points.cluster(p, how, 20).collect()} == one


@pytest.mark.parametrize("leaf,at_most", [(48, 8), (30, 38)])
def test_a_large_front_is_factored_by_its_connected_parts(spark, monkeypatch, leaf, at_most):
    # blocks of 8 rows, and rows 0 and 47 that join two of them
    rng = np.random.default_rng(3)
    m = np.kron(np.eye(6), np.ones((8, 8))) * rng.random((48, 48)) + 9 * np.eye(48)
    x, zeros = rng.random(48), []
    m[3, 41] = m[41, 3] = 0.5 if leaf == 30 else 0.0
    i, j = np.nonzero(m)
    a = spark.createDataFrame([(int(r), int(c), float(m[r, c])) for r, c in zip(i, j)], "i long, j long, v double")
    b = spark.createDataFrame([(k, float(v)) for k, v in enumerate(m @ x)], "i long, v double")
    for split in (1 << 20, 10):
        monkeypatch.setattr(multifrontal, "SPLIT", split)
        solver = multifrontal.Solver(multifrontal.Options(ordering="natural", leaf=leaf, krylov="direct")).set_matrix(a, 48)
        got = np.array([r["v"] for r in solver.solve(b).x.orderBy("i").collect()])
        assert np.abs(got - x).max() < 1e-9
        zeros.append(solver.subnormals().first())
    assert zeros[0]["zeros"] == zeros[1]["zeros"]
    assert solver.fronts.agg(F.max(F.size("sep") + F.size("upd"))).first()[0] <= at_most


def test_many_small_tiles_are_factored_together(spark, monkeypatch):
    steps, cut = [], tilefactor._cut
    monkeypatch.setattr(tilefactor, "_cut", lambda df: steps.append(1) or cut(df))
    monkeypatch.setattr(tilefactor, "STEPS", 4)
    n = 90
    train = spark.range(n).select("id", F.array(F.sin("id"), F.cos(F.col("id") * 0.7)).alias("x"), F.when(F.col("id") % 3 == 0, 1.0).otherwise(-1.0).alias("label"))
    how = kernel_regression.KernelRegression(h=0.5, lam=0.5, form="blr", options=structured.Options(rtol=1e-10, leaf=4))
    model = how.fit(train)
    w = {r["id"]: r["w"] for r in model.weights.collect()}
    rows = train.orderBy("id").collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows])
    exact = np.linalg.solve(kernel_regression.kernel_values("Gauss", x, x, 0.5) + 0.5 * np.eye(n), y)
    assert np.abs(np.array([w[k] for k in range(n)]) - exact).max() < 1e-7
    assert len(steps) < 30


@tables
@pytest.mark.parametrize("name", ["hss_from_products", "hss_stable"])
def test_products_evaluate_no_block_on_the_driver(spark, name, monkeypatch):
    sizes = []

    def kernel(s, d):
        x = np.sort(np.random.default_rng(1).random(400)) * 1000.0

        def f(rows, cols):
            sizes.append(len(rows) * len(cols))
            at = x[rows][:, None] - x[cols][None]
            return (np.asarray(rows)[:, None] == np.asarray(cols)[None]) * 3.0 + 1.0 / (1.0 + np.abs(at) / 500.0)

        return x, f, len(x)

    monkeypatch.setattr(factor_queries, "kernel", kernel)
    got = np.array([r["v"] for r in q.QUERIES[name](spark, DATA).orderBy("i").collect()])
    assert max(sizes, default=0) < 100 * 100  # a leaf has as many
    x, f, n = kernel(spark, DATA)
    assert np.abs(got - f(np.arange(n), np.arange(n)) @ x).max() < 1e-2


def test_estimated_sizes_do_not_grow_with_the_steps(spark):
    n, o = 24, structured.Options(leaf=4, rtol=1e-12)
    a = spark.range(n * n).select(F.expr(f"id div {n}").alias("i"), (F.col("id") % n).alias("j"), F.when(F.expr(f"id div {n} = id % {n}"), 30.0).otherwise(F.cos("id")).alias("v"))
    got = tilefactor.factored(structured.blr_tiles(a, n, o), n, o)
    digits = [len(str(x._jdf.queryExecution().analyzed().stats().sizeInBytes())) for step in got.steps for x in step if x is not None]
    assert max(digits) < 25

@pytest.mark.parametrize("symmetric", [False, True])
def test_a_large_tile_is_evaluated_and_factored_by_pieces(spark, symmetric, monkeypatch):
    monkeypatch.setattr(structured, "WHOLE", 32)
    monkeypatch.setattr(structured, "INNER", 12)
    n, o = 230, structured.Options(leaf=57, rtol=1e-13, atol=1e-14)
    at = np.sort(np.random.default_rng(5).random(n)) * 9

    def f(rows, cols):
        assert len(rows) * len(cols) <= 32 * 32
        skew = 0.0 if symmetric else 0.1 * np.sin(at[rows])[:, None]
        return (np.asarray(rows)[:, None] == np.asarray(cols)[None]) * 3.0 + 1 / (1 + np.abs(at[rows][:, None] - at[cols][None])) + skew

    tiles = construct.tiles_from_elements(spark, f, n, o)
    x = np.cos(np.arange(n))
    given = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "i long, v double")
    b = structured.tile_multiply(tiles, given, n, o.leaf)
    whole = np.block([[f(np.arange(i, min(n, i + 30)), np.arange(j, min(n, j + 30))) for j in range(0, n, 30)] for i in range(0, n, 30)])
    assert np.abs(np.array([r["v"] for r in b.orderBy("i").collect()]) - whole @ x).max() < 1e-9
    assert np.abs(structured.tile_dense(tiles, n, o.leaf) - whole).max() < 1e-9
    got = tilefactor.solved(tilefactor.factored(tiles, n, o, symmetric), b, n, o)
    assert np.abs(np.array([r["v"] for r in got.orderBy("i").collect()]) - x).max() < 1e-9


def test_orders_and_patterns_are_no_objects_on_the_driver(spark, monkeypatch):
    from tessaline.sources import generators

    rows = []
    crossing = multifrontal.Solver._crossing

    def counted(self, *args):
        found = crossing(self, *args)
        rows.append(len(found[0]))
        return found

    monkeypatch.setattr(multifrontal.Solver, "_crossing", counted)
    monkeypatch.setattr(type(spark.range(1)), "toPandas", None)
    monkeypatch.setattr(multifrontal, "_SHIPPED", 8)
    a, n = generators.poisson2d(spark, 60, 10), 600
    o = multifrontal.Options(ordering="geometric", sides=(60, 10, 1), leaf=64, krylov="direct")
    solver = multifrontal.Solver(o).set_matrix(a, n)
    b = a.groupBy("i").agg(F.sum(F.col("v") * F.col("j")).alias("v"))
    got = {r["i"]: r["v"] for r in solver.solve(b).x.collect()}
    assert len(got) == n and all(abs(v - k) < 1e-8 for k, v in got.items())
    assert isinstance(solver.order, np.ndarray) and 0 < rows[0] < a.count() / 3


@pytest.mark.parametrize("limit", [1024, 6])
def test_a_product_by_column_ranges_is_the_product(spark, limit, monkeypatch):
    monkeypatch.setattr(dense, "_ROWS", limit)
    monkeypatch.setattr(dense, "_ENTRIES", 16)
    monkeypatch.setattr(dense, "_PRODUCTS", 40)
    a = spark.range(400).select((F.col("id") * 7 % 23).alias("i"), (F.col("id") * 3 % 31).alias("j"), (F.col("id") % 5 + 1).cast("double").alias("v"))
    got = dense.gram_pieces(a, 0.5)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    m, found = np.zeros((23, 31)), np.zeros((23, 23))
    for r in a.collect():
        m[r["i"], r["j"]] += r["v"]
    for r in got.collect():
        assert len(r["v"]) <= 40
        np.add.at(found, (r["i"], r["j"]), r["v"])
    assert (found == np.tril(m @ m.T) * 0.5).all()


def test_connected_parts_of_a_matrix_need_no_tiles(spark, monkeypatch):
    # suppliers 0 to 34 in parts of 7, 35 to 39 without a line
    lines = spark.range(700).select((F.col("id") % 35).alias("l_suppkey"), (F.expr("id % 35 div 7") * 50 + F.col("id") * 11 % 13).alias("l_partkey"), (F.col("id") % 9 + 1).cast("double").alias("l_quantity"))
    made = {"lineitem": lines, "supplier": spark.range(40).select(F.col("id").alias("s_suppkey"), (F.col("id") * 1.25 - 9).alias("s_acctbal"))}
    monkeypatch.setattr(factor_queries, "_t", lambda s, d, name: made[name])
    monkeypatch.setattr(q, "_t", lambda s, d, name: made[name])
    sides, factored = [], tilefactor.factored
    monkeypatch.setattr(tilefactor, "factored", lambda tiles, n, o, symmetric: sides.append(n) or factored(tiles, n, o, symmetric))
    for part, tiled in ((2048, []), (6, [35])):
        monkeypatch.setattr(tilefactor, "PART", part)
        got = {r["i"]: r["v"] for r in q.QUERIES["spd_solve"](spark, "").collect()}
        assert got == {k: k * 1.25 - 9 for k in range(40)}
        assert sides == tiled


def test_ties_are_rounded_as_sql_does(spark):
    # all of them binary fractions, so the seventh digit is exactly 5
    m = np.array([[0.9765625, -0.9765625, 0.0390625], [0.4453125, -0.0078125, 1e-9], [2.0000001, -1e-9, 5.5]])
    want = {(int(i), int(j)): float(np.sign(v) * np.floor(abs(v) * 1e6 + 0.5) / 1e6) for (i, j), v in np.ndenumerate(m)}
    for got in (factor_queries._table(spark, m, 6), factor_queries._columns_table(spark, m, 3, 3, 6, lambda h, lo, hi: h[:, lo:hi]), factor_queries._columns_table(spark, m * (1 - 1e-15), 3, 3, 6, lambda h, lo, hi: h[:, lo:hi], 1e-14)):
        assert {(r["i"], r["j"]): r["v"] for r in got.collect()} == want
    assert [r["v"] for r in factor_queries._vector(spark, m[0], 6).orderBy("i").collect()] == [0.976563, -0.976563, 0.039063]
