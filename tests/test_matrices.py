import numpy as np
import pytest
from pyspark.sql import functions as F

from tessaline.operators import dense, graph, points, sparse, structured, tilefactor
from tessaline.plans import construct, krylov, multifrontal, options
from tessaline.plans.krylov import Outcome
from tessaline.sources import files, generators
from tessaline.streaming import updates


def array(df, n, m=None):
    out = np.zeros((n, m or n))
    for r in df.collect():
        out[r.i, r.j] += r.v
    return out


def relation(spark, a):
    i, j = np.nonzero(a)
    return spark.createDataFrame([(int(x), int(y), float(a[x, y])) for x, y in zip(i, j, strict=True)], "i long, j long, v double")


def vector(spark, x):
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "i long, v double")


def values(df, n):
    out = np.zeros(n)
    for r in df.collect():
        out[r.i] = r.v
    return out


def test_matrix_market_round_trip(spark, tmp_path):
    a = generators.random(spark, 12, 12, 1).where("i % 3 <> j % 2")
    files.write_matrix_market(a, f"{tmp_path}/a", 12)
    assert np.array_equal(array(files.read_matrix_market(spark, f"{tmp_path}/a"), 12), array(a, 12))


@pytest.mark.parametrize("kind,flip", [("symmetric", 1), ("skew-symmetric", -1)])
def test_matrix_market_mirrors(spark, tmp_path, kind, flip):
    (tmp_path / "m.mtx").write_text(f"%%MatrixMarket matrix coordinate real {kind}\n% note\n3 3 3\n1 1 2\n2 1 3.5\n3 2 -1\n")
    a = array(files.read_matrix_market(spark, f"{tmp_path}/m.mtx"), 3)
    assert a[1, 0] == 3.5 and a[0, 1] == flip * 3.5 and a[1, 2] == -flip and a[0, 0] == 2


def test_matrix_market_refuses(spark, tmp_path):
    (tmp_path / "p.mtx").write_text("%%MatrixMarket matrix coordinate pattern general\n2 2 1\n1 1\n")
    (tmp_path / "r.mtx").write_text("%%MatrixMarket matrix coordinate real general\n2 3 1\n1 1 5\n")
    for name in ("p", "r"):
        with pytest.raises(ValueError):
            files.read_matrix_market(spark, f"{tmp_path}/{name}.mtx")


def test_matrix_market_hermitian(spark, tmp_path):
    (tmp_path / "h.mtx").write_text("%%MatrixMarket matrix coordinate complex hermitian\n2 2 2\n1 1 2 0\n2 1 3 4\n")
    got = {(r.i, r.j): (r.v.re, r.v.im) for r in files.read_matrix_market(spark, f"{tmp_path}/h.mtx").collect()}
    assert got == {(0, 0): (2.0, 0.0), (1, 0): (3.0, 4.0), (0, 1): (3.0, -4.0)}


@pytest.mark.parametrize("letter", "sdcz")
def test_binary_codec(letter):
    i, j = np.array([2, 0, 1]), np.array([1, 2, 0])
    v = np.array([1.5, -2.0, 3.0]).astype(files.KINDS[letter])
    a, b, c, n = files.decode_csr(files.encode_csr(i, j, v, 3))
    assert n == 3 and list(zip(a, b, c, strict=True)) == sorted(zip(i, j, v, strict=True))


def test_binary_file(spark, tmp_path):
    a = generators.poisson2d(spark, 4)
    files.write_binary(a, f"{tmp_path}/a.bin", 16)
    assert np.array_equal(array(files.read_binary(spark, f"{tmp_path}/a.bin").withColumn("v", F.col("re")), 16), array(a, 16))


def test_dense_factors():
    rng = np.random.default_rng(0)
    a, b = rng.standard_normal((25, 25)), rng.standard_normal((25, 3))
    assert np.allclose(a @ dense.lu_solve(dense.lu(a), b), b)
    s = a + a.T
    low, d, order = dense.ldlt(s)
    assert np.allclose(s[np.ix_(order, order)], low @ d @ low.T) and np.allclose(s @ dense.ldlt_solve((low, d, order), b), b)
    e = np.linalg.eigvalsh(s)
    assert dense.inertia(s) == ((e < 0).sum(), 0, (e > 0).sum())
    assert dense.inertia(np.diag([1.0, 0.0, -2.0])) == (1, 1, 1)
    l_, q = dense.lq(a)
    assert np.allclose(l_ @ q, a) and np.allclose(np.triu(l_, 1), 0)
    with pytest.raises(ZeroDivisionError):
        dense.lu(np.zeros((2, 2)))
    assert dense.lu(np.zeros((1, 1)), 1e-8)[0][0, 0] == 1e-8


@pytest.mark.parametrize("how", ["rrqr", "aca", "baca"])
def test_low_rank(how):
    rng = np.random.default_rng(1)
    a = rng.standard_normal((40, 6)) @ rng.standard_normal((6, 30))
    u, v = structured.compressed(a, structured.Options(rtol=1e-10, method=how))
    assert np.allclose(u @ v, a) and u.shape[1] <= 8
    x, cols = dense.column_id(a, 1e-10)
    assert np.allclose(a[:, cols] @ x, a) and len(cols) == 6
    x, rows = dense.row_id(a, 1e-10)
    assert np.allclose(x @ a[rows], a)


def test_tall_qr(spark):
    x = np.random.default_rng(2).standard_normal((300, 5))
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "i long, x array<double>").repartition(5)
    r, q = dense.tall_qr(df)
    got = np.array([row.x for row in q.orderBy("i").collect()])
    assert np.allclose(got @ r, x) and np.allclose(got.T @ got, np.eye(5))


@pytest.mark.parametrize("ordering", ["nd", "geometric", "rcm", "amd", "mmd", "natural"])
def test_direct_solver(spark, ordering):
    n = 8
    a = sparse.combined(generators.poisson2d(spark, n), generators.random(spark, n * n, n * n, 4).where("abs(i - j) = 1 and i % 8 > 0 and j % 8 > 0"), 1.0, 0.2)
    x = np.arange(n * n) % 5 - 2.0
    o = multifrontal.Options(ordering=ordering, sides=(n, n, 1), leaf=6)
    s = multifrontal.Solver(o).set_matrix(a, n * n)
    got = s.solve(sparse.spmv(a, vector(spark, x)))
    assert got.outcome is Outcome.SUCCESS and np.allclose(values(got.x, n * n), x, atol=1e-6)
    assert s.statistics().first().fronts >= 4 and s.layout().count() == s.statistics().first().fronts


def test_structure_reuse_and_inertia(spark):
    a = generators.poisson2d(spark, 6)
    s = multifrontal.Solver(multifrontal.Options(leaf=8)).set_matrix(a, 36)
    assert s.factor() is Outcome.SUCCESS and s.inertia().first().pos == 36
    order = s.order
    b = sparse.times(a, 3.0)
    x = np.arange(36.0)
    got = s.update_values(b).solve(sparse.spmv(b, vector(spark, x)))
    assert s.order is order and np.allclose(values(got.x, 36), x, atol=1e-6)
    neg = multifrontal.Solver(multifrontal.Options(leaf=8)).set_matrix(sparse.times(a, -1.0), 36)
    neg.factor()
    assert neg.inertia().first().neg == 36
    assert multifrontal.Solver().reorder() is Outcome.MATRIX_NOT_SET


def test_zero_pivot_and_lossy(spark):
    z = spark.createDataFrame([(0, 1, 1.0), (1, 1, 0.0), (2, 2, 1.0)], "i long, j long, v double")
    assert multifrontal.Solver().set_matrix(z, 3).factor() is Outcome.ZERO_PIVOT
    a, x = generators.poisson2d(spark, 5), np.arange(25) % 3 - 1.0
    got = multifrontal.Solver(multifrontal.Options(leaf=8, lossy=1e-3, rtol=1e-8)).set_matrix(a, 25).solve(sparse.spmv(a, vector(spark, x)))
    assert np.allclose(values(got.x, 25), x, atol=1e-5) and got.iterations >= 1


@pytest.mark.parametrize("solve", [krylov.gmres, krylov.bicgstab])
def test_krylov(spark, solve):
    a, x = generators.poisson2d(spark, 4), np.arange(16) % 3 - 1.0
    op = krylov.matrix_operator(a)
    got = solve(op, sparse.spmv(a, vector(spark, x)), krylov.jacobi(a), rtol=1e-10)
    assert got.outcome is Outcome.SUCCESS and np.allclose(values(got.x, 16), x, atol=1e-7)
    zero = solve(op, vector(spark, np.zeros(16)))
    assert zero.outcome is Outcome.SUCCESS and not values(zero.x, 16).any()


def test_refinement_stops(spark):
    a, x = generators.poisson2d(spark, 3), np.ones(9)
    got = krylov.refine(a, sparse.spmv(a, vector(spark, x)), krylov.jacobi(a), most=3)
    assert got.outcome is Outcome.NO_CONVERGENCE and got.iterations == 3


def test_blr_admissibility_and_extract(spark):
    n, o = 128, structured.Options(leaf=16, rtol=1e-9)
    t = 1.0 / (1.0 + np.abs(np.arange(n)[:, None] - np.arange(n)[None]))
    far = spark.createDataFrame([(i, j) for i in range(8) for j in range(8) if abs(i - j) > 1], "ti long, tj long")
    tiles = structured.blr_tiles(generators.toeplitz(spark, n), n, o, far).persist()
    assert {(r.ti, r.tj) for r in tiles.where("kind = 'low'").collect()} <= {(r.ti, r.tj) for r in far.collect()}
    assert np.allclose(structured.tile_dense(tiles, n, o.leaf), t, atol=1e-7)
    got = structured.tile_extract(tiles, [90, 3], [5, 50, 90], n, o.leaf)
    assert np.allclose(array(got, 2, 3), t[np.ix_([90, 3], [5, 50, 90])], atol=1e-7)
    assert structured.tile_extents(tiles, n, o.leaf).where("r1 - r0 <> 16").count() == 0
    b = np.arange(n) % 4 - 1.0
    assert np.allclose(structured.BLR(tiles, n, o).factor().solve(t @ b), b, atol=1e-5)


@pytest.mark.parametrize("form", [structured.HSS, structured.HODLR])
def test_hierarchical_forms(form):
    n, o = 200, structured.Options(leaf=24, rtol=1e-9)
    d = np.abs(np.arange(n)[:, None] - np.arange(n)[None])
    t = 1.0 / (1.0 + d) + 0.1 * np.triu(1.0 / (2.0 + d), 1)
    h, x = form.of(t, o), np.arange(n) % 4 - 1.0
    assert np.allclose(h.dense(), t, atol=1e-6) and np.allclose(h.multiply(x, True), t.T @ x, atol=1e-6)
    assert h.rank < 24 and h.memory < 8 * n * n and np.allclose(h.factor().solve(t @ x), x, atol=1e-5)


def test_sketch_and_lossy_storage(spark):
    i, j, v = structured.sjlt(50, 20, 4, 1)
    assert len(set(zip(i.tolist(), j.tolist(), strict=True))) == 200 and set(v.tolist()) == {1.0, -1.0}
    assert structured.sketch(spark, 10, 4, 9, chunks=True).count() == 40
    a = np.random.default_rng(0).standard_normal((9, 7))
    assert np.abs(structured.unpacked(structured.packed(a)) - a).max() <= 1e-3 + 1e-12
    assert np.array_equal(structured.unpacked(structured.packed(a, 0.0)), a)


def test_trees():
    t = structured.cluster_tree(0, 100, 10)
    assert sum(not n.kids for n in t.walk()) == 8 and t.levels == 4 and structured.cut_levels(t, 2).levels == 2
    assert points.halved(100, 10) == [n.hi - n.lo for n in t.walk() if not n.kids]
    parent = graph.elimination_tree(graph.Adjacency(4, np.array([0, 1, 2, 1, 2, 3]), np.array([1, 2, 3, 0, 1, 2])))
    assert parent == [1, 2, 3, -1] and graph.postorder(parent) == [0, 1, 2, 3]


def test_singular_matching():
    with pytest.raises(ValueError):
        graph.product_matching(np.array([[1.0, 0.0], [1.0, 0.0]]))


def test_complex_stencil(spark):
    a = generators.helmholtz3d(spark, 3)
    x = spark.range(27).select(F.col("id").alias("i"), F.struct(F.lit(1.0).alias("re"), F.lit(0.0).alias("im")).alias("v"))
    got = {r.i: r.v.im for r in sparse.spmv_complex(a, x).collect()}
    assert set(got.values()) == {-0.5}


@pytest.mark.parametrize("how", ["distance", "farthest", "fixed", "random"])
def test_two_means(spark, how):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.standard_normal((30, 2)), rng.standard_normal((30, 2)) + 50])
    p = spark.createDataFrame([(1, k, r.tolist()) for k, r in enumerate(x)], "node long, id long, x array<double>")
    got = {r.id: r.part for r in points.two_means_split(p, how=how).collect()}
    assert len({got[k] for k in range(30)}) == 1 and len({got[k] for k in range(30, 60)}) == 1 and got[0] != got[59]


def test_options():
    o = options.from_args(multifrontal.Options, ["--leaf", "9", "--rtol=1e-3", "--ordering", "rcm", "--sides", "3,4,5"])
    assert (o.leaf, o.rtol, o.ordering, o.sides) == (9, 1e-3, "rcm", (3, 4, 5)) and "--leaf" in options.described(multifrontal.Options)
    with pytest.raises(ValueError):
        options.from_args(multifrontal.Options, ["--no-such", "1"])


def test_streamed_values(spark, tmp_path):
    generators.poisson2d(spark, 3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("i long, j long, v double").parquet(f"{tmp_path}/in")
    q = updates.running_spmv(stream, vector(spark, np.arange(9.0))).writeStream.outputMode("complete").format("memory").queryName("product").start()
    q.processAllAvailable()
    q.stop()
    want = values(sparse.spmv(generators.poisson2d(spark, 3), vector(spark, np.arange(9.0))), 9)
    assert np.allclose(values(spark.table("product"), 9), want)
    seen = []
    updates.on_update(stream, lambda batch, k: seen.append(batch.count()), f"{tmp_path}/check").awaitTermination(60)
    assert sum(seen) == 33


def kernel(i, j):
    return 1.0 / (1.0 + np.abs(i[:, None] - j[None]))


def test_construction_from_elements_and_products(spark):
    n, o = 160, structured.Options(leaf=20, rtol=1e-9, method="aca")
    t, x = kernel(np.arange(n), np.arange(n)), np.arange(n) % 5 - 2.0
    tiles = construct.tiles_from_elements(spark, kernel, n, o).persist()
    assert np.allclose(structured.tile_dense(tiles, n, o.leaf), t, atol=1e-6)
    assert np.allclose(construct.factored_tiles(tiles, n, o).solve(t @ x), x, atol=1e-5)
    assert np.allclose(construct.from_elements(kernel, n, "hodlr", o).dense(), t, atol=1e-6)
    h = construct.hss_from_products(lambda s: t @ s, lambda s: t.T @ s, kernel, n, o, d0=16, grow=16, over=4)
    assert np.allclose(h.dense(), t, atol=1e-5) and h.rank < 40
    assert np.allclose(construct.from_relation(generators.toeplitz(spark, n), n, "hss", o).factor().solve(t @ x), x, atol=1e-5)
    k = n // 2
    schur = t[k:, k:] - t[k:, :k] @ np.linalg.solve(t[:k, :k], t[:k, k:])
    y = np.random.default_rng(1).standard_normal((n - k, 3))
    assert np.allclose(construct.schur_product(structured.HSS.of(t, o))(y), schur @ y, atol=1e-5)
    with pytest.raises(ValueError):
        construct.collected(generators.toeplitz(spark, 2), construct.MOST + 1)


def test_parts_and_tree_tops():
    near = [(a, b) for a in range(64) for b in (a - 8, a + 8, a - 1 if a % 8 else -1, a + 1 if a % 8 < 7 else -1) if 0 <= b < 64]
    g = graph.Adjacency(64, *np.array(near).T)
    order, sizes = graph.k_way(g, 4)
    assert sorted(order) == list(range(64)) and sizes == [16] * 4
    _, seps = graph.bisection_nd(g)
    top = graph.top_tree(seps, 4)
    assert len(seps) - 1 in top and all(seps[k][2] in top for k in top if seps[k][2] >= 0)
    assert len(graph.subtree(seps, len(seps) - 1)) == len(seps) and graph.subtree(seps, 0) == [(*seps[0][:2], -1)]
    t = structured.completed(structured.cluster_tree(0, 50, 9))
    depth = [lv for _, _, _, lv, _ in structured.tree_rows(t)]
    assert sum(not n.kids for n in t.walk()) == 2 ** max(depth)


# factorizations by tiles, and kernels that the queries don't reach


def _spd(n, seed=3):
    x = np.random.default_rng(seed).standard_normal((n, n))
    return x @ x.T + n * np.eye(n)


@pytest.mark.parametrize("symmetric", [False, True])
def test_tile_factors_solve(spark, symmetric):
    n, o = 24, structured.Options(leaf=6, rtol=1e-12, atol=1e-14)
    a, x = _spd(n), np.arange(n) - 7.0
    a[:6, 18:] = a[18:, :6] = 0  # a tile that isn't there
    factors = tilefactor.factored(structured.blr_tiles(relation(spark, a), n, o), n, o, symmetric)
    assert np.allclose(values(tilefactor.solved(factors, vector(spark, a @ x), n, o), n), x, atol=1e-8)


def test_triangular_kernels():
    rng = np.random.default_rng(0)
    t, b = rng.standard_normal((5, 5)) + 4 * np.eye(5), rng.standard_normal((5, 5))
    for side in ("left", "right"):
        for upper in (False, True):
            for transposed in (False, True):
                for unit in (False, True):
                    m = np.triu(t, 1 if unit else 0) if upper else np.tril(t, -1 if unit else 0)
                    m = m + np.eye(5) if unit else m
                    m = m.T if transposed else m
                    want = 2.0 * (m @ b if side == "left" else b @ m)
                    assert np.allclose(dense.triangular_product(t, b, side, upper, transposed, unit, 2.0), want)
                    assert np.allclose(dense.triangular_solve(t, want, side, upper, transposed, unit, 0.5), b)


def test_cholesky_needs_a_positive_definite_matrix():
    a = _spd(6)
    assert np.allclose(dense.cholesky_solve(dense.cholesky(a), a @ np.ones(6)), 1.0)
    with pytest.raises(ZeroDivisionError):
        dense.cholesky(-a)


@pytest.mark.parametrize("front", ["blr", "hss", "hodlr"])
def test_compressed_fronts(spark, front):
    a, x = generators.poisson2d(spark, 12, 12), np.arange(144) % 7 - 3.0
    o = multifrontal.Options(ordering="geometric", sides=(12, 12, 1), leaf=40, front=front, compress_from=12, front_leaf=6, krylov="direct")
    solver = multifrontal.Solver(o).set_matrix(a, 144)
    got = solver.solve(sparse.spmv(a, vector(spark, x)))
    assert np.allclose(values(got.x, 144), x, atol=1e-5)
    held = solver.factor_bytes().first()
    assert held.fronts > 0 and held.compressed > 0
