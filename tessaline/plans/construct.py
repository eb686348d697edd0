"""Entry points to the compressed formats: from relations, from element functions, from products with vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tessaline.operators import dense, structured
from tessaline.operators.structured import BLR, HODLR, HSS, Halves, Node, Options, blr_tiles, bounds, cluster_tree, compressed, compressed_by_halves, one_cell

#: f(i, j): values at all pairs of two index arrays, as a matrix.
Element = Callable[[np.ndarray, np.ndarray], np.ndarray]
Product = Callable[[np.ndarray], np.ndarray]
#: A format that is put together on the driver starts from a matrix of so many rows at most.
MOST = 20_000


class Block:
    """A block that evaluates its rows, columns or all of it when asked."""

    def __init__(self, f: Element, rows: np.ndarray, cols: np.ndarray):
        self.f, self.rows, self.cols, self.shape = f, rows, cols, (len(rows), len(cols))

    def __array__(self, dtype=None, copy=None):
        return np.asarray(self.f(self.rows, self.cols), dtype=dtype or float)

    def __getitem__(self, key):
        if isinstance(key, tuple):
            return self.f(self.rows, self.cols[[key[1]]])[:, 0]
        return self.f(self.rows[[key]], self.cols)[0]


#: Values of a matrix that a task evaluates at a time for a product.
_HELD = 1 << 20


class InTasks(Block):
    """A block whose products with vectors are made in tasks, some rows at a time, so that it is never in one place."""

    def __init__(self, spark: SparkSession, f: Element, rows: np.ndarray, cols: np.ndarray):
        super().__init__(f, rows, cols)
        self.spark = spark

    @property
    def T(self) -> InTasks:
        f = self.f
        return InTasks(self.spark, lambda rows, cols: f(cols, rows).T, self.cols, self.rows)

    @property
    def size(self) -> int:
        return len(self.rows) * len(self.cols)

    def ravel(self) -> np.ndarray:
        return np.asarray(self).ravel()

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        if not self.size:
            return np.zeros((len(self.rows), *x.shape[1:]))
        f, step = self.f, max(1, _HELD // len(self.cols))
        held, parts = self.spark.sparkContext.broadcast((self.rows, self.cols, x)), -(-len(self.rows) // step)

        def run(batches):
            import pyarrow as pa

            rows, cols, x = held.value
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    y = np.asarray(f(rows[k * step : (k + 1) * step], cols), float) @ x
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([y.ravel()], pa.list_(pa.float64()))], names=["k", "y"])

        got = self.spark.range(0, parts, 1, min(parts, 24)).mapInArrow(run, "k bigint, y array<double>").toArrow().sort_by("k")
        return np.asarray(got["y"].combine_chunks().flatten()).reshape(len(self.rows), *x.shape[1:])


class Elements:
    """A square matrix behind an element function, with the indexing that the formats use."""

    def __init__(self, f: Element, n: int):
        self.f, self.n = f, n

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, key):
        rows, cols = (np.arange(self.n)[k].ravel() for k in key)
        return Block(self.f, rows, cols) if isinstance(key[0], slice) else np.asarray(self.f(rows, cols), dtype=float)


def collected(a: DataFrame, n: int) -> np.ndarray:
    if n > MOST:
        raise ValueError(f"{n} rows: build tiles instead, which stay distributed")
    rows, out = a.select("i", "j", "v").toPandas(), np.zeros((n, n))
    np.add.at(out, (rows["i"].to_numpy(), rows["j"].to_numpy()), rows["v"].to_numpy())
    return out


def from_relation(a: DataFrame, n: int, form: str = "blr", o: Options = Options()):
    """A tile table for blr; an HSS or HODLR matrix else."""
    if form == "blr":
        return blr_tiles(a, n, o)
    return {"hss": HSS, "hodlr": HODLR}[form].of(collected(a, n), o)


def tiles_from_elements(spark: SparkSession, f: Element, n: int, o: Options = Options()) -> DataFrame:
    """A tile table; every task evaluates and compresses its own tiles, so the matrix is never in one place. A large tile is
    evaluated by pieces: off the diagonal its halves are compressed and put together, on it they are kept so."""
    edges = bounds(n, o.leaf)
    pairs = spark.range(0, len(edges) ** 2, 1, max(1, min(len(edges) ** 2, 64)))
    whole_to, inner = structured.WHOLE, structured.INNER
    kind = "ti bigint, tj bigint, kind string, rank bigint, m bigint, n bigint, u array<double>, v array<double>"

    def run(batches):
        import pyarrow as pa

        real, whole = pa.list_(pa.float64()), pa.int64()
        kinds = {"ti": whole, "tj": whole, "kind": pa.string(), "rank": whole, "m": whole, "n": whole, "u": real, "v": real}
        for batch in batches:
            for p in batch.column(0).to_pylist():
                i, j = divmod(p, len(edges))
                block = Block(f, np.arange(*edges[i]), np.arange(*edges[j]))
                large, u, v, name, rank = max(block.shape) > whole_to, None, np.zeros(0), "dense", 0
                got = None
                if i != j:
                    got = compressed_by_halves(f, block.rows, block.cols, o, whole_to) if large and o.method == "rrqr" else compressed(block, o)
                    if got is not None and got[0].shape[1] * sum(block.shape) < block.shape[0] * block.shape[1]:
                        (u, v), name, rank = got, "low", got[0].shape[1]
                elif large and o.method == "rrqr" and (got := Halves.by_halves(f, block.rows, o, inner, whole_to)) is not None:
                    (u, v), name = got.packed(), "halves"
                if u is None:
                    u, rank = np.asarray(block), block.shape[1]
                values = (i, j, name, rank, *block.shape, u.ravel(), v.ravel())
                yield pa.RecordBatch.from_arrays([one_cell(x, t) for x, t in zip(values, kinds.values(), strict=True)], names=list(kinds))
                del block, got, u, v, values

    return pairs.mapInArrow(run, kind)


def from_elements(f: Element, n: int, form: str = "hodlr", o: Options = Options(method="aca")):
    return {"hss": HSS, "hodlr": HODLR}[form].of(Elements(f, n), o)


def factored_tiles(tiles: DataFrame, n: int, o: Options = Options()) -> BLR:
    return BLR(tiles, n, o).factor()


def hss_from_products(product: Product, transposed: Product, f: Element, n: int, o: Options = Options(), d0: int = 128, grow: int = 64, over: int = 10, seed: int = 0, block=None) -> HSS:
    """HSS from products of A and A^T with random vectors, and single elements.

    A node's samples are what remains of its rows of A S after its own block; children pass on the rows and columns they
    choose. More vectors are drawn, and the old ones kept, until every rank stays below their number. `block` makes the
    leaves' own blocks of their rows and columns, such as InTasks, in place of arrays.
    """
    rng = np.random.default_rng(seed)
    s = rng.standard_normal((n, d0))
    y, z = product(s), transposed(s)
    while True:
        h = HSS(cluster_tree(0, n, o.leaf), o)
        _sampled_node(h.tree, 0, h.tree.levels, f, s, y, z, o, block)
        if h.rank < s.shape[1] - over or s.shape[1] >= min(n, o.max_rank):
            return h
        more = rng.standard_normal((n, grow))
        s, y, z = np.hstack([s, more]), np.hstack([y, product(more)]), np.hstack([z, transposed(more)])


def hss_stable(product: Product, transposed: Product, f: Element, n: int, o: Options = Options(), d0: int = 128, more: int = 8, seed: int = 0, block=None) -> HSS:
    """HSS from products, checked by what they don't know: `more` new vectors at a time, until the products of A and A^T
    with them are those of the compressed matrix, within the tolerance; vectors that were used for checking are kept."""
    rng = np.random.default_rng(seed)
    s = rng.standard_normal((n, d0))
    y, z = product(s), transposed(s)
    while True:
        h = HSS(cluster_tree(0, n, o.leaf), o)
        _sampled_node(h.tree, 0, h.tree.levels, f, s, y, z, o, block)
        new = rng.standard_normal((n, more))
        a, b = product(new), transposed(new)
        far = max(np.linalg.norm(a - h.multiply(new)), np.linalg.norm(b - h.multiply(new, transposed=True)))
        if far <= max(o.rtol * max(np.linalg.norm(a), np.linalg.norm(b)), o.atol) or s.shape[1] >= min(n, o.max_rank) + more:
            return h
        s, y, z = np.hstack([s, new]), np.hstack([y, a]), np.hstack([z, b])


def _sampled_node(t: Node, level: int, depth: int, f: Element, s: np.ndarray, y: np.ndarray, z: np.ndarray, o: Options, block=None):
    """Chosen rows and columns, their samples, and the random vectors as the node's bases see them."""
    if t.kids:
        (r0, c0, y0, z0, v0, u0), (r1, c1, y1, z1, v1, u1) = (_sampled_node(k, level + 1, depth, f, s, y, z, o, block) for k in t.kids)
        b01, b10 = np.asarray(f(r0, c1), float), np.asarray(f(r1, c0), float)
        t.data["01"], t.data["10"] = b01, b10
        rows, cols, right, left = np.r_[r0, r1], np.r_[c0, c1], np.vstack([v0, v1]), np.vstack([u0, u1])
        own_y, own_z = np.vstack([y0 - b01 @ v1, y1 - b10 @ v0]), np.vstack([z0 - b10.T @ u1, z1 - b01.T @ u0])
    else:
        rows = cols = np.arange(t.lo, t.hi)
        d = np.asarray(f(rows, cols), float) if block is None else block(rows, cols)
        t.data["d"], right, left = d, s[t.lo : t.hi], s[t.lo : t.hi]
        own_y, own_z = y[t.lo : t.hi] - d @ right, z[t.lo : t.hi] - d.T @ left
    if level == 0:
        return None
    tol = o.rtol / max(1, depth)
    u, keep_r = dense.row_id(own_y, tol, o.atol, o.max_rank)
    v, keep_c = dense.column_id(own_z.T, tol, o.atol, o.max_rank)
    t.data["u"], t.data["v"] = u, v
    return rows[keep_r], cols[keep_c], own_y[keep_r], own_z[keep_c], v @ right, u.T @ left


def schur_product(h: HSS) -> Product:
    """Products with the Schur complement of the first child of the root: A11 - A10 A00^-1 A01."""
    a, b = h.tree.kids
    first = HSS(_bare(a), h.o).factor()
    second = HSS(_bare(b), h.o)

    def rise(t: Node, x: np.ndarray, lo: int) -> np.ndarray:
        own = np.concatenate([rise(k, x, lo) for k in t.kids]) if t.kids else x[t.lo - lo : t.hi - lo]
        return t.data["v"] @ own

    def fall(t: Node, c: np.ndarray) -> np.ndarray:
        c = t.data["u"] @ c
        if not t.kids:
            return c
        k = t.kids[0].data["u"].shape[1]
        return np.concatenate([fall(t.kids[0], c[:k]), fall(t.kids[1], c[k:])])

    def multiply(x: np.ndarray) -> np.ndarray:
        across = fall(a, h.tree.data["01"] @ rise(b, x, b.lo))
        back = fall(b, h.tree.data["10"] @ rise(a, first.solve(across), a.lo))
        return second.multiply(x) - back

    return multiply


def _bare(t: Node) -> Node:
    """A node as the root of a matrix of its own: numbered from 0, without bases."""

    def moved(n: Node) -> Node:
        return Node(n.lo - t.lo, n.hi - t.lo, [moved(k) for k in n.kids], dict(n.data))

    root = moved(t)
    root.data = {k: v for k, v in root.data.items() if k not in ("u", "v")}
    return root
