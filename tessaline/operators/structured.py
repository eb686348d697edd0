"""Compressed dense matrices: BLR tiles, HODLR, HSS, and error-bounded storage of blocks.

Each format is built from a node or tile relation, whose rows are compressed independently of each other, and gives
the same interface: dense, multiply, solve, rank, memory. Blocks live in rows; what is put together on the driver is
the compressed form of one matrix.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.operators import dense
from tessaline.operators.points import halved


@dataclass(frozen=True)
class Options:
    rtol: float = 1e-4
    atol: float = 1e-10
    leaf: int = 128
    max_rank: int = 5000
    method: str = "rrqr"  # or aca, baca


def compressed(block: np.ndarray, o: Options) -> tuple[np.ndarray, np.ndarray]:
    if o.method in ("aca", "baca"):
        how = dense.aca if o.method == "aca" else dense.blocked_aca
        return how(*block.shape, lambda i: block[i], lambda j: block[:, j], rtol=o.rtol, atol=o.atol)
    return dense.low_rank(np.asarray(block), o.rtol, o.atol, o.max_rank)


def one_cell(value, kind):
    """An Arrow array of one value; numbers of a list are not copied."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array([0, value.size], pa.int32()), pa.array(value)) if pa.types.is_list(kind) else pa.array([value], kind)


def compressed_by_halves(f, rows: np.ndarray, cols: np.ndarray, o: Options, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """U and V of the block f(rows, cols), of which no more than most x most values are evaluated at a time: halves are
    compressed and put together; None where factors of a larger block are no smaller than it is."""
    if max(len(rows), len(cols)) <= most:
        return compressed(np.asarray(f(rows, cols), dtype=float), o)
    tall = len(rows) >= len(cols)
    found = []
    for part in np.split(rows if tall else cols, [(len(rows) if tall else len(cols)) // 2]):
        if (half := compressed_by_halves(f, *((part, cols) if tall else (rows, part)), o, most)) is None:
            return None
        found.append((half[1].T, half[0].T) if tall else half)
    # side by side (of a tall block its transpose): [u0 u1] diag(v0, v1)
    (u0, v0), (u1, v1) = found
    q, r = np.linalg.qr(np.hstack([u0, u1]))
    a = u0.shape[1]
    u, v = dense.low_rank(np.hstack([r[:, :a] @ v0, r[:, a:] @ v1]), o.rtol, o.atol, o.max_rank)
    u, v = (v.T, (q @ u).T) if tall else (q @ u, v)
    return (u, v) if u.shape[1] * (len(rows) + len(cols)) < len(rows) * len(cols) else None


def bounds(n: int, leaf: int) -> list[tuple[int, int]]:
    edges = np.r_[0, np.cumsum(halved(n, leaf))]
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def blr_tiles(a: DataFrame, n: int, o: Options = Options(), admissible: DataFrame | None = None) -> DataFrame:
    """ti, tj, kind (dense or low), rank, m, n, u, v: admissible tiles (ti, tj; default: all off the diagonal) as U V."""
    spark = a.sparkSession
    parts = spark.createDataFrame([(k, lo, hi) for k, (lo, hi) in enumerate(bounds(n, o.leaf))], "t long, lo long, hi long")
    inside = lambda c, p: (F.col(c) >= F.col(f"{p}lo")) & (F.col(c) < F.col(f"{p}hi"))
    named = lambda p: parts.select(F.col("t").alias(f"t{p}"), F.col("lo").alias(f"{p}lo"), F.col("hi").alias(f"{p}hi"))
    placed = a.join(F.broadcast(named("i")), inside("i", "i")).join(F.broadcast(named("j")), inside("j", "j"))
    placed = placed.select("ti", "tj", (F.col("i") - F.col("ilo")).alias("r"), (F.col("j") - F.col("jlo")).alias("c"), "v", (F.col("ihi") - F.col("ilo")).alias("m"), (F.col("jhi") - F.col("jlo")).alias("n"))
    if admissible is None:
        placed = placed.withColumn("low", F.col("ti") != F.col("tj"))
    else:
        placed = placed.join(admissible.select("ti", "tj", F.lit(True).alias("low")), ["ti", "tj"], "left").withColumn("low", F.coalesce("low", F.lit(False)))

    def run(t):
        import pyarrow as pa

        first = {k: t[k][0].as_py() for k in ("ti", "tj", "m", "n", "low")}
        d = np.zeros((first["m"], first["n"]))
        np.add.at(d, (np.asarray(t["r"]), np.asarray(t["c"])), np.asarray(t["v"]))
        u, v, kind = d, np.zeros((0, 0)), "dense"
        if first["low"]:
            x, y = compressed(d, o)
            if x.shape[1] * sum(d.shape) < d.size:
                u, v, kind = x, y, "low"
        return pa.table({"ti": [first["ti"]], "tj": [first["tj"]], "kind": [kind], "rank": [int(u.shape[1])], "m": [first["m"]], "n": [first["n"]], "u": pa.array([u.ravel()], pa.list_(pa.float64())), "v": pa.array([v.ravel()], pa.list_(pa.float64()))})

    return placed.groupBy("ti", "tj").applyInArrow(run, "ti bigint, tj bigint, kind string, rank bigint, m bigint, n bigint, u array<double>, v array<double>")


#: A diagonal tile of more rows is kept as a `Halves` (kind "halves") with this leaf; a block of more rows or columns is
#: compressed by halves.
WHOLE, INNER = 1024, 128


def tile_values(row) -> np.ndarray:
    if row["kind"] == "halves":
        return Halves.unpacked(np.asarray(row["u"]), np.asarray(row["v"]), row["m"]).dense()
    u = np.array(row["u"]).reshape(row["m"], -1)
    return u if row["kind"] == "dense" else u @ np.array(row["v"]).reshape(-1, row["n"])


def tile_stats(tiles: DataFrame) -> DataFrame:
    return tiles.agg(F.coalesce(F.max(F.when(F.col("kind") == "low", F.col("rank"))), F.lit(0)).alias("rank"), F.sum(8 * (F.size("u") + F.size("v"))).alias("memory"), F.sum(F.size("u") + F.size("v")).alias("nonzeros"))


def tile_multiply(tiles: DataFrame, x: DataFrame, n: int, leaf: int) -> DataFrame:
    """B x for a vector (i, v): tiles meet the parts of x, products are summed by row. Tiles are larger than Spark estimates,
    so that they must not be broadcast."""
    spark = tiles.sparkSession
    parts = spark.createDataFrame([(k, lo, hi) for k, (lo, hi) in enumerate(bounds(n, leaf))], "t long, lo long, hi long")
    packed = x.join(F.broadcast(parts), (F.col("i") >= F.col("lo")) & (F.col("i") < F.col("hi"))).groupBy(F.col("t").alias("tj"), "lo", "hi").agg(F.collect_list(F.struct((F.col("i") - F.col("lo")).alias("r"), "v")).alias("x"))
    rows = tiles.hint("merge").join(packed.select("tj", "x"), "tj").join(F.broadcast(parts.select(F.col("t").alias("ti"), F.col("lo").alias("ilo"))), "ti")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):  # without a Python object for each number
                at = lambda name: batch.column(name)[k]  # noqa: B023, E731
                ilo, m, n, kind = (at(name).as_py() for name in ("ilo", "m", "n", "kind"))
                u, v, x = (np.asarray(at("u").values), np.asarray(at("v").values), at("x").values)
                part = np.zeros(n)
                part[np.asarray(x.field("r"))] = np.asarray(x.field("v"))
                if kind == "halves":
                    y = Halves.unpacked(u, v, m).multiply(part)
                else:
                    y = u.reshape(m, -1) @ (part if kind == "dense" else v.reshape(-1, n) @ part)
                yield pa.RecordBatch.from_arrays([pa.array(ilo + np.arange(m)), pa.array(y)], names=["i", "v"])

    return rows.select("ilo", "m", "n", "kind", "u", "v", "x").mapInArrow(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v"))


def tile_dense(tiles: DataFrame, n: int, leaf: int) -> np.ndarray:
    edges = bounds(n, leaf)
    out = np.zeros((n, n))
    for r in tiles.collect():
        (a, b), (c, d) = edges[r["ti"]], edges[r["tj"]]
        out[a:b, c:d] = tile_values(r)
    return out


#: Rows of a matrix whose tiles are put together on the driver at most; `tilefactor` factors larger ones where they are.
MOST = 20_000


class BLR:
    """A tile table held as a block matrix, with LU inside diagonal tiles and low-rank updates."""

    def __init__(self, tiles: DataFrame | None, n: int, o: Options = Options()):
        self.n, self.o, self.edges = n, o, bounds(n, o.leaf)
        if tiles is not None and n > MOST:
            raise ValueError(f"{n} rows: factor the tiles with tilefactor.factored instead, which stay distributed")
        self.t = {}
        for r in tiles.collect() if tiles is not None else ():
            u = tile_values(r) if r["kind"] == "halves" else np.array(r["u"]).reshape(r["m"], -1)
            self.t[r["ti"], r["tj"]] = (u, np.array(r["v"]).reshape(-1, r["n"]) if r["kind"] == "low" else None)
        self.orders: list[np.ndarray] = []

    @classmethod
    def of(cls, a: np.ndarray, o: Options = Options()) -> BLR:
        """From a matrix: tiles off the diagonal as U V where that is smaller."""
        b = cls(None, len(a), o)
        for i, (r0, r1) in enumerate(b.edges):
            for j, (c0, c1) in enumerate(b.edges):
                tile = np.array(a[r0:r1, c0:c1], dtype=float)
                u, v = compressed(tile, o) if i != j else (tile, None)
                b.t[i, j] = (u, v) if v is not None and u.shape[1] * sum(tile.shape) < tile.size else (tile, None)
        return b

    def partial_factor(self, upto: int) -> BLR:
        """Eliminates the first tiles only, up to row `upto`, which starts a tile; the others become the Schur complement."""
        steps = next((k for k, (lo, _) in enumerate(self.edges) if lo >= upto), len(self.edges))
        return self.factor(steps)

    def trailing(self, upto: int) -> np.ndarray:
        """What partial_factor leaves of the rows and columns from `upto` on."""
        out = np.zeros((self.n - upto,) * 2)
        for i, (a, b) in enumerate(self.edges):
            for j, (c, d) in enumerate(self.edges):
                if a >= upto and c >= upto:
                    out[a - upto : b - upto, c - upto : d - upto] = self._full(i, j)
        return out

    def trailing_columns(self, upto: int, lo: int, hi: int) -> np.ndarray:
        """Columns lo to hi, counted from `upto` on, of the trailing part; no other tile is looked at."""
        out = np.zeros((self.n - upto, hi - lo))
        for (i, j), (u, v) in self.t.items():
            (a, b), (c, d) = self.edges[i], self.edges[j]
            first, last = max(c, upto + lo), min(d, upto + hi)
            if a >= upto and c >= upto and first < last:
                cols = slice(first - c, last - c)
                out[a - upto : b - upto, first - upto - lo : last - upto - lo] = u[:, cols] if v is None else u @ v[:, cols]
        return out

    @property
    def memory(self) -> int:
        return 8 * sum(u.size + (0 if v is None else v.size) for u, v in self.t.values())

    def _full(self, i: int, j: int) -> np.ndarray:
        if (i, j) not in self.t:
            (a, b), (c, d) = self.edges[i], self.edges[j]
            return np.zeros((b - a, d - c))
        u, v = self.t[i, j]
        return u if v is None else u @ v

    def factor(self, steps: int | None = None) -> BLR:
        nt = len(self.edges)
        for k in range(nt if steps is None else steps):
            f, order = dense.lu(self._full(k, k))
            self.orders.append(order)
            self.t[k, k] = (f, None)
            for j in range(k + 1, nt):
                if (k, j) in self.t:
                    u, v = self.t[k, j]
                    self.t[k, j] = (dense.solve_lower(f, u[order], unit=True), v)
                if (j, k) in self.t:
                    u, v = self.t[j, k]
                    right = u if v is None else v
                    right = dense.solve_lower(f.T, right.T).T
                    self.t[j, k] = (right, None) if v is None else (u, right)
            for i in range(k + 1, nt):
                for j in range(k + 1, nt):
                    if (i, k) in self.t and (k, j) in self.t:
                        self._update(i, j, self.t[i, k], self.t[k, j])
        return self

    def _update(self, i: int, j: int, a, b) -> None:
        """Tile (i, j) less A B: low-rank factors are appended and recompressed."""
        au, av = a
        bu, bv = b
        if av is not None:
            u, v = au, av @ (bu if bv is None else bu @ bv) if bv is None else (av @ bu) @ bv
        elif bv is not None:
            u, v = au @ bu, bv
        else:
            u, v = au @ bu, None
        old_u, old_v = self.t.get((i, j), (None, None))
        if i == j or v is None or old_v is None:
            self.t[i, j] = (self._full(i, j) - (u if v is None else u @ v), None)
            return
        big_u, big_v = np.hstack([old_u, -u]), np.vstack([old_v, v])
        q, r = np.linalg.qr(big_u)
        x, y = dense.low_rank(r @ big_v, self.o.rtol, self.o.atol)
        self.t[i, j] = (q @ x, y)

    def _times(self, i: int, j: int, x: np.ndarray) -> np.ndarray:
        u, v = self.t[i, j]
        return u @ x if v is None else u @ (v @ x)

    def solve(self, b: np.ndarray) -> np.ndarray:
        x, nt = np.array(b, dtype=float), len(self.edges)
        part = lambda k: slice(*self.edges[k])
        for k in range(nt):
            for j in range(k):
                if (k, j) in self.t:
                    x[part(k)] -= self._times(k, j, x[part(j)])
            x[part(k)] = dense.solve_lower(self.t[k, k][0], x[part(k)][self.orders[k]], unit=True)
        for k in reversed(range(nt)):
            for j in range(k + 1, nt):
                if (k, j) in self.t:
                    x[part(k)] -= self._times(k, j, x[part(j)])
            x[part(k)] = dense.solve_upper(self.t[k, k][0], x[part(k)])
        return x


@dataclass
class Node:
    """A node of a binary cluster tree over [lo, hi)."""

    lo: int
    hi: int
    kids: list[Node] = field(default_factory=list)
    data: dict = field(default_factory=dict)

    def walk(self):
        yield self
        for k in self.kids:
            yield from k.walk()

    @property
    def levels(self) -> int:
        return 1 + max((k.levels for k in self.kids), default=0)


def cluster_tree(lo: int, hi: int, leaf: int) -> Node:
    n = hi - lo
    if n < 2 * leaf:
        return Node(lo, hi)
    return Node(lo, hi, [cluster_tree(lo, lo + n // 2, leaf), cluster_tree(lo + n // 2, hi, leaf)])


def cut_levels(t: Node, levels: int) -> Node:
    """The tree with at most so many levels; complete if levels is the least leaf depth."""
    return Node(t.lo, t.hi, [cut_levels(k, levels - 1) for k in t.kids] if levels > 1 else [])


def completed(t: Node, levels: int | None = None) -> Node:
    """The tree with all leaves on the deepest level: shallower leaves are halved, down to parts of nothing."""
    levels = t.levels if levels is None else levels
    if levels == 1:
        return Node(t.lo, t.hi)
    mid = t.lo + (t.hi - t.lo) // 2
    kids = t.kids or [Node(t.lo, mid), Node(mid, t.hi)]
    return Node(t.lo, t.hi, [completed(k, levels - 1) for k in kids])


def tree_rows(t: Node) -> list[tuple[int, int, int, int, int | None]]:
    """node, lo, hi, level, parent in preorder."""
    out: list[tuple[int, int, int, int, int | None]] = []

    def visit(node: Node, level: int, parent: int | None) -> None:
        me = len(out)
        out.append((me, node.lo, node.hi, level, parent))
        for k in node.kids:
            visit(k, level + 1, me)

    visit(t, 0, None)
    return out


class HODLR:
    """Off-diagonal blocks of low rank at each level, full blocks at the leaves."""

    def __init__(self, tree: Node, o: Options):
        self.tree, self.o = tree, o

    @classmethod
    def of(cls, a: np.ndarray, o: Options = Options()) -> HODLR:
        h = cls(cluster_tree(0, len(a), o.leaf), o)
        for t in h.tree.walk():
            if t.kids:
                l, r = t.kids
                t.data["01"] = compressed(a[l.lo : l.hi, r.lo : r.hi], o)
                t.data["10"] = compressed(a[r.lo : r.hi, l.lo : l.hi], o)
            else:
                t.data["d"] = np.array(a[t.lo : t.hi, t.lo : t.hi], dtype=float)
        return h

    def multiply(self, x: np.ndarray, transposed: bool = False) -> np.ndarray:
        def visit(t: Node, x: np.ndarray) -> np.ndarray:
            if not t.kids:
                return (t.data["d"].T if transposed else t.data["d"]) @ x if x.any() else np.zeros(x.shape)
            l, r = t.kids
            xl, xr = x[: l.hi - l.lo], x[l.hi - l.lo :]
            (u, v), (w, z) = t.data["01"], t.data["10"]
            if transposed:
                return np.concatenate([visit(l, xl) + z.T @ (w.T @ xr), visit(r, xr) + v.T @ (u.T @ xl)])
            return np.concatenate([visit(l, xl) + u @ (v @ xr), visit(r, xr) + w @ (z @ xl)])

        return visit(self.tree, np.asarray(x, dtype=float))

    def factor(self) -> HODLR:
        """Per node: solves with the diagonal parts, and the small system that joins them."""

        def visit(t: Node) -> None:
            if not t.kids:
                t.data["lu"] = dense.lu(t.data["d"])
                return
            l, r = t.kids
            visit(l)
            visit(r)
            (u, v), (w, z) = t.data["01"], t.data["10"]
            du, dw = self._solve(l, u), self._solve(r, w)
            ru, rw = u.shape[1], w.shape[1]
            t.data["join"] = (du, dw, dense.lu(np.block([[np.eye(ru), v @ dw], [z @ du, np.eye(rw)]])) if ru + rw else None)

        visit(self.tree)
        return self

    def _solve(self, t: Node, b: np.ndarray) -> np.ndarray:
        if not t.kids:
            return dense.lu_solve(t.data["lu"], b)
        l, r = t.kids
        x, y = self._solve(l, b[: l.hi - l.lo]), self._solve(r, b[l.hi - l.lo :])
        du, dw, small = t.data["join"]
        if small is not None:
            # unknowns: what each side's low-rank part sees of the other side
            s = dense.lu_solve(small, np.concatenate([t.data["01"][1] @ y, t.data["10"][1] @ x]))
            x, y = x - du @ s[: du.shape[1]], y - dw @ s[du.shape[1] :]
        return np.concatenate([x, y])

    def solve(self, b: np.ndarray) -> np.ndarray:
        return self._solve(self.tree, np.asarray(b, dtype=float))

    def dense(self) -> np.ndarray:
        return self.multiply(np.eye(self.tree.hi))

    def columns(self, lo: int, hi: int) -> np.ndarray:
        return self.multiply(np.eye(self.tree.hi, hi - lo, -lo))

    @property
    def rank(self) -> int:
        return max((t.data[k][0].shape[1] for t in self.tree.walk() if t.kids for k in ("01", "10")), default=0)

    @property
    def memory(self) -> int:
        return 8 * sum(x.size for t in self.tree.walk() for k in ("01", "10", "d") if k in t.data for x in (t.data[k] if k != "d" else (t.data[k],)))


class Halves(HODLR):
    """A large tile kept as HODLR, with triangular factors: L U of it with rows exchanged inside leaves, or Cholesky's L."""

    form = ""  # of the factors: lu or chol

    @classmethod
    def by_halves(cls, f, rows: np.ndarray, o: Options, leaf: int, most: int) -> Halves | None:
        """From an element function, no more than most x most values at a time; None where a block isn't of low rank."""
        h = cls(cluster_tree(0, len(rows), leaf), replace(o, leaf=leaf))
        for t in h.tree.walk():
            if t.kids:
                l, r = (rows[k.lo : k.hi] for k in t.kids)
                t.data["01"], t.data["10"] = (compressed_by_halves(f, a, b, o, most) for a, b in ((l, r), (r, l)))
                if t.data["01"] is None or t.data["10"] is None:
                    return None
            else:
                t.data["d"] = np.array(f(rows[t.lo : t.hi], rows[t.lo : t.hi]), dtype=float)
        return h

    def minus(self, u: np.ndarray, v: np.ndarray, t: Node | None = None) -> Halves:
        """Less U V, in place."""
        top = t is None
        t = self.tree if top else t
        if not t.kids:
            t.data["d"] = t.data["d"] - u @ v
            return self
        k = t.kids[0].hi - t.lo
        for name, a, b in (("01", u[:k], v[:, k:]), ("10", u[k:], v[:, :k])):
            x, y = t.data[name]
            q, r = np.linalg.qr(np.hstack([x, -a]))
            x, y = dense.low_rank(r @ np.vstack([y, b]), self.o.rtol, self.o.atol, self.o.max_rank)
            t.data[name] = (q @ x, y)
        self.minus(u[:k], v[:, :k], t.kids[0])
        return self.minus(u[k:], v[:, k:], t.kids[1])

    def triangular(self, symmetric: bool = False, t: Node | None = None) -> Halves:
        """Factors in place: the first half's, the blocks beside it, and the second half's, less their product."""
        self.form = "chol" if symmetric else "lu"
        t = self.tree if t is None else t
        if not t.kids:
            if symmetric:
                t.data["d"] = dense.cholesky(t.data["d"])
            else:
                t.data["d"], t.data["order"] = dense.lu(t.data["d"])
            return self
        l, r = t.kids
        self.triangular(symmetric, l)
        (u, v), (w, z) = t.data["01"], t.data["10"]
        z = self.upper_transposed(z.T, l).T
        u, v = (z.T, w.T) if symmetric else (self.lower(u, l), v)
        t.data["01"], t.data["10"] = (u, v), (w, z)
        self.minus(w @ (z @ u), v, r)
        return self.triangular(symmetric, r)

    def lower(self, b: np.ndarray, t: Node | None = None) -> np.ndarray:
        """y of L y = P b."""
        t = self.tree if t is None else t
        if not t.kids:
            return dense.solve_lower(t.data["d"], b) if self.form == "chol" else dense.solve_lower(t.data["d"], b[t.data["order"]], unit=True)
        l, r = t.kids
        w, z = t.data["10"]
        y = self.lower(b[: l.hi - l.lo], l)
        return np.concatenate([y, self.lower(b[l.hi - l.lo :] - w @ (z @ y), r)])

    def upper(self, b: np.ndarray, t: Node | None = None) -> np.ndarray:
        """x of U x = b, or of L^T x = b."""
        t = self.tree if t is None else t
        if not t.kids:
            return dense.solve_upper(t.data["d"].T if self.form == "chol" else t.data["d"], b)
        l, r = t.kids
        u, v = t.data["01"]
        x = self.upper(b[l.hi - l.lo :], r)
        return np.concatenate([self.upper(b[: l.hi - l.lo] - u @ (v @ x), l), x])

    def upper_transposed(self, b: np.ndarray, t: Node | None = None) -> np.ndarray:
        """x of U^T x = b, or of L x = b."""
        if self.form == "chol":
            return self.lower(b, t)
        t = self.tree if t is None else t
        if not t.kids:
            return dense.solve_lower(t.data["d"].T, b)
        l, r = t.kids
        u, v = t.data["01"]
        y = self.upper_transposed(b[: l.hi - l.lo], l)
        return np.concatenate([y, self.upper_transposed(b[l.hi - l.lo :] - v.T @ (u.T @ y), r)])

    def packed(self) -> tuple[np.ndarray, np.ndarray]:
        """All numbers, and what they are: leaf, ranks, row orders. Cholesky's upper blocks are the lower ones turned over."""
        numbers, ranks, orders = [], [], []
        for t in self.tree.walk():
            for name in ("01", "10")[self.form == "chol" :] if t.kids else ():
                ranks.append(t.data[name][0].shape[1])
                numbers += [a.ravel() for a in t.data[name]]
            if not t.kids:
                numbers.append(t.data["d"].ravel())
                orders += [t.data["order"]] if self.form == "lu" else []
        return np.concatenate(numbers), np.concatenate([[self.o.leaf], ranks, *orders]).astype(float)

    @classmethod
    def unpacked(cls, numbers: np.ndarray, head: np.ndarray, n: int, o: Options = Options(), form: str = "") -> Halves:
        leaf, at, k = int(head[0]), 0, 1
        h = cls(cluster_tree(0, n, leaf), replace(o, leaf=leaf))
        h.form = form
        orders = head[len(head) - n :].astype(int)

        def taken(rows: int, cols: int) -> np.ndarray:
            nonlocal at
            at += rows * cols
            return numbers[at - rows * cols : at].reshape(rows, cols)

        for t in h.tree.walk():
            if t.kids:
                sizes = [x.hi - x.lo for x in t.kids]
                for name, (m, c) in (("01", sizes), ("10", sizes[::-1]))[form == "chol" :]:
                    t.data[name] = (taken(m, int(head[k])), taken(int(head[k]), c))
                    k += 1
                if form == "chol":
                    t.data["01"] = (t.data["10"][1].T, t.data["10"][0].T)
            else:
                t.data["d"] = taken(t.hi - t.lo, t.hi - t.lo)
                if form == "lu":
                    t.data["order"] = orders[t.lo : t.hi]
        return h


class HSS:
    """Nested bases: interpolative rows and columns at the leaves, of the children's choices above."""

    def __init__(self, tree: Node, o: Options):
        self.tree, self.o = tree, o

    @classmethod
    def of(cls, a: np.ndarray, o: Options = Options(), samples: np.ndarray | None = None) -> HSS:
        """From a matrix. With `samples` (n x d, random) bases come from A S and A^T S instead of whole block rows."""
        h, n = cls(cluster_tree(0, len(a), o.leaf), o), len(a)
        depth = h.tree.levels

        def visit(t: Node, level: int) -> tuple[np.ndarray, np.ndarray]:
            if t.kids:
                parts = [visit(k, level + 1) for k in t.kids]
                (r0, c0), (r1, c1) = parts
                t.data["01"], t.data["10"] = a[np.ix_(r0, c1)], a[np.ix_(r1, c0)]
                rows, cols = np.r_[r0, r1], np.r_[c0, c1]
            else:
                rows = cols = np.arange(t.lo, t.hi)
                t.data["d"] = np.array(a[t.lo : t.hi, t.lo : t.hi], dtype=float)
            if level == 0:
                return rows, cols
            out = np.r_[0 : t.lo, t.hi : n]
            block_r, block_c = a[np.ix_(rows, out)], a[np.ix_(out, cols)]
            if samples is not None:
                block_r, block_c = block_r @ samples[out], (block_c.T @ samples[out]).T
            tol = o.rtol / max(1, depth)
            u, keep_r = dense.row_id(block_r, tol, o.atol, o.max_rank)
            v, keep_c = dense.column_id(block_c, tol, o.atol, o.max_rank)
            t.data["u"], t.data["v"] = u, v
            return rows[keep_r], cols[keep_c]

        visit(h.tree, 0)
        return h

    @classmethod
    def sampled(cls, a: np.ndarray, o: Options = Options(), d0: int = 128, grow: int = 64, p: int = 10, seed: int = 0) -> HSS:
        """With random samples, more of them until ranks stay below their number."""
        d = d0
        rng = np.random.default_rng(seed)
        s = rng.standard_normal((len(a), d))
        while True:
            h = cls.of(a, o, s)
            if h.rank < d - p or d >= min(len(a), o.max_rank):
                return h
            s = np.hstack([s, rng.standard_normal((len(a), grow))])
            d += grow

    def multiply(self, x: np.ndarray, transposed: bool = False) -> np.ndarray:
        x = np.asarray(x, dtype=float)
        up, down = ("u", "v") if transposed else ("v", "u")
        flip = (lambda m: m.T) if transposed else (lambda m: m)
        seen: dict[int, np.ndarray] = {}

        def rise(t: Node) -> np.ndarray | None:
            own = np.concatenate([rise(k) for k in t.kids]) if t.kids else x[t.lo : t.hi]
            if up not in t.data:
                return None
            m = t.data[up].T if up == "u" else t.data[up]
            seen[id(t)] = m @ own
            return seen[id(t)]

        def fall(t: Node, f: np.ndarray | None) -> np.ndarray:
            base = None if f is None else (t.data[down] if down == "u" else t.data[down].T) @ f
            if not t.kids:
                own = x[t.lo : t.hi]
                y = flip(t.data["d"]) @ own if own.any() else np.zeros(own.shape)
                return y if base is None else y + base
            l, r = t.kids
            b01, b10 = (t.data["10"].T, t.data["01"].T) if transposed else (t.data["01"], t.data["10"])
            fl, fr = b01 @ seen[id(r)], b10 @ seen[id(l)]
            if base is not None:
                k = len(fl)
                fl, fr = fl + base[:k], fr + base[k:]
            return np.concatenate([fall(l, fl), fall(r, fr)])

        rise(self.tree)
        return fall(self.tree, None)

    def factor(self) -> HSS:
        """ULV: at each node rows are combined so that all but `rank` of them see the node alone, and are eliminated."""

        def visit(t: Node, root: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            if t.kids:
                (d0, u0, v0), (d1, u1, v1) = (visit(k, False) for k in t.kids)
                d = np.block([[d0, u0 @ t.data["01"] @ v1], [u1 @ t.data["10"] @ v0, d1]])
                if not root:
                    u = np.zeros((len(d), t.data["u"].shape[1]))
                    k = u0.shape[1]
                    u[: len(d0)], u[len(d0) :] = u0 @ t.data["u"][:k], u1 @ t.data["u"][k:]
                    c = v0.shape[0]
                    v = np.hstack([t.data["v"][:, :c] @ v0, t.data["v"][:, c:] @ v1])
            else:
                d = t.data["d"]
                u, v = t.data.get("u"), t.data.get("v")
            if root:
                t.data["f"] = dense.lu(d)
                return d, d, d
            n, r = u.shape
            r = min(r, n)
            q, top = np.linalg.qr(u, mode="complete")
            w = q.T @ d
            l, p = lq_full(w[r:])
            # x = p^T z: the first n - r parts of z follow from the lower rows, the others go up
            w1 = w[:r] @ p.T
            t.data["f"] = (q, p, l, w1[:, : n - r], r, n)
            vp = v @ p.T
            t.data["vp"], t.data["top"] = vp[:, : n - r], top[:r]
            return w1[:, n - r :], top[:r], vp[:, n - r :]

        visit(self.tree, True)
        return self

    def solve(self, b: np.ndarray) -> np.ndarray:
        b = np.asarray(b, dtype=float)
        flat = b.ndim == 1
        b = b[:, None] if flat else b
        state: dict[int, tuple] = {}

        def up(t: Node, root: bool) -> tuple[np.ndarray, np.ndarray | None]:
            """The reduced right-hand side, and what the eliminated unknowns give to others through V."""
            if t.kids:
                (b0, g0), (b1, g1) = (up(k, False) for k in t.kids)
                rhs = np.concatenate([b0 - t.kids[0].data["top"] @ (t.data["01"] @ g1), b1 - t.kids[1].data["top"] @ (t.data["10"] @ g0)])
                g = None if root else t.data["v"] @ np.concatenate([g0, g1])
            else:
                rhs, g = b[t.lo : t.hi], None
            if root:
                state[id(t)] = (dense.lu_solve(t.data["f"], rhs),)
                return rhs, None
            q, p, l, w1, r, n = t.data["f"]
            rhs = q.T @ rhs
            z = dense.solve_lower(l, rhs[r:]) if n > r else rhs[r:]
            state[id(t)] = (z,)
            given = t.data["vp"] @ z
            return rhs[:r] - w1 @ z, given if g is None else given + g

        def down(t: Node, y: np.ndarray, out: np.ndarray) -> None:
            if t is not self.tree:
                _, p, _, _, _, _ = t.data["f"]
                y = p.T @ np.concatenate([state[id(t)][0], y])
            if not t.kids:
                out[t.lo : t.hi] = y
                return
            k = t.kids[0].data["f"][4]
            down(t.kids[0], y[:k], out)
            down(t.kids[1], y[k:], out)

        if not self.tree.kids:
            x = dense.lu_solve(self.tree.data["f"], b)
            return x[:, 0] if flat else x
        up(self.tree, True)
        x = np.empty_like(b)
        down(self.tree, state[id(self.tree)][0], x)
        return x[:, 0] if flat else x

    def dense(self) -> np.ndarray:
        return self.multiply(np.eye(self.tree.hi))

    def columns(self, lo: int, hi: int) -> np.ndarray:
        return self.multiply(np.eye(self.tree.hi, hi - lo, -lo))

    def extract_add(self, rows: list[int], cols: list[int], b: np.ndarray) -> np.ndarray:
        """b with A(rows, cols) added, in place."""
        b += self.extract(rows, cols)
        return b

    def get(self, i: int, j: int) -> float:
        return float(self.extract([i], [j])[0, 0])

    def extract(self, rows: list[int], cols: list[int]) -> np.ndarray:
        pick = np.zeros((self.tree.hi, len(cols)))
        pick[cols, np.arange(len(cols))] = 1.0
        return self.multiply(pick)[rows]

    def shifted(self, sigma: float) -> HSS:
        for t in self.tree.walk():
            if "d" in t.data:
                t.data["d"] = t.data["d"] + sigma * np.eye(t.hi - t.lo)
        return self

    @property
    def rank(self) -> int:
        return max((t.data[k].shape[axis] for t in self.tree.walk() for k, axis in (("u", 1), ("v", 0)) if k in t.data), default=0)

    @property
    def memory(self) -> int:
        return 8 * sum(t.data[k].size for t in self.tree.walk() for k in ("u", "v", "d", "01", "10") if k in t.data)

    def rows(self) -> list[tuple]:
        """node, lo, hi, level, parent, name, m, n, data: the form that is written and drawn."""
        return [(k, lo, hi, lv, pa, name, *t.data[name].shape, t.data[name].ravel().tolist()) for (k, lo, hi, lv, pa), t in zip(tree_rows(self.tree), self.tree.walk(), strict=True) for name in ("u", "v", "d", "01", "10") if name in t.data]

    SCHEMA = "node long, lo long, hi long, level long, parent long, name string, m long, n long, data array<double>"

    def table(self, spark: SparkSession) -> DataFrame:
        """The rows, without a Python object for each number."""
        import pyarrow as pa

        found = [(*place, name, *t.data[name].shape, t.data[name]) for place, t in zip(tree_rows(self.tree), self.tree.walk(), strict=True) for name in ("u", "v", "d", "01", "10") if name in t.data]
        kinds = {k: pa.string() if k == "name" else pa.int64() for k in ("node", "lo", "hi", "level", "parent", "name", "m", "n")}
        data = pa.ListArray.from_arrays(np.cumsum([0, *[r[-1].size for r in found]], dtype=np.int32), np.concatenate([r[-1].ravel() for r in found]))
        return spark.createDataFrame(pa.table({**{k: pa.array([r[c] for r in found], kind) for c, (k, kind) in enumerate(kinds.items())}, "data": data}), self.SCHEMA)

    @classmethod
    def from_table(cls, df: DataFrame, o: Options = Options()) -> HSS:
        nodes: dict[int, Node] = {}
        parent = {}
        got = df.orderBy("node").toArrow()
        for k, r in enumerate(got.drop_columns("data").to_pylist()):
            node = nodes.setdefault(r["node"], Node(r["lo"], r["hi"]))
            node.data[r["name"]] = np.array(got["data"][k].values).reshape(r["m"], r["n"])
            parent[r["node"]] = r["parent"]
        for k, p in sorted(parent.items()):
            if p is not None:
                nodes[p].kids.append(nodes[k])
        return cls(nodes[min(nodes)], o)


def lq_full(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """L (square) and a full orthogonal P with A = [L 0] P."""
    q, r = np.linalg.qr(a.T, mode="complete")
    k = a.shape[0]
    return r[:k].T, q.T


def sjlt(rows: int, cols: int, per_row: int, seed: int = 0, chunks: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and signs of a sparse random sketch: per_row entries of 1 or -1 in each row, in distinct columns, or
    one in each of per_row ranges of columns."""
    rng = np.random.default_rng(seed)
    per_row = min(per_row, cols)
    if chunks:
        edges = np.linspace(0, cols, per_row + 1).astype(int)
        j = np.stack([rng.integers(edges[k], max(edges[k] + 1, edges[k + 1]), rows) for k in range(per_row)], axis=1)
    else:
        j = rng.random((rows, cols)).argsort(axis=1)[:, :per_row]
    return np.repeat(np.arange(rows), per_row), j.ravel(), rng.choice([-1.0, 1.0], rows * per_row)


def sketch(spark: SparkSession, rows: int, cols: int, per_row: int, seed: int = 0, chunks: bool = False) -> DataFrame:
    """The sparse sketch as a matrix relation: a product with it is `sparse.gemm`."""
    i, j, v = sjlt(rows, cols, per_row, seed, chunks)
    return spark.createDataFrame(list(zip(i.tolist(), j.tolist(), v.tolist(), strict=True)), "i long, j long, v double")


def tile_extents(tiles: DataFrame, n: int, leaf: int) -> DataFrame:
    """Rows and columns of each tile with kind and rank: the rectangles of a drawing."""
    edges = tiles.sparkSession.createDataFrame([(k, lo, hi) for k, (lo, hi) in enumerate(bounds(n, leaf))], "t long, lo long, hi long")
    i, j = edges.select(F.col("t").alias("ti"), F.col("lo").alias("r0"), F.col("hi").alias("r1")), edges.select(F.col("t").alias("tj"), F.col("lo").alias("c0"), F.col("hi").alias("c1"))
    return tiles.join(i, "ti").join(j, "tj").select("ti", "tj", "r0", "r1", "c0", "c1", "kind", "rank")


def tile_extract(tiles: DataFrame, rows: list[int], cols: list[int], n: int, leaf: int) -> DataFrame:
    """i, j (places in the lists) and v of a sub-matrix: only the tiles that hold it are looked at."""
    spark = tiles.sparkSession
    edges = bounds(n, leaf)
    starts = np.array([lo for lo, _ in edges])

    def named(places: list[int], t: str) -> DataFrame:
        tile = np.searchsorted(starts, places, side="right") - 1
        found = spark.createDataFrame([(int(k), int(p - starts[k]), at) for at, (k, p) in enumerate(zip(tile, places, strict=True))], f"{t} long, r int, at int")
        return found.groupBy(t).agg(F.collect_list(F.struct("r", "at")).alias(f"{t}_at"))

    met = tiles.join(named(rows, "ti"), "ti").join(named(cols, "tj"), "tj").select("kind", "m", "n", "u", "v", "ti_at", "tj_at")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                a = tile_values(r)
                i, j = np.array([x["r"] for x in r["ti_at"]]), np.array([x["r"] for x in r["tj_at"]])
                pi, pj = np.array([x["at"] for x in r["ti_at"]]), np.array([x["at"] for x in r["tj_at"]])
                out.append((np.repeat(pi, len(pj)), np.tile(pj, len(pi)), a[np.ix_(i, j)].ravel()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out]), t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["i", "j", "v"])

    return met.mapInArrow(run, "i bigint, j bigint, v double")


def packed(block: np.ndarray, atol: float = 1e-3) -> bytes:
    """A block rounded to multiples of 2 * atol (error atol at most), deflated; atol 0 keeps all digits."""
    head = np.array([*block.shape, 0], "<i8").tobytes() + np.array([atol], "<f8").tobytes()
    body = block.astype("<f8") if atol == 0 else np.round(block / (2 * atol)).astype("<i8")
    return head + zlib.compress(body.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    m, n, _ = np.frombuffer(data, "<i8", 3)
    atol = float(np.frombuffer(data, "<f8", 1, 24)[0])
    body = zlib.decompress(data[32:])
    return (np.frombuffer(body, "<f8") if atol == 0 else np.frombuffer(body, "<i8") * (2 * atol)).reshape(m, n)
