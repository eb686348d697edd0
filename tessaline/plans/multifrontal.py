"""Sparse direct solver: nested dissection, symbolic update sets, fronts factored level by level.

The tree of separators has one row per separator and is small; it lives on the driver. Fronts are rows of a relation:
each level of the tree is one job, in which a front gets its entries of A and its children's contributions by joins on
the front's number and is factored by numpy. Solves sweep the levels up and down in the same way.
"""

from __future__ import annotations

import gc
import pickle
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.operators import dense, structured
from tessaline.operators.graph import Adjacency, _connected, bisection_nd, edges, geometric_order, minimum_degree, rcm
from tessaline.operators.sparse import symmetrized
from tessaline.operators.tilefactor import _cut
from tessaline.plans.krylov import Operator, Outcome, Result, gmres, matrix_operator, refine

FRONT = "front bigint, parent bigint, level bigint, sep array<bigint>, upd array<bigint>, f array<double>, order array<bigint>, inner binary, cb array<double>"


@dataclass(frozen=True)
class Options:
    ordering: str = "nd"  # nd, geometric, rcm, amd, mmd, natural
    sides: tuple[int, int, int] | None = None
    leaf: int = 128
    replace_tiny: float = 0.0
    lossy: float = 0.0  # absolute error of stored factors; 0 keeps them
    rtol: float = 1e-6
    atol: float = 1e-10
    most: int = 5000
    krylov: str = "auto"  # auto, direct, refine, gmres
    front: str = "dense"  # dense, blr, hss, hodlr: form of the separators' blocks
    compress_from: int = 64  # rows of a separator from which it is compressed
    front_rtol: float = 1e-8
    front_leaf: int = 32


def _chain(order: list[int], width: int) -> list[tuple[int, int, int]]:
    """Separators of an order without a tree: runs of `width` columns, each the parent of the one before."""
    cuts = list(range(0, len(order), width))
    return [(b, min(b + width, len(order)), k + 1 if k + 1 < len(cuts) else -1) for k, b in enumerate(cuts)]


#: A separator of more columns is factored by its connected parts, each a front of its own, where it has several.
SPLIT = 1024


def _compressed_front(f: np.ndarray, k: int, how: str, o: structured.Options) -> tuple[bytes, np.ndarray]:
    """The front's separator block in a compressed form that solves, with its other blocks as U V; and what its parent gets."""
    core = {"blr": structured.BLR, "hss": structured.HSS, "hodlr": structured.HODLR}[how].of(f[:k, :k], o).factor()
    f12, f21 = (structured.compressed(x, o) if x.size else (x, np.zeros((0, x.shape[1]))) for x in (f[:k, k:], f[k:, :k]))
    cb = f[k:, k:]
    if cb.size:
        cb = cb - f21[0] @ (f21[1] @ core.solve(f12[0]) @ f12[1])
    return pickle.dumps((core, f12, f21)), cb


class Solver:
    def __init__(self, o: Options = Options()):
        self.o, self.a, self.fronts = o, None, None
        self.order: list[int] | np.ndarray | None = None
        self.metrics: dict[str, float] = {}

    def set_matrix(self, a: DataFrame, n: int) -> Solver:
        self.a, self.n, self.fronts = a.persist(), n, None
        return self

    def update_values(self, a: DataFrame) -> Solver:
        """New values of the same pattern: order and tree stay."""
        self.a, self.fronts = a.persist(), None
        return self

    def reorder(self, permutation: list[int] | None = None) -> Outcome:
        if self.a is None:
            return Outcome.MATRIX_NOT_SET
        o = self.o
        if o.ordering == "geometric" and o.sides and permutation is None:
            self.order, seps = geometric_order(o.sides, o.leaf)
            g = None
        else:
            g = Adjacency.of(edges(self.a), self.n)
            if permutation is not None:
                self.order, seps = list(permutation), None
            elif o.ordering == "nd":
                self.order, seps = bisection_nd(g, o.leaf)
            else:
                how = {"rcm": rcm, "amd": minimum_degree, "mmd": lambda g: minimum_degree(g, True), "natural": lambda g: list(range(g.n))}[o.ordering]
                self.order, seps = how(g), None
            seps = seps or _chain(self.order, o.leaf)
        self.seps = seps
        place = np.empty(self.n, np.int64)
        place[np.asarray(self.order)] = np.arange(self.n)
        self.upd = self._symbolic(place, g)
        level = [0] * len(seps)
        for k in range(len(seps) - 1, -1, -1):
            if seps[k][2] >= 0:
                level[k] = level[seps[k][2]] + 1
        self.level = level
        return Outcome.SUCCESS

    def _crossing(self, place: np.ndarray, of: np.ndarray, end: np.ndarray, inside: list[int]) -> list[np.ndarray]:
        """Rows and columns, by their places, of the entries that leave their row's separator or lie inside one of `inside`,
        as tasks find them; the driver gets no others."""
        held = self.a.sparkSession.sparkContext.broadcast((place, of, end, np.isin(np.arange(len(end)), inside)))

        def run(batches):
            import pyarrow as pa

            place, of, end, large = held.value
            for batch in batches:
                i, j = (place[np.asarray(batch.column(k))] for k in (0, 1))
                r, c = np.r_[i, j], np.r_[j, i]
                k = of[r]
                keep = (c >= end[k]) | (large[k] & (c > r))
                yield pa.RecordBatch.from_arrays([pa.array(r[keep]), pa.array(c[keep])], names=["r", "c"])

        found = self.a.select(F.col("i").cast("long"), F.col("j").cast("long")).where("i <> j").mapInArrow(run, "r bigint, c bigint").toArrow()
        return [found[name].to_numpy() for name in ("r", "c")]

    def _symbolic(self, place: np.ndarray, g) -> list[np.ndarray]:
        """Update sets, children first: columns of A beyond the separator, and the children's beyond it."""
        above: list[set[int]] = [set() for _ in self.seps]
        of = np.empty(self.n, np.int64)
        for k, (b, e, _) in enumerate(self.seps):
            of[b:e] = k
        inside: dict[int, list[tuple[int, int]]] = {k: [] for k, (b, e, _) in enumerate(self.seps) if e - b > SPLIT}
        if g is not None:
            p = place.tolist()
            pairs = ((p[u], p[v]) for u in range(self.n) for v in g.near[u])
        else:
            r, c = self._crossing(place, of, np.array([e for _, e, _ in self.seps]), list(inside))
            pairs = zip(r.tolist(), c.tolist(), strict=True)
        beyond: list[dict[int, set[int]]] = [{} for _ in self.seps]
        for r, c in pairs:
            k = int(of[r])
            if c >= self.seps[k][1]:
                above[k].add(c)
                if k in inside:
                    beyond[k].setdefault(r, set()).add(c)
            elif k in inside and c > r:
                inside[k].append((r, c))
        for k, (_, _, parent) in enumerate(self.seps):
            if parent >= 0:
                end = self.seps[parent][1]
                above[parent] |= {c for c in above[k] if c >= end}
        upd = [np.array(sorted(s), np.int64) for s in above]
        self._split(of, upd, inside, beyond)
        return upd

    def _split(self, of: np.ndarray, upd: list[np.ndarray], inside: dict[int, list[tuple[int, int]]], beyond: list[dict[int, set[int]]]) -> None:
        """The fronts that are factored: those of the tree, with a large separator's connected parts as fronts of their own.

        Parts have no entries between each other, and get none: what a child leaves joins all columns it reaches. A front
        hangs below the one that has the first column it reaches.
        """
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.outside = 0
        owner = np.empty(self.n, np.int64)
        reached: list[list[np.ndarray]] = [[] for _ in self.seps]  # what children reach of a large separator
        for k, (b, e, _) in enumerate(self.seps):
            groups = [(np.arange(b, e), upd[k])]
            if k in inside:
                joined = [np.array(inside[k], np.int64).reshape(-1, 2) - b]
                for u in reached[k]:
                    mine = u[u < e] - b
                    joined.append(np.c_[np.full(len(mine), mine[0]), mine])
                label = _connected(e - b, np.concatenate(joined))
                by = np.argsort(label, kind="stable")
                cuts = np.flatnonzero(np.diff(label[by])) + 1
                seps = [np.sort(x) + b for x in np.split(by, cuts)]
                more: dict[int, set[int]] = {}
                for r, cs in beyond[k].items():
                    more.setdefault(int(label[r - b]), set()).update(cs)
                for u in reached[k]:
                    more.setdefault(int(label[u[0] - b]), set()).update(u[u >= e].tolist())
                groups = [(x, np.array(sorted(more.get(int(label[x[0] - b]), ())), np.int64)) for x in seps]
                self.outside += (e - b + len(upd[k])) ** 2 - sum((len(x) + len(u)) ** 2 for x, u in groups)
            for sep, u in groups:
                owner[sep] = len(self.parts)
                self.parts.append((sep, u))
                if len(u) and int(of[u[0]]) in inside:
                    reached[int(of[u[0]])].append(u)
        self.above = [int(owner[u[0]]) if len(u) else -1 for _, u in self.parts] if inside else [p for _, _, p in self.seps]
        self.depth = [0] * len(self.parts)
        for k in range(len(self.parts) - 1, -1, -1):
            if self.above[k] >= 0:
                self.depth[k] = self.depth[self.above[k]] + 1

    def factor(self) -> Outcome:
        if self.order is None:
            if (got := self.reorder()) is not Outcome.SUCCESS:
                return got
        spark = self.a.sparkSession
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")
        import pyarrow as pa

        at = np.empty(self.n, np.int64)
        at[np.asarray(self.order)] = np.arange(self.n)
        place = _made(spark, pa.table({"old": np.arange(self.n), "new": at}), "old long, new long")
        rows = place.select(F.col("old").alias("i"), F.col("new").alias("ni"))
        cols = place.select(F.col("old").alias("j"), F.col("new").alias("nj"))
        a = symmetrized(self.a).join(rows, "i").join(cols, "j").select(F.col("ni").alias("i"), F.col("nj").alias("j"), "v")
        lists = [pa.ListArray.from_arrays(np.cumsum([0, *map(len, x)], dtype=np.int32), np.concatenate([np.zeros(0, np.int64), *x])) for x in zip(*self.parts, strict=True)] if self.parts else [pa.array([], pa.list_(pa.int64()))] * 2
        numbers = (np.arange(len(self.parts)), np.array(self.above, np.int64), np.array(self.depth, np.int64))
        tree = _made(spark, pa.table([*map(pa.array, numbers), *lists], names=["front", "parent", "level", "sep", "upd"]), "front long, parent long, level long, sep array<long>, upd array<long>").persist()
        owner = tree.select("front", F.explode("sep").alias("at"))
        # an entry belongs to the front that eliminates the first of its row and column
        entries = a.withColumn("at", F.least("i", "j")).join(owner, "at").groupBy("front").agg(F.collect_list(F.struct("i", "j", "v")).alias("entries")).persist()
        tiny, how, least = self.o.replace_tiny, self.o.front, self.o.compress_from
        inside = structured.Options(rtol=self.o.front_rtol, atol=1e-14, leaf=self.o.front_leaf)

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                out = {k: [] for k in ("front", "parent", "level", "sep", "upd", "f", "order", "inner", "cb")}
                for r in batch.to_pylist():
                    sep, upd = np.array(r["sep"], np.int64), np.array(r["upd"], np.int64)
                    index, k = np.r_[sep, upd], len(sep)
                    f = np.zeros((len(index),) * 2)
                    for e in r["entries"] or ():
                        f[np.searchsorted(index, e["i"]), np.searchsorted(index, e["j"])] += e["v"]
                    for c in r["kids"] or ():
                        at = np.searchsorted(index, np.array(c["upd"], np.int64))
                        f[np.ix_(at, at)] += np.array(c["cb"]).reshape(len(at), len(at))
                    order, inner = np.arange(k), None
                    if how != "dense" and k >= least:
                        inner, cb = _compressed_front(f, k, how, inside)
                        f = np.zeros(0)
                    elif k:
                        lu, order = dense.lu(f[:k, :k], tiny)
                        f12 = dense.solve_lower(lu, f[:k, k:][order], unit=True)
                        f21 = dense.solve_lower(lu.T, f[k:, :k].T).T
                        f[:k, :k], f[:k, k:], f[k:, :k] = lu, f12, f21
                        f[k:, k:] -= f21 @ f12
                    if inner is None:
                        cb = f[k:, k:].copy()
                        f[k:, k:] = 0
                    for name, v in (("front", r["front"]), ("parent", r["parent"]), ("level", r["level"]), ("sep", r["sep"]), ("upd", r["upd"]), ("f", f.ravel().tolist()), ("order", order.tolist()), ("inner", inner), ("cb", cb.ravel().tolist())):
                        out[name].append(v)
                whole, real = pa.list_(pa.int64()), pa.list_(pa.float64())
                kinds = {"front": pa.int64(), "parent": pa.int64(), "level": pa.int64(), "sep": whole, "upd": whole, "f": real, "order": whole, "inner": pa.binary(), "cb": real}
                yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kinds.items()], names=list(kinds))

        done, below = None, None
        try:
            for lv in range(max(self.depth, default=-1), -1, -1):
                now = tree.where(F.col("level") == lv).join(entries, "front", "left")
                if below is None:
                    now = now.withColumn("kids", F.lit(None).cast("array<struct<upd:array<bigint>,cb:array<double>>>"))
                else:
                    kids = below.groupBy(F.col("parent").alias("front")).agg(F.collect_list(F.struct("upd", "cb")).alias("kids"))
                    now = now.join(kids, "front", "left")
                below = _cut(now.select("front", "parent", "level", "sep", "upd", "entries", "kids").mapInArrow(run, FRONT))
                kept = below.drop("cb")
                done = kept if done is None else done.unionByName(kept)
                _collected(spark)
        except Exception as e:
            if "ZeroDivisionError" in str(e):
                return Outcome.ZERO_PIVOT
            raise
        self.fronts = done if not self.o.lossy else _rounded(done, self.o.lossy)
        self.fronts = self.fronts.persist()
        self.place = place
        return Outcome.SUCCESS

    def apply(self, b: DataFrame) -> DataFrame:
        """The solution of the factored system for one vector (i, v), by sweeps over the levels."""
        x = b.join(self.place, F.col("i") == F.col("old")).select(F.col("new").alias("i"), "v")
        top = max(self.depth, default=-1)
        parts = self.fronts.select("front", "parent", "level", "sep", "upd", "f", "order", "inner").persist()
        values, up = x, {}
        for lv in range(top, -1, -1):
            now = _gathered(parts.where(F.col("level") == lv), values, "sep")
            got = _cut(now.mapInArrow(_forward, "i bigint, v double, kind int"))
            up[lv] = got.where("kind = 0").select("i", "v")
            values = _cut(values.unionByName(got.where("kind = 1").select("i", "v")).groupBy("i").agg(F.sum("v").alias("v")))
            if lv % 4 == 0:
                _collected(b.sparkSession)
        solved = None
        for lv in range(top + 1):
            now = parts.where(F.col("level") == lv)
            mine = _gathered(now, up[lv], "sep")
            if solved is not None:
                seen = _gathered(now.select("front", "upd"), solved, "upd").select("front", F.col("x").alias("y"))
                mine = mine.join(seen, "front", "left")
            else:
                mine = mine.withColumn("y", F.lit(None).cast("array<struct<i:bigint,v:double>>"))
            got = _cut(mine.select("front", "sep", "upd", "f", "order", "inner", "x", "y").mapInArrow(_backward, "i bigint, v double"))
            solved = got if solved is None else _cut(solved.unionByName(got))
            if lv % 4 == 3:
                _collected(b.sparkSession)
        return solved.join(self.place, F.col("i") == F.col("new")).select(F.col("old").alias("i"), "v")

    def solve(self, b: DataFrame) -> Result:
        if self.fronts is None and (got := self.factor()) is not Outcome.SUCCESS:
            return Result(b, got, 0, float("nan"))
        o = self.o
        how = o.krylov if o.krylov != "auto" else ("gmres" if o.lossy else "refine")
        if how == "direct":
            return Result(self.apply(b), Outcome.SUCCESS, 0, float("nan"))
        m: Operator = self.apply
        if how == "gmres":
            return gmres(matrix_operator(self.a), b, m, rtol=o.rtol, atol=o.atol, most=o.most)
        return refine(self.a, b, m, rtol=o.rtol, atol=o.atol, most=o.most)

    def report(self, b: DataFrame) -> tuple[Result, DataFrame]:
        """A solve, and a row per phase of what it took: seconds, iterations, residual."""
        import time

        rows, begin = [], time.perf_counter()
        for name, step in (("reorder", lambda: self.order is not None or self.reorder()), ("factor", lambda: self.fronts or self.factor())):
            step()
            rows.append((name, time.perf_counter() - begin, None, None))
            begin = time.perf_counter()
        got = self.solve(b)
        rows.append(("solve", time.perf_counter() - begin, got.iterations, got.residual))
        return got, self.a.sparkSession.createDataFrame(rows, "phase string, seconds double, iterations long, residual double")

    def layout(self) -> DataFrame:
        """front, level, begin, end and update size of each front: the rectangles of a drawing."""
        rows = [(k, lv, b, e, len(u)) for k, ((b, e, _), lv, u) in enumerate(zip(self.seps, self.level, self.upd, strict=True))]
        return self.a.sparkSession.createDataFrame(rows, "front long, level long, begin long, end long, upd long")

    def statistics(self) -> DataFrame:
        """fronts, factor_nonzeros, largest front, levels: from the tree alone."""
        spark = self.a.sparkSession
        rows = [(e - b, len(u)) for (b, e, _), u in zip(self.seps, self.upd, strict=True)]
        return spark.createDataFrame([(len(rows), sum(s * (s + 2 * u) for s, u in rows), max((s + u for s, u in rows), default=0), max(self.level, default=-1) + 1)], "fronts long, factor_nonzeros long, largest long, levels long")

    def factor_bytes(self) -> DataFrame:
        """Bytes of dense and of compressed fronts, and how many are compressed."""
        return self.fronts.agg(F.sum(8 * F.size("f")).cast("long").alias("dense"), F.coalesce(F.sum(F.octet_length("inner")), F.lit(0)).cast("long").alias("compressed"), F.count("inner").alias("fronts"))

    def subnormals(self) -> DataFrame:
        """Zeros and numbers too small to be normal in the stored factors; zeros between the parts of a front count as well."""
        from tessaline.operators.sparse import odd_values

        return odd_values(self.fronts.select(F.explode("f").alias("v"))).withColumn("zeros", F.col("zeros") + F.lit(self.outside).cast("long"))

    def diagonals(self) -> DataFrame:
        """i and the pivot at i, of all fronts."""
        k = F.size("sep") + F.size("upd")
        return self.fronts.select(F.posexplode("sep").alias("p", "i"), "f", k.alias("k")).select("i", F.element_at("f", F.col("p") * F.col("k") + F.col("p") + 1).alias("v"))

    def inertia(self) -> DataFrame:
        """Negative, zero and positive pivots; exact for symmetric matrices whose fronts needed no row exchange."""
        moved = self.fronts.where(F.exists(F.zip_with("order", F.sequence(F.lit(0), F.size("order") - 1), lambda a, b: a != b), lambda x: x) & (F.size("order") > 0)).limit(1).count()
        outcome = (Outcome.INACCURATE_INERTIA if moved else Outcome.SUCCESS).name
        return self.diagonals().agg(F.count_if(F.col("v") < 0).alias("neg"), F.count_if(F.col("v") == 0).alias("zero"), F.count_if(F.col("v") > 0).alias("pos")).withColumn("outcome", F.lit(outcome))

    def pivot_growth(self) -> float:
        from tessaline.operators.sparse import norm1

        u = self.diagonals().agg(F.max(F.abs("v"))).first()[0] or 0.0
        return max(u, 1.0) / norm1(self.a).first()[0]


#: Rows of a table from which on tasks get it as a broadcast, and not as part of each task's message from the driver.
_SHIPPED = 1 << 14


def _collected(spark: SparkSession) -> None:
    """Shuffle files and tables of a step stay until the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


def _made(spark: SparkSession, table, schema: str) -> DataFrame:
    """An Arrow table of the driver's as a DataFrame."""
    if table.num_rows < _SHIPPED and table.nbytes < 16 * _SHIPPED:
        return spark.createDataFrame(table, schema)
    held, n = spark.sparkContext.broadcast(table), table.num_rows
    parts = max(1, min(24, -(-table.nbytes // (1 << 20))))

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield from held.value[k * n // parts : (k + 1) * n // parts].to_batches()

    return spark.range(0, parts, 1, parts).mapInArrow(run, schema)


def _rounded(fronts: DataFrame, atol: float) -> DataFrame:
    """Factors within atol of what they are, as they come back from lossy storage."""
    return fronts.withColumn("f", F.transform("f", lambda v: F.round(v / (2 * atol)) * (2 * atol)))


def _gathered(fronts: DataFrame, x: DataFrame, column: str) -> DataFrame:
    """fronts with x: the entries (i, v) of a vector at the numbers in a column."""
    at = fronts.select("front", F.explode(column).alias("i")).join(x, "i").groupBy("front").agg(F.collect_list(F.struct("i", "v")).alias("x"))
    return fronts.join(at, "front", "left")


def _vector(entries, index: np.ndarray) -> np.ndarray:
    out = np.zeros(len(index))
    for e in entries or ():
        out[np.searchsorted(index, e["i"])] = e["v"]
    return out


def _forward(batches):
    import pyarrow as pa

    for batch in batches:
        i, v, kind = [], [], []
        for r in batch.to_pylist():
            sep, upd = np.array(r["sep"], np.int64), np.array(r["upd"], np.int64)
            k = len(sep)
            x = _vector(r["x"], sep)
            if r["inner"] is not None:
                core, _, (u, w) = pickle.loads(r["inner"])
                y = core.solve(x)
                i += [sep, upd]
                v += [y, -(u @ (w @ y)) if len(upd) else np.zeros(0)]
                kind += [np.zeros(k, np.int32), np.ones(len(upd), np.int32)]
                continue
            f = np.array(r["f"]).reshape(k + len(upd), -1) if k + len(upd) else np.zeros((0, 0))
            y = dense.solve_lower(f[:k, :k], x[np.array(r["order"], np.int64)], unit=True) if k else x
            i += [sep, upd]
            v += [y, -(f[k:, :k] @ y)]
            kind += [np.zeros(k, np.int32), np.ones(len(upd), np.int32)]
        if i:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(i)), pa.array(np.concatenate(v)), pa.array(np.concatenate(kind))], names=["i", "v", "kind"])


def _backward(batches):
    import pyarrow as pa

    for batch in batches:
        i, v = [], []
        for r in batch.to_pylist():
            sep, upd = np.array(r["sep"], np.int64), np.array(r["upd"], np.int64)
            k = len(sep)
            if not k:
                continue
            if r["inner"] is not None:
                core, (u, w), _ = pickle.loads(r["inner"])
                i.append(sep)
                v.append(_vector(r["x"], sep) - (core.solve(u @ (w @ _vector(r["y"], upd))) if len(upd) else 0.0))
                continue
            f = np.array(r["f"]).reshape(k + len(upd), -1)
            y = _vector(r["x"], sep) - f[:k, k:] @ _vector(r["y"], upd)
            i.append(sep)
            v.append(dense.solve_upper(f[:k, :k], y))
        if i:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(i)), pa.array(np.concatenate(v))], names=["i", "v"])


def mixed_precision(a: DataFrame, n: int, b: DataFrame, o: Options = Options(rtol=1e-14)) -> Result:
    """Factors of the matrix in single precision, refinement in double."""
    s = Solver(o)
    s.set_matrix(a.withColumn("v", F.col("v").cast("float").cast("double")), n)
    if (got := s.factor()) is not Outcome.SUCCESS:
        return Result(b, got, 0, float("nan"))
    return refine(a, b, s.apply, rtol=o.rtol, atol=o.atol, most=o.most)
