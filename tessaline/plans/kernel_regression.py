"""Kernel ridge regression: (K + lambda I) w = y, predictions by sums over the training points.

Training points are clustered and the kernel matrix is compressed in that order. In form blr its tiles are made from
blocks of points, factored and solved in tasks, so no more than a tile is ever in one place. The forms dense, hss and
hodlr are put together on the driver and raise ValueError beyond `construct.MOST` points. Prediction takes any number of
test points.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.operators import dense, points, tilefactor
from tessaline.operators.graph import _cut
from tessaline.operators.structured import HODLR, HSS, Options, bounds, compressed
from tessaline.plans import construct


def kernel_values(name: str, x: np.ndarray, y: np.ndarray, h: float, p: int = 1) -> np.ndarray:
    if name.lower() == "laplace":
        return np.exp(-points.summed(x, y, np.abs)[0] / h)
    if name.lower() == "anova":
        power = points.summed(x, y, lambda d: np.exp(-(d * d) / (2 * h * h)), p)
        e = [np.ones((len(x), len(y)))]
        for k in range(1, p + 1):
            e.append(sum((-1) ** (s + 1) * e[k - s] * power[s - 1] for s in range(1, k + 1)) / k)
        return e[p]
    return np.exp(-points.squared_distances(x, y) / (2 * h * h))


@dataclass
class Model:
    weights: DataFrame  # id, x, w
    kernel: str
    h: float
    p: int

    def predict(self, test: DataFrame) -> DataFrame:
        """id and score: the sum of w k(x, t) over training points, blocks of both at a time."""
        name, h, p = self.kernel, self.h, self.p
        train = self.weights.select("id", F.concat("x", F.array("w")).alias("x"))

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for q_ids, q, _, xw in points._matrices(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array(kernel_values(name, q, xw[:, :-1], h, p) @ xw[:, -1])], names=["id", "s"])

        parts = points.block_pairs(test, train).mapInArrow(run, "id bigint, s double")
        return parts.groupBy("id").agg(F.sum("s").alias("score"))

    def classify(self, test: DataFrame) -> DataFrame:
        return self.predict(test).select("id", "score", F.when(F.col("score") >= 0, 1.0).otherwise(-1.0).alias("label"))


@dataclass(frozen=True)
class KernelRegression:
    """kernel: Gauss, Laplace or ANOVA; form: blr, dense, hss or hodlr; clustering as in points.cluster."""

    kernel: str = "Gauss"
    h: float = 1.0
    lam: float = 1.0
    p: int = 1
    form: str = "hss"
    clustering: str = "cobble"
    options: Options = Options(rtol=1e-6)

    def fit(self, train: DataFrame) -> Model:
        """train: id, x, label."""
        leaves = points.cluster(train.select("id", "x"), self.clustering, self.options.leaf)
        order = points.leaf_order(leaves)
        if self.form == "blr":
            return self._fit_tiles(train, _cut(order))
        if (n := train.count()) > construct.MOST:
            raise ValueError(f"{n} points: fit form blr instead, whose tiles stay distributed")
        rows = train.join(order, "id").orderBy("place").select("id", "x", "label").toPandas()
        x, y = np.array(rows["x"].tolist(), dtype=float), rows["label"].to_numpy(float)
        k = kernel_values(self.kernel, x, x, self.h, self.p) + self.lam * np.eye(len(x))
        if self.form == "dense":
            w = dense.lu_solve(dense.lu(k), y)
        else:
            w = (HSS if self.form == "hss" else HODLR).of(k, self.options).factor().solve(y)
        table = train.sparkSession.createDataFrame([(int(i), float(v)) for i, v in zip(rows["id"], w, strict=True)], "id long, w double")
        return Model(train.select("id", "x").join(table, "id"), self.kernel, self.h, self.p)

    def _fit_tiles(self, train: DataFrame, order: DataFrame) -> Model:
        n = order.count()
        o = tilefactor.sized(n, self.options)
        placed = _cut(train.join(order, "id").select("id", "x", "label", F.col("place").alias("i")))
        try:
            factors = tilefactor.factored(kernel_tiles(placed, n, self, o, lower=True), n, o, symmetric=True)
        except Exception as e:  # compressed tiles can make a matrix with a small lambda indefinite
            if "positive definite" not in str(e):
                raise
            factors = tilefactor.factored(kernel_tiles(placed, n, self, o), n, o)
        w = tilefactor.solved(factors, placed.select("i", F.col("label").cast("double").alias("v")), n, o)
        return Model(placed.join(w, "i").select("id", "x", F.col("v").alias("w")), self.kernel, self.h, self.p)


def kernel_tiles(placed: DataFrame, n: int, how: KernelRegression, o: Options, lower: bool = False) -> DataFrame:
    """Tiles of K + lambda I for points (i: place, x), each made and compressed by the task that has its two blocks; lower:
    on and below the diagonal only."""
    edges = bounds(n, o.leaf)
    starts = F.array(*[F.lit(lo) for lo, _ in edges])
    t = (F.size(F.filter(starts, lambda s: s <= F.col("i"))) - 1).cast("long")
    blocks = placed.select(t.alias("t"), "i", "x").groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("xs"))
    every = lambda: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(edges) - 1).cast("long")))
    rows = blocks.select(F.col("t").alias("ti"), F.col("xs").alias("a"), every().alias("tj"))
    cols = blocks.select(F.col("t").alias("tj"), F.col("xs").alias("b"), every().alias("ti"))
    name, h, p, lam = how.kernel, how.h, how.p, how.lam

    def tile(r: dict) -> dict:
        x, y = np.array(r["a"], dtype=float), np.array(r["b"], dtype=float)
        enough = -(-len(x) * len(y) // (len(x) + len(y)))  # of this rank a tile is smaller in full
        k = kernel_values(name, x, y, h, p)
        if r["ti"] == r["tj"]:
            return tilefactor._row(r["ti"], r["tj"], "dense", k + lam * np.eye(len(k)), None)
        u, v = compressed(k, replace(o, max_rank=min(o.max_rank, enough)))
        return tilefactor._row(r["ti"], r["tj"], "low", u, v) if u.shape[1] * sum(k.shape) < k.size else tilefactor._row(r["ti"], r["tj"], "dense", k, None)

    met = rows.join(cols, ["ti", "tj"])
    return tilefactor._mapped(met.where("ti >= tj") if lower else met, tile)


def accuracy(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """The share of ids whose predicted label has the sign of the true one."""
    both = predicted.select("id", F.col("label").alias("p")).join(truth.select("id", F.col("label").alias("t")), "id")
    return both.agg(F.avg(F.when((F.col("p") >= 0) == (F.col("t") >= 0), 1.0).otherwise(0.0)).alias("accuracy"))
