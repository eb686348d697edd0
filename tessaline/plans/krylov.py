"""Iterative solvers whose vectors are relations: the driver keeps scalars and small matrices only.

An operator is a function from a vector relation (i, v) to one; so is a preconditioner. Vectors are written or
persisted after each step, so a step's plan never holds the steps before it.
"""

from __future__ import annotations

import enum
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.operators.graph import _cut
from tessaline.operators.sparse import max_scaled_residual, spmv

Operator = Callable[[DataFrame], DataFrame]


class Outcome(enum.Enum):
    SUCCESS = 0
    MATRIX_NOT_SET = 1
    REORDERING_ERROR = 2
    ZERO_PIVOT = 3
    NO_CONVERGENCE = 4
    INACCURATE_INERTIA = 5


@dataclass
class Result:
    x: DataFrame
    outcome: Outcome
    iterations: int
    residual: float


def _kept(v: DataFrame) -> DataFrame:
    """The vector, computed once; lineage is cut, and a lost part is read again from the shared folder."""
    return _cut(v)


def _held(v: DataFrame) -> DataFrame:
    return v.persist(StorageLevel.MEMORY_AND_DISK)


def axpy(*terms: tuple[float, DataFrame]) -> DataFrame:
    """The sum of multiples of vectors, in one aggregate."""
    parts = [v.select("i", (F.lit(float(a)) * F.col("v")).alias("v")) for a, v in terms]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("i").agg(F.sum("v").alias("v"))


def dots(w: DataFrame, vs: list[DataFrame]) -> list[float]:
    """The products of w with several vectors, in one job."""
    named = vs[0].select("i", "v", F.lit(0).alias("k"))
    for k, v in enumerate(vs[1:], 1):
        named = named.unionByName(v.select("i", "v", F.lit(k).alias("k")))
    rows = named.join(w.select("i", F.col("v").alias("w")), "i").groupBy("k").agg(F.sum(F.col("v") * F.col("w")).alias("d")).collect()
    out = dict.fromkeys(range(len(vs)), 0.0) | {r["k"]: r["d"] for r in rows}
    return [out[k] for k in range(len(vs))]


def norm(v: DataFrame) -> float:
    return math.sqrt(v.agg(F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0))).first()[0])


def matrix_operator(a: DataFrame) -> Operator:
    return lambda x: spmv(a, x)


def jacobi(a: DataFrame) -> Operator:
    """Division by the diagonal."""
    d = a.where("i = j").groupBy("i").agg(F.sum("v").alias("d"))
    return lambda x: x.join(d, "i").select("i", (F.col("v") / F.col("d")).alias("v"))


def gmres(a: Operator, b: DataFrame, m: Operator | None = None, x0: DataFrame | None = None, rtol: float = 1e-6, atol: float = 1e-10, restart: int = 30, most: int = 5000) -> Result:
    """Left-preconditioned GMRES with restarts: Gram-Schmidt in one pass of products, Givens rotations on the driver."""
    m = m or (lambda v: v)
    x, total, rho0, rho = x0, 0, None, 0.0
    while True:
        r = _kept(m(b if x is None else axpy((1.0, b), (-1.0, a(x)))))
        rho = norm(r)
        rho0 = rho if rho0 is None else rho0
        if rho == 0 or rho < atol or rho / rho0 < rtol:
            return Result(b.select("i", F.lit(0.0).alias("v")) if x is None else x, Outcome.SUCCESS, total, rho)
        if total >= most:
            return Result(x, Outcome.NO_CONVERGENCE, total, rho)
        basis = [_kept(axpy((1.0 / rho, r)))]
        h, g, turns = np.zeros((restart + 1, restart)), np.zeros(restart + 1), []
        g[0], k = rho, 0
        while k < restart and total < most:
            w = _kept(m(a(basis[k])))
            *c, ww = dots(w, [*basis, w])
            left = ww - sum(x * x for x in c)
            w = axpy((1.0, w), *[(-x, v) for x, v in zip(c, basis, strict=True)])
            if left < 1e-4 * ww:  # most of w is gone: once more, and its size from what is left
                w = _kept(w)
                again = dots(w, basis)
                w = _kept(axpy((1.0, w), *[(-x, v) for x, v in zip(again, basis, strict=True)]))
                c, left = np.add(c, again), norm(w) ** 2
            h[: k + 1, k], size = c, math.sqrt(max(left, 0.0))
            h[k + 1, k] = size
            for i, (cs, sn) in enumerate(turns):
                h[i, k], h[i + 1, k] = cs * h[i, k] + sn * h[i + 1, k], -sn * h[i, k] + cs * h[i + 1, k]
            d = math.hypot(h[k, k], h[k + 1, k])
            cs, sn = (1.0, 0.0) if d == 0 else (h[k, k] / d, h[k + 1, k] / d)
            turns.append((cs, sn))
            h[k, k], h[k + 1, k] = d, 0.0
            g[k], g[k + 1] = cs * g[k], -sn * g[k]
            rho, total, k = abs(g[k + 1]), total + 1, k + 1
            if rho < atol or rho / rho0 < rtol or size == 0:
                break
            basis.append(_kept(axpy((1.0 / size, w))))
        y = np.linalg.solve(np.triu(h[:k, :k]), g[:k])
        x = _kept(axpy(*([] if x is None else [(1.0, x)]), *[(float(c), v) for c, v in zip(y, basis[:k], strict=True)]))


def bicgstab(a: Operator, b: DataFrame, m: Operator | None = None, rtol: float = 1e-6, atol: float = 1e-10, most: int = 5000) -> Result:
    m = m or (lambda v: v)
    zero = b.select("i", F.lit(0.0).alias("v"))
    size = norm(b)
    if size == 0:
        return Result(zero, Outcome.SUCCESS, 0, 0.0)
    x, r = zero, _kept(b)
    hat, p, v, rho, alpha, omega = r, None, None, 1.0, 1.0, 1.0
    res = size
    for k in range(most):
        if res / size <= rtol or res <= atol:
            return Result(x, Outcome.SUCCESS, k, res)
        new = dots(hat, [r])[0]
        if new == 0:
            break
        p = r if p is None else _kept(axpy((1.0, r), (new / rho * alpha / omega, p), (-new / rho * alpha, v)))
        ph = _kept(m(p))
        v = _kept(a(ph))
        alpha = new / dots(hat, [v])[0]
        s = _kept(axpy((1.0, r), (-alpha, v)))
        if norm(s) < atol:
            return Result(_kept(axpy((1.0, x), (alpha, ph))), Outcome.SUCCESS, k + 1, norm(s))
        sh = _kept(m(s))
        t = _kept(a(sh))
        ts, tt = dots(t, [s, t])
        omega = ts / tt if tt else 0.0
        x = _kept(axpy((1.0, x), (alpha, ph), (omega, sh)))
        r = _kept(axpy((1.0, s), (-omega, t)))
        res, rho = norm(r), new
        if omega == 0:
            break
    return Result(x, Outcome.SUCCESS if res / size <= rtol or res <= atol else Outcome.NO_CONVERGENCE, most, res)


def refine(matrix: DataFrame, b: DataFrame, m: Operator, x0: DataFrame | None = None, rtol: float = 1e-6, atol: float = 1e-10, most: int = 100) -> Result:
    """Iterative refinement with a solver m for A d = r; stops by residual, its share of the first, and backward error."""
    x = x0 if x0 is not None else b.select("i", F.lit(0.0).alias("v"))
    r = _kept(axpy((1.0, b), (-1.0, spmv(matrix, x))))
    first = res = norm(r)
    k, backward = 0, 1.0
    while res > atol and res / first > rtol and backward > atol and k < most:
        x = _kept(axpy((1.0, x), (1.0, m(r))))
        r = _kept(axpy((1.0, b), (-1.0, spmv(matrix, x))))
        res, k = norm(r), k + 1
        backward = max_scaled_residual(matrix, x, b).first()[0] or 0.0
    return Result(x, Outcome.SUCCESS if res <= atol or res / max(first, 1e-300) <= rtol or backward <= atol else Outcome.NO_CONVERGENCE, k, res)
