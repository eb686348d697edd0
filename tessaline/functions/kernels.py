"""Distances and kernels of two array columns, as expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def distance_squared(x: Column, y: Column) -> Column:
    return _sum(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))


def distance(x: Column, y: Column) -> Column:
    return F.sqrt(distance_squared(x, y))


def distance_l1(x: Column, y: Column) -> Column:
    return _sum(F.zip_with(x, y, lambda a, b: F.abs(a - b)))


def gauss(x: Column, y: Column, h: float) -> Column:
    return F.exp(-distance_squared(x, y) / (2.0 * h * h))


def laplace(x: Column, y: Column, h: float) -> Column:
    return F.exp(-distance_l1(x, y) / h)


def anova(x: Column, y: Column, h: float, p: int = 1) -> Column:
    """The elementary symmetric polynomial of degree p of the one-dimensional Gauss kernels, by Newton's identities."""
    t = F.zip_with(x, y, lambda a, b: F.exp(-((a - b) * (a - b)) / (2.0 * h * h)))
    power = [_sum(F.transform(t, _power(s))) for s in range(1, p + 1)]
    e = [F.lit(1.0)]
    for k in range(1, p + 1):
        e.append(sum((power[s - 1] * e[k - s] * float((-1) ** (s + 1)) for s in range(1, k + 1)), F.lit(0.0)) / float(k))
    return e[p]


def _power(s: int):
    return lambda v: F.pow(v, F.lit(float(s)))


def kernel(name: str, x: Column, y: Column, h: float, p: int = 1) -> Column:
    """By name; an unknown name means Gauss."""
    if name.lower() == "laplace":
        return laplace(x, y, h)
    if name.lower() == "anova":
        return anova(x, y, h, p)
    return gauss(x, y, h)


def conj(v: Column) -> Column:
    return F.struct(v["re"].alias("re"), (-v["im"]).alias("im"))


def with_commas(v: Column) -> Column:
    return F.format_number(v, 0)
