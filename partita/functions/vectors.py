"""Vector arithmetic on array columns as built-in expressions, in double precision."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; null elements make it null."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def scaled(v: Column, by: Column) -> Column:
    return F.transform(doubles(v), lambda x: x * by)


def l2_normalize(v: Column, guard: str = "add", eps: float = EPS) -> Column:
    """v over its length. guard: 'add' (length + eps), 'max' (at least eps), 'skip' (v as it is if shorter than eps)."""
    n = norm(v)
    if guard == "add":
        return F.transform(doubles(v), lambda x: x / (n + eps))
    if guard == "max":
        return F.transform(doubles(v), lambda x: x / F.greatest(n, F.lit(eps)))
    return F.when(n < eps, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / n))


def blend(a: Column, b: Column, wa: float = 1.0, wb: float = 1.0) -> Column:
    """wa * a + wb * b, of length 1."""
    return l2_normalize(F.zip_with(doubles(a), doubles(b), lambda x, y: x * wa + y * wb))


def concat_fusion(parts: list[tuple[Column, float]]) -> Column:
    """Weighted vectors side by side, of length 1."""
    return l2_normalize(F.concat(*[scaled(v, F.lit(w)) for v, w in parts]))


def root_normalize(v: Column, l2: bool = False, eps: float = EPS) -> Column:
    """L1 norm, then square roots of the sizes with their signs, then L2 norm if asked for."""
    total = F.aggregate(F.transform(doubles(v), F.abs), F.lit(0.0), lambda s, x: s + x)
    out = F.transform(doubles(v), lambda x: F.signum(x) * F.sqrt(F.abs(x) / (total + eps)))
    return l2_normalize(out) if l2 else out


def mean_vector(vectors: list[Column]) -> Column:
    """Mean of views, of length 1."""
    total = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), [doubles(v) for v in vectors])
    return l2_normalize(F.transform(total, lambda x: x / len(vectors)))


def trimmed_mean(values: Column, share: float = 0.7, least: int = 2, from_n: int = 4) -> Column:
    """Mean of the largest ceil(share * n) values, at least `least`, where there are from_n or more; else of all. Nulls are left out; none: 0."""
    v = F.sort_array(F.filter(values, lambda x: x.isNotNull()), asc=False)
    n = F.size(v)
    k = F.when(n >= from_n, F.greatest(F.ceil(n * share), F.lit(least))).otherwise(n)
    return F.when(n == 0, 0.0).otherwise(F.aggregate(F.slice(v, 1, k.cast("int")), F.lit(0.0), lambda s, x: s + x) / k)
