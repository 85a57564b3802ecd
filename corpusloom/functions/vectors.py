"""Expressions over float vectors kept as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.draws import uniform

NORM_FLOOR = 1e-12


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v: Column) -> Column:
    """Scale to length 1 (a zero vector stays zero). The norm is taken once per row, not once per element."""
    scale = F.array_repeat(F.greatest(norm(v), F.lit(NORM_FLOOR)), F.size(v))
    return F.zip_with(v, scale, lambda x, length: x.cast("double") / length)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(NORM_FLOOR)) * F.greatest(norm(b), F.lit(NORM_FLOOR)))


def alignment_loss(a: Column, b: Column) -> Column:
    """Cosine embedding loss against target 1."""
    return F.lit(1.0) - cosine(a, b)


def blend(first: Column, second: Column, alpha: float) -> Column:
    return F.lit(alpha) * first + F.lit(1.0 - alpha) * second


def he_normal(dim: int, seed: int, key: Column, negative_slope: float = 0.0) -> Column:
    """A He-normal vector with fan-in ``dim``: Box-Muller over seeded draws, so reruns give the same vector."""
    scale = (2.0 / (1.0 + negative_slope**2) / dim) ** 0.5
    radius = lambda i: F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(f"{seed}r", key, i)))
    angle = lambda i: F.cos(F.lit(2.0) * F.pi() * uniform(f"{seed}a", key, i))
    return F.transform(
        F.sequence(F.lit(1), F.lit(dim)), lambda i: (F.lit(scale) * radius(i) * angle(i)).cast("float")
    )
