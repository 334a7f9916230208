"""Vector arithmetic as higher-order functions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often `use` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(F.lit(0.0))


def rounded(a: Column, places: int = 6) -> Column:
    """Components to so many places: the scaled double, half away from zero, as the SQL has it. Unlike F.round, which goes
    by the decimal digits, it leaves a small negative component its sign."""
    unit_ = 10.0**places

    def one(x: Column) -> Column:
        scaled = x.cast("double") * unit_
        size = F.abs(scaled)
        whole = F.floor(size).cast("double")
        nearest = F.signum(scaled) * (whole + F.when(size - whole >= 0.5, 1.0).otherwise(0.0)) / unit_
        return F.when(size < 2.0**52, nearest).otherwise(x.cast("double"))  # beyond it there are no places, nor in NaN

    return F.transform(a, one)


def finite(a: Column) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def unit(a: Column) -> Column:
    """Length one; a zero vector stays."""
    divisor = lambda v: let(norm(v), lambda n: F.when(n > 0, n).otherwise(F.lit(1.0)))
    return let(a, lambda v: let(divisor(v), lambda n: F.transform(v, lambda x: x.cast("double") / n)))


def weighted_mean(vectors: Column, weights: Column) -> Column:
    """Sum of w * v over the sum of w, of length one; null where there is no vector."""
    scaled = F.zip_with(vectors, weights, lambda v, w: F.transform(v, lambda x: x.cast("double") * w))
    added = let(scaled, lambda s: F.aggregate(F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), F.element_at(s, 1), lambda t, v: F.zip_with(t, v, lambda x, y: x + y)))
    mean = let(F.aggregate(weights, F.lit(0.0), lambda s, w: s + w), lambda total: F.transform(added, lambda x: x / total))
    return F.when(F.size(vectors) > 0, unit(mean))
