"""Hash buckets, variant choice, significance and small scoring formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sticky_bucket(user: Column, experiment: Column) -> Column:
    """sha256("user:experiment") as a number, modulo 1000."""
    digits = F.split(F.sha2(F.concat_ws(":", user, experiment), 256), "")
    return F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0).cast("long"), lambda a, d: (a * 16 + F.conv(d, 16, 10).cast("long")) % 1000)


def choose_variant(bucket: Column, variants: list[tuple[str, float | None]]) -> Column:
    """First variant whose cumulative normalised weight exceeds the bucket; equal weights where they don't add up."""
    weights = [w if w is not None else 0.0 for _, w in variants]
    if sum(weights) <= 0:
        weights = [1.0] * len(variants)
    choice, upto = None, 0.0
    for (name, _), weight in zip(variants[:-1], weights[:-1]):
        upto += weight / sum(weights)
        condition = bucket < round(upto * 1000, 9)
        choice = F.when(condition, name) if choice is None else choice.when(condition, name)
    return F.lit(variants[-1][0]) if choice is None else choice.otherwise(variants[-1][0])


def erfc(x: Column) -> Column:
    """Complementary error function by a five-term rational approximation, error below 1.5e-7; for x >= 0."""
    # The coefficients of the approximation.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    t = 1 / (1 + p * x)
    series = a[4]
    for c in reversed(a[:4]):
        series = c + t * series
    return t * series * F.exp(-x * x)


def two_proportion_p(clicks_a: Column, n_a: Column, clicks_b: Column, n_b: Column) -> Column:
    """Two-sided p of the pooled z test; 1 where it is undefined."""
    pooled = (clicks_a + clicks_b) / (n_a + n_b)
    spread = F.sqrt(pooled * (1 - pooled) * (1 / n_a + 1 / n_b))
    z = F.abs(clicks_a / n_a - clicks_b / n_b) / spread
    return F.when((n_a > 0) & (n_b > 0) & (pooled > 0) & (pooled < 1), erfc(z / F.sqrt(F.lit(2.0)))).otherwise(F.lit(1.0))


def backoff(attempts: Column, base: int = 10, most: int = 3600) -> Column:
    return F.least(base * F.pow(F.lit(2.0), attempts), F.lit(float(most))).cast("long")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def adaptive_k(doc_count: Column, query: Column, base=(30, 50, 100), cuts=(10_000, 1_000_000), low: int = 10, high: int = 200, shift: int = 20, small_shift: int = 10) -> tuple[Column, Column]:
    """(k lexical, k vector): base by corpus size, then more lexical for short queries and more vector for long ones."""
    size = F.when(doc_count.isNull(), base[1]).when(doc_count < cuts[0], base[0]).when(doc_count > cuts[1], base[2]).otherwise(base[1])
    n = F.length(query)
    lexical = size + F.when(n < 5, shift).when(n > 20, -small_shift).otherwise(0)
    vector = size + F.when(n < 5, -small_shift).when(n > 20, shift).otherwise(0)
    clamp = lambda k: F.greatest(F.lit(low), F.least(F.lit(high), k)).cast("int")
    return clamp(lexical), clamp(vector)
