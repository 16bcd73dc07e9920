"""Array and scalar functions of the models, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(a: Column) -> Column:
    """Sum of an array of doubles."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays."""
    return total(F.zip_with(a, b, lambda x, y: (x * y).cast("double")))


def squared_norm(a: Column) -> Column:
    """Inner product of an array with itself."""
    return dot(a, a)


def axpy(alpha: Column, x: Column, y: Column) -> Column:
    """alpha x + y."""
    return F.zip_with(x, y, lambda p, q: alpha * p + q)


def softmax(a: Column) -> Column:
    """exp(a - max) scaled to a sum of 1."""
    return let(F.transform(a, lambda x: F.exp(x - F.array_max(a))), lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def logsumexp(a: Column) -> Column:
    """log of the sum of exponentials, shifted by the maximum."""
    return let(F.array_max(a), lambda m: m + F.log(total(F.transform(a, lambda x: F.exp(x - m)))))


def running_sum(a: Column) -> Column:
    """Cumulative sums of an array: the unnormalised distribution function of its weights."""
    last = lambda s: F.coalesce(F.get(s, F.size(s) - 1), F.lit(0.0))
    return F.aggregate(a, F.array().cast("array<double>"), lambda s, x: F.concat(s, F.array(last(s) + x)))


def outer(a: Column, b: Column) -> Column:
    """Row-major outer product of two arrays."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


def bilinear(a: Column, u: list[list[float]], b: Column) -> Column:
    """a' U b for a constant matrix."""
    rows = [dot(F.array(*[F.lit(float(x)) for x in row]), b) for row in u]
    return dot(a, F.array(*rows))


def argmax(a: Column) -> Column:
    """Index (from 0) of the first greatest element."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def normal_cdf(x: Column) -> Column:
    """Distribution function of the standard normal by a five-term polynomial (error below 7.5e-8)."""
    # Fixed values of the polynomial.
    scale, terms = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(scale) * F.abs(x))
    poly = F.lit(0.0)
    for c in reversed(terms):
        poly = t * (F.lit(c) + poly)
    tail = F.exp(-x * x / 2) / F.sqrt(F.lit(2.0) * F.pi()) * poly
    return F.when(x >= 0, F.lit(1.0) - tail).otherwise(tail)


def learning_rate(step: Column, a: float, b: float, c: float) -> Column:
    """a (b + step)^-c."""
    return F.lit(a) * F.pow(F.lit(b) + step, F.lit(-c))


def renumber(w: Column, size: int, parts: int) -> Column:
    """Word ids dealt over parts: below parts * (size div parts), w mod parts times the part's size plus w div parts."""
    block = size // parts
    return F.when(w < parts * block, (w % parts) * block + F.floor(w / parts)).otherwise(w).cast("bigint")


def interval_of(x: Column, size: int, parts: int) -> Column:
    """Which of `parts` ranges of ceil(size / parts) holds x."""
    return F.floor(x / -(-size // parts)).cast("bigint")


def pg_mean(c: Column, w: Column) -> Column:
    """Mean of a Polya-Gamma(c, w) variable; c / 4 at w = 0."""
    return F.when(w == 0, c / 4).otherwise(c / (w * 2) * F.tanh(w / 2))
