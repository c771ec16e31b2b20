"""Numeric and array helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scan import as_column



def clip(column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), as_column(column)))


def normal_pdf(z) -> Column:
    """F8."""
    z = as_column(z)
    return F.exp(-z * z / 2) / F.lit(math.sqrt(2 * math.pi))


def normal_cdf(z) -> Column:
    """F8: standard normal distribution function, to about 1e-15.

    Near zero a series whose terms are all positive, further out the continued fraction of the tail; both are worked from the inside out.
    """
    bound = F.array(as_column(z).cast("double"))

    def value(z):
        x = F.abs(z)
        series = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), F.lit(1.0), lambda s, k: 1 + s * x * x / (2 * k + 1))
        fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), x, lambda f, k: x + k / f)
        tail = F.when(x < 3, 0.5 - normal_pdf(x) * x * series).otherwise(normal_pdf(x) / fraction)
        return F.when(z >= 0, 1 - tail).otherwise(tail)

    return F.transform(bound, value)[0]


def round_half_up(x, digits: int) -> Column:
    """`F.round` of doubles, to the bit: decimals are worked out, which takes most of the time, only for numbers near half a step, large ones and those that are not finite."""
    x, scale = as_column(x), float(10**digits)
    scaled = x * scale
    near = F.floor(scaled + 0.5).cast("double")
    return F.when((F.abs(scaled) < 1e12) & (F.abs(scaled - near) < 0.499), near / scale).otherwise(F.round(x, digits))


def log_scale(u, low: float, high: float) -> Column:
    """map [0, 1] to [low, high] evenly in the logarithm."""
    return F.exp(as_column(u) * (math.log(high) - math.log(low)) + math.log(low))


def linear_scale(u, low: float, high: float) -> Column:
    return as_column(u) * (high - low) + low


def array_sum(a) -> Column:
    return F.aggregate(as_column(a), F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a, b) -> Column:
    """F9."""
    return F.aggregate(F.zip_with(as_column(a), as_column(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    """F9."""
    return F.sqrt(F.aggregate(as_column(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a, b) -> Column:
    """0 when either vector is all zeros."""
    size = norm(a) * norm(b)
    return F.when(size > 1e-10, dot(a, b) / size).otherwise(F.lit(0.0))


def euclidean(a, b) -> Column:
    """F9."""
    gap = F.zip_with(as_column(a), as_column(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x))


def argsort_desc(a) -> Column:
    """positions ordered by value descending, position breaking ties."""
    a = as_column(a)
    tagged = F.transform(a, lambda x, i: F.struct((-x.cast("double")).alias("v"), i.alias("i")))
    return F.transform(F.array_sort(tagged), lambda s: s["i"])


def running_max(a) -> Column:
    """cumulative maximum of an array, by doubling: each pass looks twice as far back, so the work is n log n."""
    a = F.transform(as_column(a), lambda x: x.cast("double"))
    n = F.size(a)
    passes = F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int")
    # the passes come first in the list, as far as there are any
    steps = F.filter(F.sequence(F.lit(0), passes), lambda k: k < passes)
    back = lambda acc, k: F.concat(F.array_repeat(F.lit(None).cast("double"), F.pow(F.lit(2), k).cast("int")), acc)
    return F.aggregate(steps, a, lambda acc, k: F.slice(F.zip_with(acc, back(acc, k), lambda x, y: F.greatest(x, y)), 1, F.greatest(F.size(acc), F.lit(1))))


def tanimoto(a, b) -> Column:
    """Shared over united distinct tokens, 0 when both are empty."""
    a, b = as_column(a), as_column(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def digamma(n) -> Column:
    """Digamma of a positive number: shifted above 6, then the asymptotic series."""
    n = as_column(n).cast("double")
    shift = sum((F.when(n + i < 6, 1 / (n + i)).otherwise(F.lit(0.0)) for i in range(6)), F.lit(0.0))
    x = F.when(n >= 6, n).otherwise(n + F.ceil(F.lit(6.0) - n))
    y = 1 / (x * x)
    return F.log(x) - 0.5 / x - y * (F.lit(1 / 12) - y * (F.lit(1 / 120) - y * (F.lit(1 / 252) - y * F.lit(1 / 240)))) - shift


def correlation(x, y) -> Column:
    """Pearson correlation as an aggregate; null when a side is constant (the built-in one raises then)."""
    x, y = as_column(x).cast("double"), as_column(y).cast("double")
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def nearest_allowed(x, allowed: list[float]) -> Column:
    """Closest of a short list of values, the first on ties."""
    x = as_column(x)
    options = F.array(*[F.struct(F.abs(F.lit(float(v)) - x).alias("gap"), F.lit(i).alias("i"), F.lit(float(v)).alias("v")) for i, v in enumerate(allowed)])
    return F.when(x.isNotNull(), F.array_min(options)["v"])
