"""Exact linear-interpolation quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import running


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """One row per group and probability: keys, prob, q.

    Equal values are folded to one counted row before anything is ordered, so a
    value shared by most rows costs one row. Position h = (n - 1) * p; the result
    lies between the values at floor(h) and floor(h) + 1.
    """
    keys = list(keys)
    folded = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    scanned = running(folded, keys, F.col(value), F.lit(0), {"__upto": ("sum", "__n")}, {"__all": ("sum", "__n")})
    first, last = F.col("__upto") - F.col("__n"), F.col("__upto") - 1

    def target(p: float):
        h = (F.col("__all") - 1) * F.lit(float(p))
        low = F.floor(h)
        return F.struct(
            F.lit(float(p)).alias("prob"),
            low.alias("low"),
            F.least(low + 1, F.col("__all") - 1).alias("high"),
            (h - low).alias("frac"),
        )

    targets = F.array(*[target(p) for p in probs])
    hit = F.filter(
        targets,
        lambda t: t["low"].between(first, last) | t["high"].between(first, last),
    )
    picked = scanned.select(*keys, F.col(value).cast("double").alias("__v"), first.alias("__f"), last.alias("__t"), F.explode(hit).alias("h"))
    low = F.max(F.when(F.col("h.low").between(F.col("__f"), F.col("__t")), F.col("__v")))
    high = F.max(F.when(F.col("h.high").between(F.col("__f"), F.col("__t")), F.col("__v")))
    return (
        picked.groupBy(*keys, F.col("h.prob").alias("prob"), F.col("h.frac").alias("__frac"))
        .agg(low.alias("__lo"), high.alias("__hi"))
        .select(*keys, "prob", (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__frac")).alias("q"))
    )


def quantiles_wide(df: DataFrame, keys: Sequence[str], value: str, named: dict[str, float]) -> DataFrame:
    """One row per group with a column per named probability."""
    long = quantiles(df, keys, value, sorted(set(named.values())))
    return long.groupBy(*keys).agg(
        *[F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("q"))).alias(name) for name, p in named.items()]
    )


def fit_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, dict[float, float]]:
    """Quantiles of several columns as a small driver-side model (columns x probs numbers)."""
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]))
    long = df.select(stack.alias("s")).select("s.column", "s.value")
    out: dict[str, dict[float, float]] = {c: {} for c in columns}
    for row in quantiles(long, ["column"], "value", probs).collect():
        out[row["column"]][row["prob"]] = row["q"]
    return out
