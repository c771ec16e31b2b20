"""Token inventories and lookups.

The inventory stays long, one row per (id, token), and is widened only at the
edge over a given domain.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def token_inventory(df: DataFrame, key: str, tokens: Column, extra: Column | None = None) -> DataFrame:
    """(id, token, count). `tokens` is an array; `extra` an optional array of struct(token, weight)."""
    unit = F.transform(tokens, lambda x: F.struct(x.alias("token"), F.lit(1.0).alias("weight")))
    bag = unit if extra is None else F.concat(unit, extra)
    rows = df.select(F.col(key), F.explode(bag).alias("t")).select(key, "t.token", "t.weight")
    return rows.filter(F.coalesce(F.length("token"), F.lit(0)) > 0).groupBy(key, "token").agg(F.sum("weight").alias("count"))


def widen(inventory: DataFrame, key: str, domain: Sequence[str], prefix: str = "Total_") -> DataFrame:
    """One 0-filled column per token of a given domain."""
    return inventory.groupBy(key).agg(
        *[F.sum(F.when(F.col("token") == d, F.col("count")).otherwise(0.0)).alias(f"{prefix}{d}") for d in domain]
    )


def token_family_block(inventory: DataFrame, key: str, families: Mapping[str, Sequence[str]]) -> DataFrame:
    """Count per family, total, presence, and the number of the first family present (0 if none)."""
    names = list(families)
    sums = inventory.groupBy(key).agg(
        *[F.sum(F.when(F.col("token").isin(list(families[n])), F.col("count")).otherwise(0.0)).alias(f"{n}_count") for n in names]
    )
    total = sum((F.col(f"{n}_count") for n in names[1:]), F.col(f"{names[0]}_count"))
    first = F.coalesce(*[F.when(F.col(f"{n}_count") > 0, F.lit(float(i))) for i, n in enumerate(names, 1)], F.lit(0.0))
    return sums.withColumn("family_count", total).withColumn("present", (F.col("family_count") > 0).cast("double")).withColumn("family_type", first)


def one_hot(df: DataFrame, column: str, domain: Sequence[str], unknown: str = "Unknown") -> DataFrame:
    """One 0/1 column per domain value in name order; null counts as `unknown`."""
    value = F.coalesce(F.col(column), F.lit(unknown))
    return df.withColumns({f"{column}_{d}": (value == d).cast("double") for d in sorted(set(domain) | {unknown})})


def observed_domain(df: DataFrame, column: str, limit: int = 10_000) -> list[str]:
    """The values seen, for columns of a checked small domain."""
    values = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()]
    if len(values) > limit:
        raise ValueError(f"{column} has more than {limit} values; keep it long")
    return sorted(values)


def weighted_vector_sum(inventory: DataFrame, vectors: DataFrame, key: str, vector: str = "vector", chunk: int = 32) -> DataFrame:
    """Sum over tokens of count x vector, per position: (id, pos, value).

    Vectors are cut into chunks, and the positions of a chunk are summed side by side, so no position becomes a row before the sum. Partial sums combine before the
    shuffle. Null places add nothing; vectors may differ in length; null and empty ones give no rows.
    """
    cut = vectors.where(F.size(vector) > 0).select("token", vector, F.explode(F.sequence(F.lit(0), F.size(vector) - 1, F.lit(chunk))).alias("__first"))
    parts = cut.select("token", "__first", F.slice(vector, F.col("__first") + 1, F.lit(chunk)).alias("__part"))
    joined = inventory.select(key, "token", "count").join(parts, "token")
    places = [F.sum(F.col("count") * F.get("__part", F.lit(i))).alias(f"__{i}") for i in range(chunk)]
    sums = joined.groupBy(key, "__first").agg(F.max(F.size("__part")).alias("__n"), *places)
    told = F.posexplode(F.slice(F.array(*[f"__{i}" for i in range(chunk)]), F.lit(1), F.col("__n"))).alias("__i", "value")
    return sums.select(key, "__first", told).select(key, (F.col("__first") + F.col("__i")).alias("pos"), "value")


def weighted_quality(inventory: DataFrame, quality: DataFrame, key: str) -> DataFrame:
    """Summed bad counts and the count-weighted bad fraction, denominator at least 1."""
    joined = inventory.join(quality, "token")
    return joined.groupBy(key).agg(
        F.sum(F.col("count") * F.col("n_bad")).alias("n_bad"),
        (F.sum(F.col("count") * F.col("bad_fraction")) / F.greatest(F.sum("count"), F.lit(1.0))).alias("bad_fraction"),
    )


def presence_block(inventory: DataFrame, vectors: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """A10: long rows (id, token, pos, value, missing, count) of the tokens present; missing flags tokens without a vector."""
    present = inventory.filter(F.col("count") > 0).join(vectors, "token", "left")
    return present.select(
        key, "token", "count",
        F.col(vector).isNull().cast("double").alias("missing"),
        F.posexplode(F.coalesce(F.col(vector), F.array(F.lit(0.0)))).alias("pos", "value"),
    )


def align_tokens(rows: DataFrame, trained: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of known tokens with their trained position, report of unseen tokens)."""
    known = rows.join(trained, "token")
    unseen = rows.join(trained.select("token"), "token", "left_anti")
    return known, unseen.groupBy("token").agg(F.sum("count").alias("n_dropped"))


def lookup(df: DataFrame, dimension: DataFrame, on: str, defaults: Mapping[str, object]) -> DataFrame:
    """Left join on a key; absent keys get the defaults."""
    joined = df.join(dimension, on, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def token_ratio(n_a, n_b, reference=None, recorded=None, fallback: float | None = None) -> Column:
    """V9: ratio of two counts, null if either is 0, then a reference value, a recorded one, a default."""
    a, b = F.nullif(n_a, F.lit(0)), F.nullif(n_b, F.lit(0))
    chain = [F.try_divide(a.cast("double"), b.cast("double"))] + [c for c in (reference, recorded) if c is not None]
    return F.coalesce(*chain, F.lit(fallback).cast("double"))
