"""Joins, pair tables and set operations (J4-J11, U1-U4, A31 domains, C18)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def product(left: DataFrame, right: DataFrame, buckets: int | None = None) -> DataFrame:
    """Every row of `left` with every row of a dimension table; the product is the feature, so both should be small or one tiny.

    The right rows are dealt over buckets and `left` is copied to each, so no task holds either table.
    """
    n = buckets or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = left.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    b = right.withColumn("__b", F.pmod(F.xxhash64(*right.columns), F.lit(n)).cast("int"))
    return a.join(b, "__b").drop("__b")


def unordered_pairs(dimension: DataFrame, key: str, first: str = "a", second: str = "b", singletons: bool = True,
                    buckets: int | None = None, repeats: bool = False) -> DataFrame:
    """All a < b of a dimension's distinct keys, plus (a, '') for each key. All pairs are the feature: for dimension tables only.

    With `repeats` two keys make as many pairs as their rows do; (a, '') stays one row.
    """
    rows = dimension.select(key).where(F.col(key).isNotNull())
    keys = rows.distinct()
    sides = rows if repeats else keys
    n = buckets or int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = sides.select(F.col(key).alias(first), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("__b"))
    b = sides.select(F.col(key).alias(second), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("__b"))
    pairs = a.join(b, (a["__b"] == b["__b"]) & (F.col(first) < F.col(second))).select(first, second)
    if not singletons:
        return pairs
    return pairs.unionByName(keys.select(F.col(key).alias(first), F.lit("").cast(keys.schema[key].dataType).alias(second)))


def with_ratios(pairs: DataFrame, ratios: Sequence[float], first: str = "a", second: str = "b") -> DataFrame:
    """Each real pair at each ratio of the first member, both ways round when unequal; singletons at 1."""
    single = F.col(second) == ""
    forward = F.when(single, F.array(F.lit(1.0))).otherwise(F.array(*[F.lit(float(r)) for r in ratios]))
    one_way = pairs.withColumn("phi", F.explode(forward))
    back = pairs.filter(~single).select(F.col(second).alias(first), F.col(first).alias(second))
    unequal = [float(r) for r in ratios if abs(r - 0.5) > 1e-9]
    if not unequal:
        return one_way
    return one_way.unionByName(back.withColumn("phi", F.explode(F.array(*[F.lit(r) for r in unequal]))))


def observed_pairs(df: DataFrame, first: str, second: str, known: DataFrame, key: str, position: str) -> DataFrame:
    """Distinct pairs seen: unknown first drops the row, unknown second becomes empty; ordered by first sight."""
    names = known.select(F.col(key).alias("__k")).distinct()
    rows = df.join(names, F.col(first) == F.col("__k"), "left_semi")
    seen = rows.join(names, rows[second] == names["__k"], "left").withColumn(second, F.coalesce(F.col("__k"), F.lit("")))
    return seen.groupBy(first, second).agg(F.min(position).alias("first_seen")).orderBy("first_seen")


def exact_successes(df: DataFrame, target: dict[str, str], score: str, floor: float) -> DataFrame:
    """Rows whose keys equal the target and whose score reaches the floor."""
    match = F.lit(True)
    for c, v in target.items():
        match = match & (F.trim(F.col(c)) == v)
    return df.filter(match & (F.col(score) >= floor))


def members_used(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct upper-case names over several columns, blanks left out."""
    names = F.array(*[F.upper(F.trim(F.col(c).cast("string"))) for c in columns])
    return df.select(F.explode(names).alias("member")).filter(F.col("member").isNotNull() & ~F.col("member").isin("", "NAN", "NONE", "NA")).distinct()


def without(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not in another table."""
    return df.join(other.select(*keys).distinct(), list(keys), "left_anti")


def one_per_key(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """`columns` of each key; the job fails when a key has two rows. The check is part of the aggregation, so it starts no job of its own."""
    once = F.assert_true(F.count(F.lit(1)) == 1, F.concat(F.lit(f"more than one row per {key}: "), F.first(F.col(key).cast("string"))))
    found = df.groupBy(key).agg(*[F.first(c).alias(c) for c in columns], once.alias("__once"))
    return found.filter(F.col("__once").isNull()).drop("__once")


def paired(df: DataFrame, method: str, a: str, b: str, key: str, metrics: Sequence[str]) -> DataFrame:
    """Metrics of two methods side by side on the keys both have; no rows when there are none."""
    side_a = one_per_key(df.filter(F.col(method) == a), key, metrics).select(key, *[F.col(m).alias(f"{m}_a") for m in metrics])
    side_b = one_per_key(df.filter(F.col(method) == b), key, metrics).select(key, *[F.col(m).alias(f"{m}_b") for m in metrics])
    return side_a.join(side_b, key)


def union_by_name(a: DataFrame, b: DataFrame) -> DataFrame:
    """U1."""
    return a.unionByName(b, allowMissingColumns=True)


def experiment_matrix(methods: DataFrame, surrogates: DataFrame, seeds: DataFrame) -> DataFrame:
    """Sensitive methods with every surrogate and seed, agnostic ones with every seed, and the run label."""
    sensitive = product(product(methods.filter("sensitive").drop("sensitive"), surrogates), seeds)
    agnostic = product(methods.filter("not sensitive").drop("sensitive"), seeds).withColumn("surrogate", F.lit(None).cast("string"))
    label = F.concat_ws("|", F.col("method"), F.col("surrogate"), F.concat(F.lit("seed="), F.col("seed").cast("string")))
    return sensitive.unionByName(agnostic).withColumn("label", label)
