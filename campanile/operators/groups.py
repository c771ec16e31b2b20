"""Folds, splits and samples."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import draw, uniform
from ..functions.scan import as_column, number_rows


def stratified_folds(df: DataFrame, label: str, key: str, k: int, seed: int = 0, out: str = "fold") -> DataFrame:
    """Each class dealt round the folds in a hashed order. The label must not be null."""
    rows = df.withColumn("__draw", draw(key, F.lit(seed)))
    dealt = number_rows(rows, [label], "__draw", key, out="__rn")
    return dealt.withColumn(out, ((F.col("__rn") - 1) % k).cast("int")).drop("__draw", "__rn")


def repeated_folds(df: DataFrame, fold_once, repeats: int, seed: int = 0) -> DataFrame:
    """G1: one copy of the rows per repeat, with its own seed and a `repeat` column."""
    out = None
    for r in range(repeats):
        part = fold_once(df, seed + r).withColumn("repeat", F.lit(r))
        out = part if out is None else out.unionByName(part)
    return out


def group_folds(df: DataFrame, group: str, label: str, k: int, seed: int = 0, out: str = "fold") -> DataFrame:
    """G1: whole groups to folds with the class mix balanced, by one rule for groups of all sizes.

    Groups with like class counts (to three binary digits) are interchangeable. Of each such kind the groups are dealt round the folds, largest
    first and back and forth; the folds that get one more are those which it leaves most even so far, the kinds being taken by falling size.
    Only the kinds and how many groups each has go to the driver: a power of the logarithm of the largest group, whatever the number of groups.
    """
    cells = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    shift = F.greatest(F.floor(F.log2("n")).cast("int") - 2, F.lit(0))
    step = F.pow(F.lit(2), shift).cast("bigint")
    rounded = F.floor(F.col("n") / step).cast("bigint") * step
    groups = cells.groupBy(group).agg(F.sum("n").alias("size"), F.to_json(F.sort_array(F.collect_list(F.struct(F.col(label).cast("string").alias("c"), rounded.alias("n"))))).alias("kind"))
    found = [(json.loads(r.kind), r.kind, r.m) for r in groups.groupBy("kind").agg(F.count(F.lit(1)).alias("m")).collect()]
    found.sort(key=lambda x: (-sum(c["n"] for c in x[0]), x[1]))
    load: list[dict] = [{} for _ in range(k)]
    orders = []
    for counts, kind, m in found:
        def cost(f: int) -> tuple:
            """What one more group adds to the sum of squared class counts; then the rows so far."""
            return sum(2 * load[f].get(c["c"], 0) * c["n"] for c in counts), sum(load[f].values()), (f + seed) % k

        folds = sorted(range(k), key=cost)
        rounds, more = divmod(m, k)
        for place, f in enumerate(folds):
            for c in counts:
                load[f][c["c"]] = load[f].get(c["c"], 0) + c["n"] * (rounds + (place < more))
        orders.append((kind, folds if rounds % 2 == 0 else folds[::-1]))  # the last round, if it runs backwards, begins with the right ones
    deal = df.sparkSession.createDataFrame(orders, "kind string, folds array<int>")
    ranked = number_rows(groups.withColumns({"__h": draw(group, F.lit(seed)), "__o": -F.col("size")}), ["kind"], "__o", "__h", out="__rn")
    at = (F.col("__rn") - 1) % (2 * k)
    place = F.when(at < k, at).otherwise(2 * k - 1 - at).cast("int")
    return df.join(ranked.join(deal, "kind").select(group, F.get("folds", place).alias(out)), group)


def init_pool_split(df: DataFrame, group: str | None, score: str, key: str, fraction: float = 0.3, seed: int = 0, out: str = "role") -> DataFrame:
    """`fraction` of each group to 'init', by score bin where every bin can be split, else by a hashed order.

    A group of one row goes to init; an unstratified group gives at least one row.
    """
    g = F.lit("all") if group is None else F.col(group).cast("string")
    rows = df.withColumns({"__g": g, "__bin": F.greatest(F.lit(0), F.least(F.lit(9), F.col(score).cast("int")))})
    bins = rows.groupBy("__g", "__bin").agg(F.count(F.lit(1)).alias("n"))
    plan = bins.groupBy("__g").agg(F.sum("n").alias("__size"), F.min("n").alias("least"), F.count(F.lit(1)).alias("n_bins"))
    n_init = F.floor(F.col("__size") * fraction)
    can = (F.col("least") >= 2) & (n_init >= F.col("n_bins")) & (F.col("__size") - n_init >= F.col("n_bins"))
    planned = rows.join(plan.select("__g", "__size", can.alias("__strat")), "__g")
    planned = planned.withColumns({"__cell": F.when(F.col("__strat"), F.col("__bin")).otherwise(F.lit(-1)), "__draw": draw(key, F.lit(seed))})
    dealt = number_rows(planned, ["__g", "__cell"], "__draw", key, out="__rn", total="__n")
    quota = F.when(F.col("__strat"), F.bround(F.col("__n") * fraction)).otherwise(F.greatest(F.lit(1), F.floor(F.col("__n") * fraction)))
    role = F.when((F.col("__size") < 2) | (F.col("__rn") <= quota), F.lit("init")).otherwise(F.lit("pool"))
    return dealt.withColumn(out, role).select(*df.columns, out)


def held_out_groups(df: DataFrame, group: str, least: int = 20, share: float = 0.30) -> DataFrame:
    """One row per group large enough to hold out: pool size, init size and budget."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_pool"))
    total = sizes.agg(F.sum("n_pool")).scalar()
    budget = F.greatest(F.lit(1), F.floor(F.col("n_pool") * share))
    return sizes.withColumn("n_all", total).filter(F.col("n_pool") >= least).select(group, "n_pool", (F.col("n_all") - F.col("n_pool")).alias("n_init"), budget.cast("long").alias("budget"))


def leave_group_out(df: DataFrame, group: str, held: DataFrame) -> DataFrame:
    """The rows once, with `held_out`: whether the row's group is among those held out in turn (`held` has the column `group`). `group_split` gives one of the splits."""
    marks = held.select(group, F.lit(True).alias("held_out")).distinct()
    return df.join(marks, group, "left").withColumn("held_out", F.coalesce("held_out", F.lit(False)))


def group_split(df: DataFrame, group: str, value, out: str = "role") -> DataFrame:
    """Role 'pool' for the rows of the held-out group, 'init' for all others, also those without a group."""
    return df.withColumn(out, F.when(F.col(group).eqNullSafe(F.lit(value)), "pool").otherwise("init"))


def split_sizes(marked: DataFrame, group: str, count: str | None = None) -> DataFrame:
    """Rows (held, role, n) for every held-out group, from one count of the rows of each group. With `count` a row of `marked` stands for that many rows."""
    sizes = marked.groupBy(group, "held_out").agg((F.count(F.lit(1)) if count is None else F.sum(count)).alias("n_pool"))
    total = sizes.agg(F.sum("n_pool")).scalar()
    both = F.array(F.struct(F.lit("pool").alias("role"), F.col("n_pool").alias("n")), F.struct(F.lit("init").alias("role"), (total - F.col("n_pool")).alias("n")))
    return sizes.filter("held_out").select(F.col(group).alias("held"), F.explode(both).alias("r")).select("held", "r.*").filter("n > 0")


def latin_hypercube(ids: DataFrame, key: str, bounds: Mapping[str, tuple[float, float]], log_params: Sequence[str] = (),
                    seed: int = 0, override: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """One point per id; per parameter every stratum is hit exactly once, with jitter inside it.

    The permutation of a parameter is the hashed order of the ids; parameters
    are scanned together in long form and brought side by side by one aggregation.
    """
    names = list(bounds)
    long = ids.select(F.col(key), F.explode(F.array(*[F.lit(p) for p in names])).alias("param"))
    long = long.withColumn("__draw", draw(key, "param", F.lit(seed)))
    ranked = number_rows(long, ["param"], "__draw", key, out="__rn", total="__n")
    u = (F.col("__rn") - 1 + uniform(key, "param", F.lit(seed), F.lit("jitter"))) / F.col("__n")
    points = ranked.select(key, "param", u.alias("u"))
    box = {**bounds, **(override or {})}
    cols = []
    for p in names:
        low, high = map(float, box[p])
        at = F.max(F.when(F.col("param") == p, F.col("u")))
        if p in log_params and low > 0 and high > 0:
            cols.append(F.exp(at * (math.log(high) - math.log(low)) + math.log(low)).alias(p))
        else:
            cols.append((at * (high - low) + low).alias(p))
    return points.groupBy(key).agg(*cols)


def balanced_resample(df: DataFrame, label: str, key: str, seed: int = 0) -> DataFrame:
    """Copies of rows so that every class is expected n / classes times."""
    from .metrics import class_weights

    weighted = class_weights(df, label)
    copies = F.floor(F.col("class_weight") + uniform(key, F.lit(seed))).cast("int")
    kept = weighted.withColumn("__copies", copies).filter(F.col("__copies") > 0)
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop("class_weight", "__copies")


def poisson_count(u, rate: float = 1.0, most: int = 18) -> Column:
    """Poisson count from a uniform number by its distribution function. At rate 1 more than 17 has probability 1e-16, below what a draw can tell."""
    u = as_column(u)
    term, total, steps = math.exp(-rate), math.exp(-rate), []
    for i in range(most):
        steps.append((total, i))
        term *= rate / (i + 1)
        total += term
    out = F.lit(most)
    for bound, i in reversed(steps):
        out = F.when(u < bound, F.lit(i)).otherwise(out)
    return out


def bootstrap_weights(df: DataFrame, key: str, models: int, seed: int = 0, prefix: str = "boot_") -> DataFrame:
    """Per model a Poisson(1) multiplicity of each row, fixed by its id."""
    return df.withColumns({f"{prefix}{m}": poisson_count(uniform(key, F.lit(seed), F.lit(m))).cast("double") for m in range(models)})
