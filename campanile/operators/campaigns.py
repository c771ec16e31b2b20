"""Run-history metrics.

The common input is `scored`: one row per (run, item) with the score `y`, the
`role` ('init' or 'pool') and the `iteration` at which the item was selected
(null when it never was).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scan import number_rows, running, with_halo


def attach_history(split: DataFrame, history: DataFrame, run: str = "run_id", item: str = "item_id") -> DataFrame:
    """`scored` from a split table (run, item, role, y) and a history (run, iteration, item)."""
    return split.join(history.select(run, item, "iteration"), [run, item], "left")


def merge_rare_groups(df: DataFrame, key: str, min_size: int, out: str = "group_id", rare: str = "rare", population: DataFrame | None = None) -> DataFrame:
    """Groups under `min_size` share one label; null keys count as 'unknown'.

    Sizes are counted over `population` (by default `df`; pass the plain table
    when `df` is the result of longer work on the same rows) and combined
    map-side. The kept groups are joined back by a broadcast when their counted
    number allows, else by a shuffle that adaptive execution splits at hot keys.
    """
    label = F.coalesce(F.col(key).cast("string"), F.lit("unknown"))
    sizes = (df if population is None else population).groupBy(label.alias("__label")).agg(F.count(F.lit(1)).alias("__size"))
    kept = sizes.filter(F.col("__size") >= min_size).select("__label")
    return (
        df.withColumn("__label", label).join(kept.withColumn(out, F.col("__label")), "__label", "left")
        .withColumn(out, F.coalesce(F.col(out), F.lit(rare)))
        .drop("__label")
    )


def group_directory(df: DataFrame, key: str, min_size: int, position: str, width: int = 30) -> DataFrame:
    """One row per merged group: id by first appearance, readable name, size."""
    label = F.coalesce(F.col(key).cast("string"), F.lit("unknown"))
    sizes = df.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("size"), F.min(position).alias("first_seen"))
    is_rare = F.col("size") < min_size
    merged = sizes.groupBy(F.when(~is_rare, F.col("label")).alias("label")).agg(
        F.sum("size").alias("size"), F.min("first_seen").alias("first_seen"), F.sum(F.lit(1)).alias("n_merged")
    )
    short = F.when(F.length("label") > width, F.concat(F.substring("label", 1, width), F.lit("..."))).otherwise(F.col("label"))
    name = F.coalesce(short, F.concat(F.lit("rare ("), F.col("n_merged").cast("string"), F.lit(" groups)")))
    numbered = number_rows(merged, [], F.col("first_seen"), F.lit(0), out="rn")
    return numbered.select((F.col("rn") - 1).alias("group_no"), name.alias("group_name"), "size")


def _sum_if(condition: Column, value=None) -> Column:
    return F.sum(F.when(condition, F.lit(1) if value is None else value).otherwise(0))


def campaign_counts(scored: DataFrame, by: Sequence[str], threshold: float, y: str = "y") -> DataFrame:
    """The conditional counts every campaign metric is made of, in one aggregation."""
    pool, init = F.col("role") == "pool", F.col("role") == "init"
    chosen, hit = F.col("iteration").isNotNull(), F.col(y) >= threshold
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_items"),
        _sum_if(init).alias("n_init"),
        _sum_if(pool).alias("n_pool"),
        _sum_if(chosen).alias("n_selected"),
        _sum_if(pool & hit).alias("n_pool_hits"),
        _sum_if(pool & hit & chosen).alias("n_found"),
        _sum_if(chosen & hit).alias("n_selected_hits"),
        _sum_if(hit).alias("n_hits"),
        F.sum(F.when(pool, F.col(y))).alias("sum_pool"),
        F.sum(F.when(chosen, F.col(y))).alias("sum_selected"),
        F.max(y).alias("best_all"),
        F.max(F.when(chosen, F.col(y))).alias("best_selected"),
        F.max(F.when(chosen | init, F.col(y))).alias("best_seen"),
    )


def ratio(a, b) -> Column:
    """a / b in doubles, null when b is 0 or either side is null."""
    return F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))


def acceleration() -> Column:
    """A13, null when nothing was evaluated or the pool holds no hit."""
    return F.try_divide(ratio("n_found", "n_pool_hits"), ratio("n_selected", "n_pool"))


def mean_ratio_ef() -> Column:
    """A14, null when nothing was selected or the pool mean is not positive."""
    pool_mean = ratio("sum_pool", "n_pool")
    return F.when(pool_mean > 0, F.try_divide(ratio("sum_selected", "n_selected"), pool_mean))


def base_rate(items: DataFrame, by: Sequence[str], threshold: float, y: str = "y") -> DataFrame:
    """A12."""
    return items.groupBy(*by).agg(
        F.avg((F.col(y) >= threshold).cast("double")).alias("base_rate"), F.count(F.lit(1)).alias("n_items")
    )


def run_summary(scored: DataFrame, by: Sequence[str], threshold: float) -> DataFrame:
    """Ten fields per run."""
    zero = F.lit(0.0)
    return campaign_counts(scored, by, threshold).select(
        *by,
        acceleration().alias("AF"),
        mean_ratio_ef().alias("EF"),
        F.coalesce(ratio("n_selected_hits", "n_selected"), zero).alias("hit_rate"),
        F.coalesce(ratio("n_pool_hits", "n_pool"), zero).alias("baseline_hit_rate"),
        F.coalesce(ratio("n_found", "n_pool_hits"), zero).alias("hit_discovery_rate"),
        F.coalesce("best_seen", zero).alias("best_score_final"),
        (F.col("best_all") - F.coalesce("best_selected", zero)).alias("simple_regret_final"),
        F.col("n_selected").alias("n_evaluated"),
        "n_init",
        F.lit(float(threshold)).alias("hit_threshold"),
    )


def group_summary(scored: DataFrame, by: Sequence[str], threshold: float) -> DataFrame:
    """The same inside each group's own pool; `by` holds run and group."""
    zero = F.lit(0.0)
    return campaign_counts(scored, by, threshold).select(
        *by,
        F.when(F.col("n_selected") > 0, acceleration()).alias("AF"),
        mean_ratio_ef().alias("EF"),
        F.coalesce(ratio("n_selected_hits", "n_selected"), zero).alias("hit_rate"),
        F.coalesce(ratio("n_pool_hits", "n_pool"), zero).alias("baseline_hit"),
        F.coalesce(ratio("n_found", "n_pool_hits"), zero).alias("hit_discovery_rate"),
        "n_pool",
        "n_selected",
        "n_pool_hits",
    )


def _mean(value: Column, nan_policy: str) -> Column:
    mean = F.avg(value)
    if nan_policy == "skip":
        return mean
    return F.when(F.count(value) == F.count(F.lit(1)), mean)


def across_seeds(summary: DataFrame, by: Sequence[str], metrics: Sequence[str], nan_policy: str = "skip") -> DataFrame:
    """A17 and the aggregation of A20/A21: mean and population std over seeds, undefined values skipped
    or, with nan_policy='propagate', making the cell undefined."""
    aggs = []
    for m in metrics:
        value = F.col(m)
        aggs += [_mean(value, nan_policy).alias(f"{m}_mean"), F.stddev_pop(value).alias(f"{m}_std"), F.count(value).alias(f"{m}_n")]
    return summary.groupBy(*by).agg(*aggs)


def macro_total(groups: DataFrame, method: Sequence[str], seed: str, group: str, metrics: Sequence[str]) -> DataFrame:
    """Per-group rows plus a total row made of per-seed macro means."""
    body = across_seeds(groups, [*method, group], metrics)
    per_seed = groups.groupBy(*method, seed).agg(*[F.avg(m).alias(m) for m in metrics])
    total = across_seeds(per_seed, method, metrics).withColumn(group, F.lit("total"))
    return body.unionByName(total)


def weighted_over_groups(groups: DataFrame, by: Sequence[str], weight: str, metrics: Sequence[str]) -> DataFrame:
    """A19 inner step: weighted mean of each metric over groups where it is defined."""
    w = F.col(weight).cast("double")
    return groups.groupBy(*by).agg(
        *[
            F.try_divide(F.sum(F.col(m) * w), F.sum(F.when(F.col(m).isNotNull(), w))).alias(m)
            for m in metrics
        ]
    )


def metric_pivot(summary: DataFrame, row: str, column: str, domain: Sequence[str], metric: str, nan_policy: str = "propagate") -> DataFrame:
    """Rows by acquisition, one column per surrogate of a given domain."""
    return summary.groupBy(row).agg(
        *[
            F.when(
                F.lit(nan_policy == "skip")
                | (F.sum((F.col(metric).isNull() & (F.col(column) == d)).cast("int")) == 0),
                F.avg(F.when(F.col(column) == d, F.col(metric))),
            ).alias(d)
            for d in domain
        ]
    )


def cold_start(summary: DataFrame, fraction: str, metrics: Sequence[str], hit: str, base: str, factor: float = 1.5) -> DataFrame:
    """Curve per initial fraction with the first fraction whose mean hit rate beats factor x base."""
    curve = across_seeds(summary, [fraction], metrics, nan_policy="propagate")
    flags = summary.groupBy(fraction).agg(F.avg(hit).alias("__hit"), F.avg(base).alias("__base"))
    first = flags.filter(F.col("__hit") > factor * F.col("__base")).agg(F.min(fraction).alias("first_fraction"))
    return curve.withColumn("first_fraction", first.scalar())


def best_method(summary: DataFrame, method: str, metric: str) -> DataFrame:
    """Method with the highest mean over its defined values; name breaks ties."""
    means = summary.groupBy(method).agg(F.avg(metric).alias("mean_value")).filter(F.col("mean_value").isNotNull())
    return means.orderBy(F.desc("mean_value"), method).limit(1)


def order_undefined_last(df: DataFrame, metric: str, tie: str) -> DataFrame:
    """T8."""
    return df.orderBy(F.col(metric).desc_nulls_last(), tie)


_UNSELECTED = float(1 << 53)


def curves(scored: DataFrame, run: Sequence[str], threshold: float) -> DataFrame:
    """W1-W4 in one scan: per selected item the running best, regret, discovery and mean.

    Init items sort before the first selection and unselected ones after the
    last, so seeds and group totals come from the same pass without a join.
    """
    init, chosen = F.col("role") == "init", F.col("iteration").isNotNull()
    hit = (F.col("y") >= threshold) & (F.col("role") == "pool")
    place = F.when(init, F.lit(0.0)).when(chosen, F.col("iteration").cast("double")).otherwise(F.lit(_UNSELECTED))
    scanned = running(
        scored.withColumn("__place", place),
        run,
        "__place",
        "item_id",
        {
            "best_so_far": ("max", F.when(init | chosen, F.col("y"))),
            "best_selected": ("max", F.when(chosen & ~init, F.col("y"))),
            "n_found": ("sum", F.when(hit & chosen, F.lit(1)).otherwise(F.lit(0))),
            "sum_selected": ("sum", F.when(chosen, F.col("y"))),
            "n_selected": ("sum", chosen.cast("int")),
        },
        {"best_all": ("max", "y"), "n_pool_hits": ("sum", hit.cast("int"))},
    )
    return scanned.filter(chosen).select(
        *run,
        "iteration",
        "item_id",
        "y",
        "best_so_far",
        (F.col("best_all") - F.col("best_selected")).alias("regret"),
        F.coalesce(ratio("n_found", "n_pool_hits"), F.lit(0.0)).alias("discovered"),
        ratio("sum_selected", "n_selected").alias("cumulative_mean"),
    )


def rolling_mean(history: DataFrame, run: Sequence[str], value: str, rn: str = "iteration", width: int = 10, chunk: int = 100_000) -> DataFrame:
    """Trailing mean over full windows only. `rn` numbers the rows of a run from 1 without gaps."""
    wide = with_halo(history, rn, width - 1, max(chunk, width))
    frame = W.partitionBy(*run, "chunk").orderBy(rn).rowsBetween(-(width - 1), 0)
    out = wide.withColumns({"rolling_mean": F.avg(value).over(frame), "__n": F.count(F.lit(1)).over(frame)})
    return out.filter(~F.col("is_halo") & (F.col("__n") == width)).drop("chunk", "is_halo", "__n")


def seed_band(history: DataFrame, method: str, seed: str, value: str) -> DataFrame:
    """Mean and population std per step, cut to the shortest run of the method."""
    lengths = history.groupBy(method, seed).agg(F.max("iteration").alias("__len"))
    shortest = lengths.groupBy(method).agg(F.min("__len").alias("__shortest"))
    steps = history.groupBy(method, "iteration").agg(
        F.avg(value).alias("mean_value"), F.stddev_pop(value).alias("std_value"), F.count(F.lit(1)).alias("n_seeds")
    )
    return steps.join(shortest, method).filter(F.col("iteration") <= F.col("__shortest")).drop("__shortest")


def group_share(history: DataFrame, run: Sequence[str], group: str, groups_per_run: DataFrame) -> DataFrame:
    """Running count of each group's selections against an equal share of all selections so far."""
    counted = running(
        history, [*run, group], F.col("iteration").cast("double"), "item_id", {"group_count": ("count", F.lit(1))}
    )
    shares = counted.join(groups_per_run, list(run))
    return shares.withColumn("expected", ratio("iteration", "n_groups"))
