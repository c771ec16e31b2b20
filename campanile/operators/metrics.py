"""Label, ranking, calibration and comparison metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import correlation, normal_cdf
from ..functions.quantile import quantiles, quantiles_wide
from ..functions.scan import as_column, average_rank, count_at_most, number_rows, rank_counts, running

# 19 confidence levels 0.05 .. 0.95 and the two-sided normal quantile of each
LEVELS = tuple(round(0.05 * i, 2) for i in range(1, 20))
LEVEL_Z = tuple(NormalDist().inv_cdf((1 + c) / 2) for c in LEVELS)


def _share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


# ---- calibration -------------------------------------------------------------


def z_scores(predictions: DataFrame, y: str = "y", mu: str = "mu", sigma: str = "sigma") -> DataFrame:
    """Add `z`, null where sigma is not positive."""
    return predictions.withColumn("z", F.when(F.col(sigma) > 1e-10, (F.col(y) - F.col(mu)) / F.col(sigma)))


def calibration(predictions: DataFrame, by: Sequence[str], least: int = 5) -> DataFrame:
    """One row per model; metrics are null and `error` is set under `least` valid rows."""
    a = F.abs("z")
    gaps = [F.abs(_share(a <= z) - c) for c, z in zip(LEVELS, LEVEL_Z)]
    raw = z_scores(predictions).groupBy(*by).agg(
        F.count("z").alias("n_valid"),
        (F.count(F.lit(1)) - F.count("z")).alias("n_zero_sigma"),
        F.avg("z").alias("mean_z"), F.stddev_pop("z").alias("std_z"),
        *[_share(a <= float(k)).alias(f"within_{k}") for k in (1, 2, 3)],
        (reduce(lambda p, q: p + q, gaps) / len(LEVELS)).alias("calibration_error"),
    )
    enough = F.col("n_valid") >= least
    fields = ["mean_z", "std_z", "within_1", "within_2", "within_3", "calibration_error"]
    return raw.withColumns({f: F.when(enough, F.col(f)) for f in fields}).withColumn("error", F.when(~enough, F.lit("too few non-zero sigma values")))


def reliability_points(predictions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Observed coverage at each of the 19 levels."""
    pts = F.array(*[F.struct(F.lit(c).alias("level"), _share(F.abs("z") <= z).alias("observed")) for c, z in zip(LEVELS, LEVEL_Z)])
    return z_scores(predictions).groupBy(*by).agg(pts.alias("pts")).select(*by, F.explode("pts").alias("p")).select(*by, "p.*")


def z_histogram(predictions: DataFrame, by: Sequence[str], bins: int = 30, limit: float = 5.0) -> DataFrame:
    """Density of z clipped to +/- limit in equal bins; the last bin is closed."""
    width = 2 * limit / bins
    clipped = F.greatest(F.lit(-limit), F.least(F.lit(limit), F.col("z")))
    at = F.least(F.floor((clipped + limit) / width), F.lit(bins - 1)).cast("int")
    counts = z_scores(predictions).filter(F.col("z").isNotNull()).groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(*by))
    return counts.withColumn("density", F.col("n") / (total * width))


def sigma_scale(z: DataFrame, n_folds: int = 5, floor: float = 0.1) -> DataFrame:
    """max(population std of pooled z, floor); 1 when there is too little data; quality band."""
    row = z.agg(F.count(F.lit(1)).alias("n"), F.count("z").alias("n_z"), F.stddev_pop("z").alias("s"))
    scale = F.when((F.col("n") < 2 * n_folds) | (F.col("n_z") < 10), F.lit(1.0)).otherwise(F.greatest("s", F.lit(floor)))
    return row.select(scale.alias("sigma_scale")).withColumn("quality", sigma_quality("sigma_scale"))


def sigma_quality(scale) -> Column:
    """C11: good within [0.7, 1.8], ok within [0.4, 3.0], else poor."""
    s = as_column(scale)
    return F.when(s.between(0.7, 1.8), "good").when(s.between(0.4, 3.0), "ok").otherwise("poor")


# ---- labels and weights --------------------------------------------------------


def search_bounds(df: DataFrame, column: str, low: float = 0.05, high: float = 0.95, hard: tuple[float, float] | None = None) -> DataFrame:
    """Quantile bounds cut to a hard interval; the hard one wins when they do not meet."""
    q = quantiles_wide(df, [], column, {"low": low, "high": high})
    if hard is None:
        return q
    a, b = F.greatest("low", F.lit(float(hard[0]))), F.least("high", F.lit(float(hard[1])))
    return q.select(F.when(a < b, a).otherwise(F.lit(float(hard[0]))).alias("low"), F.when(a < b, b).otherwise(F.lit(float(hard[1]))).alias("high"))


def elite_labels(df: DataFrame, y: str, gamma: float = 0.15) -> DataFrame:
    """Add tau, label y >= tau, and the improvement weight with positives normalised to mean 1."""
    tau = quantiles(df, [], y, [1 - gamma]).select("q").scalar()
    tagged = df.withColumn("tau", tau)
    positive = F.col(y) >= F.col("tau")
    gain = F.greatest(F.col(y) - F.col("tau"), F.lit(1e-6))
    mean_gain = tagged.agg(F.avg(F.when(positive, gain))).scalar()
    return tagged.withColumn("elite", positive.cast("int")).withColumn("mean_gain", mean_gain).withColumn(
        "weight", F.when(positive, gain / F.col("mean_gain")).otherwise(F.lit(1.0))
    ).drop("mean_gain")


def is_degenerate(labelled: DataFrame) -> DataFrame:
    """Whether all labels agree."""
    return labelled.agg((F.min("elite") == F.max("elite")).alias("degenerate"))


def pseudo_weights(observed: DataFrame, pool: DataFrame, base: float = 0.3) -> DataFrame:
    """M8: labels and weights of pool rows (mu, sigma) next to labelled observations (tau, elite, weight)."""
    facts = observed.agg(F.max("tau").alias("tau"), F.avg(F.when(F.col("elite") == 1, F.col("weight"))).alias("w"))
    median = quantiles(pool, [], "sigma", [0.5]).select("q").scalar()
    tagged = pool.withColumn("tau", facts.select("tau").scalar()).withColumn("sigma_median", median)
    positive = F.col("mu") >= F.col("tau")
    gain = F.greatest(F.col("mu") - F.col("tau"), F.lit(1e-6))
    mean_gain = tagged.agg(F.greatest(F.avg(F.when(positive, gain)), F.lit(1e-6))).scalar()
    trust = F.when(F.col("sigma_median") > 1e-10, F.lit(base) / (1 + F.col("sigma") / F.col("sigma_median"))).otherwise(F.lit(base))
    return (
        tagged.withColumns({"mean_gain": mean_gain, "observed_mean": facts.select(F.coalesce("w", F.lit(1.0))).scalar()})
        .withColumn("elite", positive.cast("int"))
        .withColumn("weight", trust * F.when(positive, gain / F.col("mean_gain") * F.col("observed_mean")).otherwise(F.lit(1.0)))
        .drop("mean_gain", "observed_mean")
    )


def pseudo_diagnostics(observed: DataFrame, pseudo: DataFrame) -> DataFrame:
    """M8: the audit row."""
    counts = pseudo.agg(
        F.count(F.lit(1)).alias("n_pseudo"), F.sum("elite").alias("n_pseudo_pos"), F.avg(F.col("elite").cast("double")).alias("frac_pseudo_pos"),
        F.max("sigma_median").alias("sigma_median"), F.max("tau").alias("tau"),
    )
    p90 = quantiles(pseudo, [], "sigma", [0.9]).select("q").scalar()
    n_obs = observed.agg(F.count(F.lit(1))).scalar()
    n_pos = observed.agg(F.sum("elite")).scalar()
    return counts.withColumns({"sigma_p90": p90, "n_observed": n_obs, "n_observed_pos": n_pos})


def _literal_map(table: DataFrame, key: str, value: str) -> Column:
    """A table of a few rows per class or bin as one map value."""
    return table.agg(F.map_from_entries(F.collect_list(F.struct(key, value)))).scalar()


def tail_weights(df: DataFrame, y: str, threshold: float = 7.0, alpha: float = 0.5, min_freq: float = 1e-3) -> DataFrame:
    """Inverse-frequency weight of the score bin on the tail, mean 1 over all rows. At most 11 bins."""
    slot = F.greatest(F.lit(0), F.least(F.lit(10), F.bround(y).cast("int")))
    counts = df.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) >= threshold).alias("n_tail"))
    total = F.sum("n").over(W.partitionBy())
    weight = F.pow(1 / F.greatest(F.col("n") / total, F.lit(min_freq)), F.lit(alpha))
    table = counts.select("slot", weight.alias("w"), "n", "n_tail")
    mean = table.agg(F.sum(F.col("n_tail") * F.col("w") + F.col("n") - F.col("n_tail")) / F.sum("n")).scalar()
    tagged = df.withColumns({"__slots": _literal_map(table, "slot", "w"), "__mean": mean})
    raw = F.when(F.col(y) >= threshold, F.element_at("__slots", slot)).otherwise(F.lit(1.0))
    return tagged.withColumn("weight", raw / F.col("__mean")).drop("__slots", "__mean")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """N / (classes * class size), joined to the rows, so there may be many classes. A null label counts as a class and has no weight."""
    counts = df.groupBy(F.col(label).alias("__label")).agg(F.count(F.lit(1)).alias("__n"))
    rows, classes = counts.agg(F.sum("__n")).scalar(), counts.agg(F.count(F.lit(1))).scalar()
    table = counts.select("__label", (rows / (classes * F.col("__n"))).alias("__w"))
    joined = df.join(table, F.col(label) == F.col("__label"), "left")
    return joined.withColumn("class_weight", F.col("__w")).drop("__label", "__n", "__w")


# ---- ordinal and ranking metrics ------------------------------------------------


def quadratic_kappa(df: DataFrame, by: Sequence[str], truth: str, predicted: str, classes: int = 3) -> DataFrame:
    """From one count per cell; 0 with one true class, 1 when the denominator is 0."""
    k = range(classes)
    cells = df.groupBy(*by).agg(
        *[F.count_if((F.col(truth) == i) & (F.col(predicted) == j)).cast("double").alias(f"o_{i}_{j}") for i in k for j in k]
    )
    col = lambda i, j: F.col(f"o_{i}_{j}")
    add = lambda parts: reduce(lambda a, b: a + b, parts)
    weight = lambda i, j: (i - j) ** 2 / (classes - 1) ** 2
    rows = [add([col(i, j) for j in k]) for i in k]
    cols = [add([col(i, j) for i in k]) for j in k]
    total = F.greatest(add(rows), F.lit(1.0))
    num = add([col(i, j) * weight(i, j) for i in k for j in k if i != j])
    den = add([rows[i] * cols[j] / total * weight(i, j) for i in k for j in k if i != j])
    true_classes = add([(r > 0).cast("int") for r in rows])
    return cells.select(*by, F.when(true_classes < 2, F.lit(0.0)).otherwise(1 - F.coalesce(F.try_divide(num, den), F.lit(0.0))).alias("qwk"))


def error_rates(df: DataFrame, by: Sequence[str], truth: str, predicted: str) -> DataFrame:
    """A30."""
    gap = F.abs(F.col(truth).cast("double") - F.col(predicted).cast("double"))
    return df.groupBy(*by).agg(F.avg(gap).alias("mae"), _share(gap <= 1).alias("within_1"), _share(F.col(truth).cast("int") == F.col(predicted).cast("int")).alias("exact"))


def confusion(df: DataFrame, by: Sequence[str], truth: str, predicted: str, labels: Sequence[int]) -> DataFrame:
    """Every label pair with its count and share of the true label."""
    cells = F.array(*[
        F.struct(F.lit(i).alias("truth"), F.lit(j).alias("predicted"), F.count_if((F.col(truth) == i) & (F.col(predicted) == j)).alias("n"),
                 F.count_if(F.col(truth) == i).alias("n_true"))
        for i in labels for j in labels
    ])
    out = df.groupBy(*by).agg(cells.alias("cells")).select(*by, F.explode("cells").alias("c")).select(*by, "c.*")
    return out.withColumn("share", F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("n_true").cast("double")), F.lit(0.0))).drop("n_true")


def _score_steps(df: DataFrame, by: Sequence[str], positive: Column, score: str) -> DataFrame:
    """One row per distinct score with positive and negative counts, and their running and whole sums."""
    folded = df.groupBy(*by, score).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    return running(
        folded, by, score, F.lit(0), {"pos_upto": ("sum", "pos"), "neg_upto": ("sum", "neg")}, {"pos_all": ("sum", "pos"), "neg_all": ("sum", "neg")}
    )


def ranking_quality(df: DataFrame, by: Sequence[str], positive: Column, score: str) -> DataFrame:
    """ROC-AUC, average precision and prevalence, exact under ties."""
    steps = _score_steps(df, by, positive, score)
    below = F.col("neg_upto") - F.col("neg")
    tp = F.col("pos_all") - F.col("pos_upto") + F.col("pos")
    fp = F.col("neg_all") - F.col("neg_upto") + F.col("neg")
    out = steps.groupBy(*by).agg(
        F.sum(F.col("pos") * (below + F.col("neg") / 2)).alias("wins"),
        F.sum(F.col("pos") * tp / (tp + fp)).alias("ap_sum"),
        F.max("pos_all").alias("p"), F.max("neg_all").alias("n"),
    )
    return out.select(
        *by, F.try_divide(F.col("wins"), (F.col("p") * F.col("n")).cast("double")).alias("roc_auc"),
        F.try_divide(F.col("ap_sum"), F.col("p").cast("double")).alias("average_precision"),
        (F.col("p") / (F.col("p") + F.col("n"))).alias("prevalence"),
    )


def curve_points(df: DataFrame, by: Sequence[str], positive: Column, score: str) -> DataFrame:
    """False-positive rate, true-positive rate (recall) and precision at every distinct score."""
    steps = _score_steps(df, by, positive, score)
    tp = F.col("pos_all") - F.col("pos_upto") + F.col("pos")
    fp = F.col("neg_all") - F.col("neg_upto") + F.col("neg")
    return steps.select(
        *by, score, F.try_divide(fp.cast("double"), F.col("neg_all").cast("double")).alias("fpr"),
        F.try_divide(tp.cast("double"), F.col("pos_all").cast("double")).alias("tpr"), (tp / (tp + fp)).alias("precision"),
    )


def _top(df: DataFrame, by: Sequence[str], score: str, tie: str, k: int) -> DataFrame:
    """The k best rows per group; Spark applies the rank limit before it moves rows."""
    order = W.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def precision_at(df: DataFrame, by: Sequence[str], positive: Column, score: str, tie: str, ks: Sequence[int]) -> DataFrame:
    """Precision and hit at each k, k capped by the group size."""
    top = _top(df.withColumn("__hit", positive.cast("int")), by, score, tie, max(ks))
    points = F.array(*[
        F.struct(F.lit(k).alias("k"), F.avg(F.when(F.col("rank") <= k, F.col("__hit").cast("double"))).alias("precision_at_k"),
                 F.max(F.when(F.col("rank") <= k, F.col("__hit"))).alias("hit_at_k"))
        for k in ks
    ])
    return top.groupBy(*by).agg(points.alias("p")).select(*by, F.explode("p").alias("p")).select(*by, "p.*")


def ndcg_at(df: DataFrame, by: Sequence[str], gain: str, score: str, tie: str, k: int) -> DataFrame:
    """Gain is the raw value; null when the ideal is 0."""
    discounted = lambda d: F.sum(F.col(gain) / F.log2(F.col("rank") + 1)).alias(d)
    got = _top(df, by, score, tie, k).groupBy(*by).agg(discounted("dcg"))
    ideal = _top(df, by, gain, tie, k).groupBy(*by).agg(discounted("idcg"))
    return got.join(ideal, list(by)).select(*by, F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).alias("ndcg"))


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str, tie: str) -> DataFrame:
    """Correlation of average ranks, null when a side is constant."""
    a = rank_counts(df.select(*by, tie, x, y), by, x, tie, "xl", "xe", "xn", settle=True)
    b = rank_counts(a, by, y, tie, "yl", "ye", "yn")
    rx, ry = average_rank("xl", "xe"), average_rank("yl", "ye")
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return b.groupBy(*by).agg(F.when(varies, correlation(rx, ry)).alias("spearman"))


def tail_rmse(df: DataFrame, by: Sequence[str], y: str, predicted: str, threshold: float) -> DataFrame:
    """A36."""
    err = F.col(predicted) - F.col(y)
    return df.groupBy(*by).agg(F.sqrt(F.avg(F.when(F.col(y) >= threshold, err * err))).alias("tail_rmse"))


# ---- summaries of sweeps and folds ------------------------------------------------


def sweep_summary(folds: DataFrame, parameter: str, metrics: Sequence[str], medians: Sequence[str], best_by: str) -> DataFrame:
    """Mean and population std per parameter, medians of diagnostics, and the best parameter.

    Fold tables hold one row per parameter and fold.
    """
    out = folds.groupBy(parameter).agg(
        *[F.avg(m).alias(f"{m}_mean") for m in metrics], *[F.stddev_pop(m).alias(f"{m}_std") for m in metrics],
        *[F.median(m).alias(f"{m}_median") for m in medians],
    )
    best = out.agg(F.min_by(parameter, F.struct((-F.col(f"{best_by}_mean")).alias("k"), F.col(parameter).alias("p")))).scalar()
    return out.withColumn("is_best", F.col(parameter) == best)


def repeated_mean(folds: DataFrame, by: Sequence[str], repeat: str, metric: str) -> DataFrame:
    """Mean of the repeat means, sample std over all folds."""
    per_repeat = folds.groupBy(*by, repeat).agg(F.avg(metric).alias("m"))
    means = per_repeat.groupBy(*by).agg(F.avg("m").alias("mean_value"))
    return means.join(folds.groupBy(*by).agg(F.stddev_samp(metric).alias("std_value")), list(by))


def learning_curve(scores: DataFrame, model: str, size: str, train: str, valid: str) -> DataFrame:
    """Mean and std per size, and the gap."""
    out = scores.groupBy(model, size).agg(
        F.avg(train).alias("train_mean"), F.stddev_pop(train).alias("train_std"), F.avg(valid).alias("val_mean"), F.stddev_pop(valid).alias("val_std")
    )
    return out.withColumn("gap", F.col("train_mean") - F.col("val_mean"))


def final_gap(curve: DataFrame, model: str, size: str) -> DataFrame:
    """The largest size per model and its gap class. The class texts are fixed values."""
    last = curve.groupBy(model).agg(F.max(size).alias(size), F.max_by("gap", size).alias("gap"), F.max_by("val_mean", size).alias("val_mean"))
    kind = F.when(F.col("gap") > 0.10, "possible overfitting").when(F.col("gap") > 0.04, "moderate gap").otherwise("fairly tight train/validation fit")
    return last.withColumn("gap_class", kind)


# ---- paired comparison ---------------------------------------------------------------


def paired_deltas(pairs: DataFrame, key: str, metrics: Mapping[str, bool]) -> DataFrame:
    """Long (key, metric, a, b, delta), positive meaning A is better; pairs with a null dropped."""
    rows = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"{m}_a").alias("a"), F.col(f"{m}_b").alias("b"),
                 (F.col(f"{m}_a") - F.col(f"{m}_b") if up else F.col(f"{m}_b") - F.col(f"{m}_a")).alias("delta"))
        for m, up in metrics.items()
    ])
    return pairs.select(key, F.explode(rows).alias("r")).select(key, "r.*").filter(F.col("delta").isNotNull())


# above so many deltas the exact distribution is not asked for
EXACT = 50


def signed_rank_tail(t: Column, n: Column) -> Column:
    """Probability that the ranks 1 to n with random signs have a positive sum of `t` or more: subsets counted by their sum, one rank after another."""
    zeros = lambda k: F.array_repeat(F.lit(0.0), k)
    counts = F.aggregate(F.sequence(F.lit(1), n), F.array(F.lit(1.0)), lambda c, k: F.zip_with(F.concat(c, zeros(k)), F.concat(zeros(k), c), lambda x, y: x + y))
    return F.aggregate(F.slice(counts, t + 1, n * n), F.lit(0.0), lambda s, x: s + x) / F.pow(F.lit(2.0), n)


def signed_rank(deltas: DataFrame, by: Sequence[str], delta: str = "delta") -> DataFrame:
    """One-sided Wilcoxon with zeros split; 1 when all are zero.

    Up to `EXACT` deltas without ties and zeros have the exact distribution, others the normal approximation with tie correction.
    Equal absolute deltas fold to one counted row, whose mean rank follows from the running count.
    """
    size = F.abs(F.col(delta))
    folded = deltas.groupBy(*by, size.alias("__d")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(delta) > 0).alias("pos"), F.count_if(F.col(delta) == 0).alias("zero")
    )
    ranked = running(folded, by, "__d", F.lit(0), {"upto": ("sum", "n")}, {"all": ("sum", "n")})
    rank = F.col("upto") - (F.col("n") - 1) / 2
    out = ranked.groupBy(*by).agg(
        F.sum(rank * (F.col("pos") + F.col("zero") / 2)).alias("t"), F.max("all").alias("n"), F.sum("zero").alias("n_zero"),
        F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"),
    )
    n = F.col("n").cast("double")
    spread = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("ties") / 2) / 24)
    z = F.try_divide(F.col("t") - n * (n + 1) / 4, spread)
    exact = (F.col("n") <= EXACT) & (F.col("ties") == 0) & (F.col("n_zero") == 0)
    return out.select(*by, F.when(F.col("n_zero") == F.col("n"), F.lit(1.0)).when(exact, signed_rank_tail(F.col("t").cast("int"), F.col("n").cast("int"))).otherwise(1 - normal_cdf(z)).alias("p_value"))


def decision(n, median, p, win_rate) -> Column:
    """A42. The codes are fixed values."""
    n, m, p, w = map(as_column, (n, median, p, win_rate))
    return (
        F.when(n < 3, "insufficient_data").when(n < 10, "underpowered")
        .when((m > 0) & (p < 0.05) & (w >= 0.6), "A_wins")
        .when((m < 0) & (1 - p < 0.05) & (w <= 0.4), "B_likely_better").otherwise("tie")
    )


def paired_summary(pairs: DataFrame, key: str, metrics: Mapping[str, bool]) -> DataFrame:
    """One row per metric: valid pairs, share of positive deltas, means and quartiles, which are null under three pairs."""
    deltas = paired_deltas(pairs, key, metrics)
    counts = deltas.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n_valid"), F.avg((F.col("delta") > 0).cast("double")).alias("win_rate"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b")
    )
    q = quantiles_wide(deltas, ["metric"], "delta", {"q1": 0.25, "median_delta": 0.5, "q3": 0.75})
    fields = ["win_rate", "mean_a", "mean_b", "q1", "median_delta", "q3"]
    return counts.join(q, "metric").withColumns({f: F.when(F.col("n_valid") >= 3, F.col(f)) for f in fields})


def paired_compare(pairs: DataFrame, key: str, metrics: Mapping[str, bool]) -> DataFrame:
    """The summary with p-value and decision."""
    tested = signed_rank(paired_deltas(pairs, key, metrics), ["metric"])
    out = paired_summary(pairs, key, metrics).join(tested, "metric")
    decided = decision("n_valid", "median_delta", "p_value", "win_rate")
    return out.withColumn("decision", decided).withColumn("p_value", F.when(F.col("n_valid") >= 3, F.col("p_value")))


# ---- importance, datasets, variance -----------------------------------------------------


def importance_means(importance: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean over thresholds."""
    return importance.groupBy(*by).agg(F.avg(value).alias("importance"))


def top_features(means: DataFrame, feature: str, n: int = 20) -> DataFrame:
    """Rows of the n features with the largest maximum."""
    best = means.groupBy(feature).agg(F.max("importance").alias("__m")).orderBy(F.desc("__m"), feature).limit(n)
    return means.join(best.select(feature), feature, "left_semi")


def importance_pivot(means: DataFrame, feature: str, model: str, models: Sequence[str]) -> DataFrame:
    """One column per model, 0 where a model lacks the feature."""
    return means.groupBy(feature).agg(*[F.coalesce(F.avg(F.when(F.col(model) == m, F.col("importance"))), F.lit(0.0)).alias(m) for m in models])


def importance_by_group(importance: DataFrame, group: str, value: str) -> DataFrame:
    """A43."""
    return importance.groupBy(group).agg(F.sum(value).alias("total"), F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("n_features"))


def dataset_summary(df: DataFrame, score: str, item: str, position: str) -> DataFrame:
    """Rows, best score, id of the first best row."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(score).alias("best_score"),
        F.min_by(item, F.when(F.col(score).isNotNull(), F.struct((-F.col(score)).alias("s"), F.col(position).alias("p")))).alias("best_item"),
    )


def next_id(df: DataFrame, source: str, item: str, mark: str = "gui", prefix: str = "GUI-") -> DataFrame:
    """A45."""
    n = F.count_if((F.lower(F.trim(F.col(source))) == mark) & F.col(item).isNotNull()) + 1
    return df.agg(F.concat(F.lit(prefix), n.cast("string")).alias("next_id"))


def group_variance(df: DataFrame, group: str, y: str) -> DataFrame:
    """Within and between variance over groups of at least two rows."""
    per = df.groupBy(group).agg(F.count(y).alias("n"), F.var_samp(y).alias("v"), F.avg(y).alias("m")).filter(F.col("n") >= 2)
    row = per.agg(F.sum("n").alias("n_rows"), F.avg("v").alias("within_var"), F.var_samp("m").alias("between_var"))
    ratio = F.col("between_var") / (F.col("within_var") + 1e-9)
    enough = F.col("n_rows") >= 4
    return row.select(
        F.when(enough, F.col("within_var")).alias("within_var"), F.when(enough, F.col("between_var")).alias("between_var"),
        F.when(enough, ratio).alias("ratio"), F.when(enough, ratio > 2).alias("passes"),
    )


# ---- rank transforms --------------------------------------------------------------------


def scaled_rank(df: DataFrame, by: Sequence[str], y: str, tie: str, out: str = "rank01") -> DataFrame:
    """(average rank - 1) / max(n - 1, 1)."""
    counted = rank_counts(df, by, y, tie)
    return counted.withColumn(out, (average_rank() - 1) / F.greatest(F.col("n_all") - 1, F.lit(1))).drop("n_lt", "n_eq", "n_all")


def rank_in_sample(queries: DataFrame, sample: DataFrame, value: str, key: str, out: str = "rank01") -> DataFrame:
    """clip((count(sample <= v) - 1) / max(n - 1, 1), 0, 1) for each query row.

    Sample rows fold to one counted row per value and sort before the query rows of that value, so one
    running sum answers every query.
    """
    folded = sample.groupBy(F.col(value).cast("double").alias(value)).agg(F.count(F.lit(1)).alias("__ref"))
    ref = folded.select(F.lit(None).cast("bigint").alias(key), value, "__ref")
    ask = queries.select(F.col(key).cast("bigint").alias(key), F.col(value).cast("double").alias(value), F.lit(0).cast("bigint").alias("__ref"))
    both = ref.unionByName(ask)
    both = both.withColumn("__tie", F.when(F.col("__ref") > 0, F.lit(0)).otherwise(F.lit(1) + F.pmod(F.xxhash64(key), F.lit(1 << 20))))
    scanned = running(both, [], value, "__tie", {"__le": ("sum", "__ref")}, {"__n": ("sum", "__ref")})
    rank = (F.col("__le") - 1) / F.greatest(F.col("__n") - 1, F.lit(1))
    return scanned.filter(F.col("__ref") == 0).select(key, value, F.greatest(F.lit(0.0), F.least(F.lit(1.0), rank)).alias(out))


def consensus(df: DataFrame, first: str, second: str, tie: str, fraction: float = 0.10, out: str = "consensus") -> DataFrame:
    """Second score's rank; rows in the top fraction of both get the mean rank plus 1. Ids break ties at the cut."""
    a = rank_counts(df, [], first, tie, "al", "ae", "an", rn="ar", settle=True)
    c = rank_counts(a, [], second, tie, "bl", "be", "bn", rn="br")
    n = F.col("an")
    k = F.greatest(F.lit(1), F.floor(n * fraction))
    ra, rb = average_rank("al", "ae") / n, average_rank("bl", "be") / n
    both = (F.col("ar") > n - k) & (F.col("br") > n - k)
    return c.withColumn(out, F.when(both, (ra + rb) / 2 + 1).otherwise(rb)).drop("al", "ae", "an", "bl", "be", "bn", "ar", "br")


def equal_frequency_bins(df: DataFrame, x: str, n_bins: int = 10, out: str = "bin") -> DataFrame:
    """Bin number by quantile edges (n_bins + 1 numbers held on the driver); the maximum falls outside."""
    probs = [i / n_bins for i in range(n_bins + 1)]
    edges = sorted(r["q"] for r in quantiles(df, [], x, probs).collect())
    binned = count_at_most(edges, x, out, df, strict=False)
    return binned.filter(F.col(out).between(1, n_bins))


def bin_statistics(df: DataFrame, x: str, y: str, n_bins: int = 10, least: int = 3) -> DataFrame:
    """Median of x, mean and standard error of y per bin; bins under `least` rows dropped."""
    binned = equal_frequency_bins(df, x, n_bins)
    stats = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean_y"), (F.stddev_pop(y) / F.sqrt(F.count(F.lit(1)))).alias("se_y"), (F.avg(F.col(y) * F.col(y)) / 2).alias("semivariance"))
    medians = quantiles_wide(binned, ["bin"], x, {"median_x": 0.5})
    return stats.filter(F.col("n") >= least).join(medians, "bin")
