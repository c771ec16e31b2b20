"""Models on DataFrames, built on Spark ML."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from functools import partial, reduce

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, Evaluator
from pyspark.ml.feature import VarianceThresholdSelector
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..functions.hashing import draw, uniform
from ..functions.numeric import array_sum
from ..functions.scan import number_rows
from ..session import cut
from .candidates import expected_improvement
from .groups import bootstrap_weights, group_folds
from .metrics import (
    consensus, elite_labels, ndcg_at, precision_at, pseudo_weights, quadratic_kappa, rank_in_sample, ranking_quality, scaled_rank, sigma_scale, spearman, tail_rmse, tail_weights, z_scores,
)
from .neighbours import nearest_neighbours
from .stages import ClusterColumns, InformationSelector, MedianFill, Oversample, Stored, TrainingPipeline


def array_stats(values: Column) -> tuple[Column, Column]:
    """Mean and population deviation of an array column."""
    # sums about the first value in one pass: an expression in the lambda that reads the whole array would be evaluated once an element
    start = F.struct(F.lit(None).cast("double").alias("first"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))

    def add(acc, x):
        first = F.coalesce(acc["first"], x)
        return F.struct(first.alias("first"), (acc["s"] + (x - first)).alias("s"), (acc["q"] + (x - first) * (x - first)).alias("q"))

    sums = F.aggregate(values, start, add, lambda acc: F.struct(acc["first"].alias("first"), (acc["s"] / F.nullif(F.size(values), F.lit(0))).alias("m"), (acc["q"] / F.nullif(F.size(values), F.lit(0))).alias("q")))
    return sums["first"] + sums["m"], F.sqrt(F.greatest(sums["q"] - sums["m"] * sums["m"], F.lit(0.0)))


# ---- ordinal classification ----------------------------------------------------------


class OrdinalForest(Estimator, Stored):
    """M1: K - 1 weighted binary forests for P(y > k).

    Class weights come from one count per class; each fit reads the rows once per tree level.
    """

    SETTINGS = ("label", "features", "classes", "trees", "depth", "seed", "weight", "least_rows")

    def __init__(self, label: str = "label", features: str = "features", classes: int = 3, trees: int = 50, depth: int = 5, seed: int = 42, weight: str | None = None, least_rows: int = 1):
        super().__init__()
        self._keep(label=label, features=features, classes=classes, trees=trees, depth=depth, seed=seed, weight=weight, least_rows=least_rows)

    def _binary(self, k: int):
        """The classifier of P(y > k)."""
        return RandomForestClassifier(numTrees=self.value("trees"), maxDepth=self.value("depth"), minInstancesPerNode=self.value("least_rows"), seed=self.value("seed") + k)

    def _fit(self, df: DataFrame) -> "OrdinalForestModel":
        label, features, classes = self.value("label"), self.value("features"), self.value("classes")
        counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
        total, models = sum(counts.values()), []
        for k in range(classes - 1):
            above = sum(n for c, n in counts.items() if c > k)
            if above in (0, total):
                models.append(float(above == total))
                continue
            binary = (F.col(label) > k).cast("double")
            weight = F.when(F.col(label) > k, F.lit(total / (2.0 * above))).otherwise(F.lit(total / (2.0 * (total - above))))
            if self.value("weight") is not None:
                weight = weight * F.col(self.value("weight"))
            one = self._binary(k).setFeaturesCol(features).setLabelCol("__above").setWeightCol("__w")
            models.append(one.fit(df.select(features, binary.alias("__above"), weight.alias("__w"))))
        return OrdinalForestModel(models, features, classes)


class OrdinalBoost(OrdinalForest):
    """The same with boosted trees; `trees` rounds, each of weight `step` and on a `share` of the rows."""

    SETTINGS = (*OrdinalForest.SETTINGS, "step", "share")

    def __init__(self, label: str = "label", features: str = "features", classes: int = 3, trees: int = 20, depth: int = 4, seed: int = 42, weight: str | None = None, least_rows: int = 1,
                 step: float = 0.1, share: float = 1.0):
        super().__init__(label, features, classes, trees, depth, seed, weight, least_rows)
        self._keep(step=step, share=share)

    def _binary(self, k: int):
        return GBTClassifier(maxIter=self.value("trees"), maxDepth=self.value("depth"), minInstancesPerNode=self.value("least_rows"), seed=self.value("seed") + k,
                             stepSize=self.value("step"), subsamplingRate=self.value("share"))


def class_probabilities(above: Sequence[Column]) -> Column:
    """P(y = k) from P(y > k): positive differences, normalised."""
    edges = [F.lit(1.0), *above, F.lit(0.0)]
    raw = F.array(*[F.greatest(F.lit(0.0), a - b) for a, b in zip(edges, edges[1:])])
    # the sum is bound once, not computed for each class
    bound = F.array(F.struct(raw.alias("raw"), array_sum(raw).alias("total")))
    return F.transform(bound, lambda b: F.transform(b["raw"], lambda p: F.when(b["total"] > 0, p / b["total"]).otherwise(F.lit(1.0 / (len(above) + 1)))))[0]


class OrdinalForestModel(Model, Stored):
    SETTINGS = ("features", "classes")
    PARTS = ("models",)

    def __init__(self, models: list | None = None, features: str = "features", classes: int = 3):
        super().__init__()
        self.models = models or []
        self._keep(features=features, classes=classes)

    def _above(self, df: DataFrame) -> tuple[DataFrame, list[Column], list[str]]:
        columns, extra = [], []
        for k, model in enumerate(self.models):
            if isinstance(model, float):
                columns.append(F.lit(model))
                continue
            names = [f"__raw{k}", f"__prob{k}", f"__pred{k}"]
            df = model.copy().setRawPredictionCol(names[0]).setProbabilityCol(names[1]).setPredictionCol(names[2]).transform(df)
            columns.append(vector_to_array(names[1])[1])
            extra += names
        return df, columns, extra

    def _transform(self, df: DataFrame) -> DataFrame:
        out, above, extra = self._above(df)
        out = out.withColumn("class_probability", class_probabilities(above)).drop(*extra)
        best = F.array_max("class_probability")
        return out.withColumn("prediction", (F.array_position("class_probability", best) - 1).cast("int"))

    def with_uncertainty(self, df: DataFrame, trees: int = 20) -> DataFrame:
        """M2: mean and deviation of the class probabilities over single trees of forests (one column per tree, one pass)."""
        extra, per_tree = [], []
        for t in range(trees):
            above = []
            for k, model in enumerate(self.models):
                if isinstance(model, float):
                    above.append(F.lit(model))
                    continue
                tree = model.trees[t % len(model.trees)]
                names = [f"__r{k}_{t}", f"__p{k}_{t}", f"__c{k}_{t}"]
                df = tree.copy().setFeaturesCol(self.value("features")).setRawPredictionCol(names[0]).setProbabilityCol(names[1]).setPredictionCol(names[2]).transform(df)
                above.append(vector_to_array(names[1])[1])
                extra += names
            per_tree.append(class_probabilities(above))
        df = df.withColumn("__trees", F.array(*per_tree)).drop(*extra)
        for c in range(self.value("classes")):
            mean, spread = array_stats(F.transform("__trees", lambda p: p[c]))
            df = df.withColumns({f"mean_{c}": mean, f"std_{c}": spread})
        return df.drop("__trees")


def out_of_fold(df: DataFrame, fold: str, n_folds: int, fit: Callable[[DataFrame], Transformer]) -> DataFrame:
    """M9: every row scored by a model that never saw its fold."""
    parts = [fit(df.filter(F.col(fold) != f)).transform(df.filter(F.col(fold) == f)) for f in range(n_folds)]
    return reduce(DataFrame.unionByName, parts)


def stacked(df: DataFrame, fold: str, n_folds: int, bases: Sequence[Callable[[DataFrame], Transformer]], label: str) -> DataFrame:
    """M3: out-of-fold class probabilities of base models feed a meta model, itself scored out of fold."""
    keys, meta = df, []
    for i, base in enumerate(bases):
        scored = out_of_fold(keys, fold, n_folds, base)
        # the next model would otherwise replay every earlier one
        keys = cut(scored.withColumnRenamed("class_probability", f"__base{i}").drop("prediction"))
        meta.append(f"__base{i}")
    keys = keys.withColumn("__meta", array_to_vector(F.concat(*[F.col(m) for m in meta])))
    fit = lambda train: LogisticRegression(featuresCol="__meta", labelCol=label, probabilityCol="__p", rawPredictionCol="__r", predictionCol="prediction", maxIter=20).fit(train)
    return out_of_fold(keys, fold, n_folds, fit).drop("__p", "__r", "__meta", *meta)


# ---- regression surrogates ---------------------------------------------------------------


def leaf_values(model, trees: int) -> list[list[float]]:
    """Predictions of the leaves of each regression tree from left to right, read from the model's own listing."""
    values: list[list[float]] = []
    for line in model.toDebugString.splitlines():
        word = line.strip()
        if word.startswith("Tree "):
            values.append([])
        elif word.startswith("Predict:"):
            values[-1].append(float(word.removeprefix("Predict:")))
    if len(values) != trees:
        raise ValueError("not the listing of a forest")
    return values


class ForestSurrogate:
    """M4: mean and deviation over trees, deviation times a calibrated scale; tail weights to the power `alpha` (0: none)."""

    def __init__(self, y: str = "y", features: str = "features", trees: int = 30, depth: int = 6, seed: int = 42, tail: bool = True, alpha: float = 0.5):
        self.y, self.features, self.trees, self.depth, self.seed, self.tail, self.alpha = y, features, trees, depth, seed, tail, alpha
        self.scale = 1.0

    def _settings(self) -> dict:
        return {k: getattr(self, k) for k in ("y", "features", "trees", "depth", "seed", "tail", "alpha")}

    def fit(self, df: DataFrame, fold: str | None = None, n_folds: int = 5) -> "ForestSurrogate":
        """Fit; with a fold column also calibrate the scale on out-of-fold z."""
        if fold is not None:
            self.scale = calibrated(self.held_out(df, fold, f) for f in range(n_folds))
        return self._learn(df)

    def _learn(self, df: DataFrame) -> "ForestSurrogate":
        rows = tail_weights(df, self.y, alpha=self.alpha) if self.tail and self.alpha > 0 else df.withColumn("weight", F.lit(1.0))
        self.model = RandomForestRegressor(featuresCol=self.features, labelCol=self.y, weightCol="weight", numTrees=self.trees, maxDepth=self.depth, seed=self.seed).fit(
            rows.select(self.features, F.col(self.y).cast("double").alias(self.y), "weight")
        )
        return self

    def held_out(self, df: DataFrame, fold: str, f: int) -> DataFrame:
        """(y, mu, sigma) of the rows of a fold by a surrogate of the other rows."""
        other = ForestSurrogate(**self._settings())._learn(df.filter(F.col(fold) != f))
        return other.predict(df.filter(F.col(fold) == f)).select(F.col(self.y).alias("y"), "mu", "sigma")

    def per_tree(self, df: DataFrame) -> DataFrame:
        """Add `trees`, the array of tree predictions: the forest gives each row's leaves in one transform, whose values are looked up."""
        values = F.from_json(F.lit(json.dumps(leaf_values(self.model, self.trees))), "array<array<double>>")
        leaves = self.model.copy().setLeafCol("__leaves").setPredictionCol("__mean").transform(df)
        return leaves.withColumn("trees", F.transform(vector_to_array("__leaves"), lambda leaf, t: F.get(F.get(values, t), leaf.cast("int")))).drop("__leaves", "__mean")

    def predict(self, df: DataFrame) -> DataFrame:
        mean, spread = array_stats(F.col("trees"))
        return self.per_tree(df).withColumns({"mu": mean, "sigma": spread * F.lit(self.scale)}).drop("trees")

    def save(self, path: str) -> None:
        """Settings, scale and forest."""
        spark = SparkSession.active()
        self.model.write().save(f"{path}/forest")
        spark.createDataFrame([(json.dumps(self._settings() | {"scale": self.scale}),)], "settings string").coalesce(1).write.text(f"{path}/settings")

    @classmethod
    def load(cls, path: str) -> "ForestSurrogate":
        told = json.loads(SparkSession.active().read.text(f"{path}/settings").first()[0])
        scale = told.pop("scale")
        loaded = cls(**told)
        loaded.scale, loaded.model = scale, RandomForestRegressionModel.load(f"{path}/forest")
        return loaded


def calibrated(held_out: Iterable[DataFrame]) -> float:
    """The scale that gives z of held-out rows unit deviation; 1 when there is too little data."""
    parts = list(held_out)
    return float(sigma_scale(z_scores(reduce(DataFrame.unionByName, parts)), len(parts)).first()["sigma_scale"])


class RankSurrogate(ForestSurrogate):
    """M5: the same on the scaled rank of the target, without tail weights.

    Ranks are those of the rows that are learned from. So in calibration each fold's model has ranks of its own, and held-out targets are mapped into them (W8).
    """

    def __init__(self, y: str = "y", features: str = "features", trees: int = 30, depth: int = 6, seed: int = 42, tail: bool = False, alpha: float = 0.0):
        super().__init__(y, features, trees, depth, seed, False, 0.0)

    def ranked(self, df: DataFrame) -> DataFrame:
        """Add `__rank`: the target's rank among these rows, from 0 to 1."""
        rows = df.withColumns({"__one": F.lit(0), "__tie": F.xxhash64(F.col(self.y), self.features)})
        return scaled_rank(rows, ["__one"], self.y, "__tie", "__rank").drop("__one", "__tie")

    def mapped(self, df: DataFrame, sample: DataFrame) -> DataFrame:
        """Add `__rank`: where the target lies among the targets of `sample` (W8); one look-up for each distinct value."""
        value = F.col(self.y).cast("double")
        asked = df.select(value.alias("__v")).distinct().withColumn("__key", F.xxhash64("__v"))
        found = rank_in_sample(asked, sample.select(value.alias("__v")), "__v", "__key", "__rank")
        return df.withColumn("__v", value).join(found.select("__v", "__rank"), "__v", "left").drop("__v")

    def _learn(self, df: DataFrame) -> "RankSurrogate":
        self.inner = ForestSurrogate("__rank", self.features, self.trees, self.depth, self.seed, tail=False)._learn(self.ranked(df))
        self.model = self.inner.model
        # equal targets are one row
        self.sample = cut(df.groupBy(F.col(self.y).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n")))
        return self

    def held_out(self, df: DataFrame, fold: str, f: int) -> DataFrame:
        train = df.filter(F.col(fold) != f)
        other = RankSurrogate(**self._settings())._learn(train)
        return other.predict(self.mapped(df.filter(F.col(fold) == f), train)).select(F.col("__rank").alias("y"), "mu", "sigma")

    def raw_to_rank(self, value: float) -> float:
        """A raw target, such as the best so far, among the targets learned from."""
        told = self.sample.agg(F.sum(F.when(F.col("value") <= value, F.col("n")).otherwise(0)).alias("upto"), F.sum("n").alias("n")).first()
        return min(1.0, max(0.0, (told["upto"] - 1) / max(told["n"] - 1, 1)))

    def save(self, path: str) -> None:
        super().save(path)
        self.sample.write.parquet(f"{path}/sample")

    @classmethod
    def load(cls, path: str) -> "RankSurrogate":
        loaded = super().load(path)
        loaded.sample = SparkSession.active().read.parquet(f"{path}/sample")
        return loaded


class BoostedEnsemble:
    """M6: boosted regressors on bootstrap weights times tail weights; mean and deviation over the members, deviation times a calibrated scale.

    A row whose bootstrap count is 0 in a member was not seen by it. Such members alone give the row's mean and deviation in calibration, so no further fit is needed (A24).
    """

    def __init__(self, y: str = "y", features: str = "features", members: int = 5, rounds: int = 10, depth: int = 4, seed: int = 42, tail: bool = True):
        self.y, self.features, self.members, self.rounds, self.depth, self.seed, self.tail = y, features, members, rounds, depth, seed, tail
        self.scale = 1.0

    def fit(self, df: DataFrame, key: str) -> "BoostedEnsemble":
        rows = tail_weights(df, self.y) if self.tail else df.withColumn("weight", F.lit(1.0))
        counts = [f"boot_{m}" for m in range(self.members)]
        # every member reads it
        weighted = cut(bootstrap_weights(rows, key, self.members, self.seed).select(self.features, F.col(self.y).cast("double").alias(self.y), "weight", *counts))
        self.models = [
            GBTRegressor(featuresCol=self.features, labelCol=self.y, weightCol="__w", maxIter=self.rounds, maxDepth=self.depth, seed=self.seed + m).fit(
                weighted.filter(F.col(count) > 0).select(self.features, self.y, (F.col(count) * F.col("weight")).alias("__w"))
            )
            for m, count in enumerate(counts)
        ]
        self.scale = calibrated([self.out_of_bag(weighted, counts)])
        return self

    def _each(self, df: DataFrame) -> DataFrame:
        for i, model in enumerate(self.models):
            df = model.copy().setPredictionCol(f"__m{i}").transform(df)
        return df

    def out_of_bag(self, weighted: DataFrame, counts: Sequence[str]) -> DataFrame:
        """(y, mu, sigma) of rows by the members that have not seen them, where there are two or more."""
        unseen = F.filter(F.array(*[F.when(F.col(c) == 0, F.col(f"__m{i}")) for i, c in enumerate(counts)]), lambda x: x.isNotNull())
        rows = self._each(weighted).withColumn("__unseen", unseen).filter(F.size("__unseen") >= 2)
        mean, spread = array_stats(F.col("__unseen"))
        return rows.select(F.col(self.y).alias("y"), mean.alias("mu"), spread.alias("sigma"))

    def predict(self, df: DataFrame) -> DataFrame:
        names = [f"__m{i}" for i in range(len(self.models))]
        mean, spread = array_stats(F.array(*names))
        return self._each(df).withColumns({"mu": mean, "sigma": spread * F.lit(self.scale)}).drop(*names)

    def save(self, path: str) -> None:
        """Settings, scale and members."""
        settings = {k: getattr(self, k) for k in ("y", "features", "members", "rounds", "depth", "seed", "tail")}
        for i, model in enumerate(self.models):
            model.write().save(f"{path}/member_{i}")
        SparkSession.active().createDataFrame([(json.dumps(settings | {"scale": self.scale}),)], "settings string").coalesce(1).write.text(f"{path}/settings")

    @classmethod
    def load(cls, path: str) -> "BoostedEnsemble":
        told = json.loads(SparkSession.active().read.text(f"{path}/settings").first()[0])
        scale = told.pop("scale")
        loaded = cls(**told)
        loaded.scale, loaded.models = scale, [GBTRegressionModel.load(f"{path}/member_{i}") for i in range(loaded.members)]
        return loaded


# ---- scores ---------------------------------------------------------------------------------


def annealed_gamma(n: int, gamma: float) -> float:
    """M7: the elite share shrinks towards 0.10 as observations grow."""
    return max(0.10, gamma / (1.0 + n / 50.0))


def elite_score(observed: DataFrame, candidates: DataFrame, y: str, features: str = "features", gamma: float = 0.15, trees: int = 100, depth: int = 5,
                seed: int = 42, pseudo: DataFrame | None = None, fallback: Callable[[DataFrame], DataFrame] | None = None, anneal: bool = False) -> DataFrame:
    """M7, M8: P(elite) by a weighted forest; `pseudo` adds pool rows with (mu, sigma).

    When all labels agree the fallback scores the candidates (by default a seeded random number).
    """
    gamma = annealed_gamma(observed.count(), gamma) if anneal else gamma
    labelled = elite_labels(observed, y, gamma)
    span = labelled.agg(F.min("elite"), F.max("elite")).first()
    if span[0] == span[1]:
        plain = lambda df: df.withColumn("acquisition", uniform(F.xxhash64(features), F.lit(seed)))
        return (fallback or plain)(candidates)
    train = labelled.select(features, F.col("elite").cast("double").alias("elite"), "weight")
    if pseudo is not None:
        extra = pseudo_weights(labelled.select("tau", "elite", "weight"), pseudo)
        train = train.unionByName(extra.select(features, F.col("elite").cast("double").alias("elite"), "weight"))
    model = RandomForestClassifier(featuresCol=features, labelCol="elite", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed, probabilityCol="__p", rawPredictionCol="__r", predictionCol="__c").fit(train)
    return model.transform(candidates).withColumn("acquisition", vector_to_array("__p")[1]).drop("__p", "__r", "__c")


def thompson_score(surrogate: ForestSurrogate, candidates: DataFrame, key: str, seed: int = 42, tries: int = 20) -> DataFrame:
    """The predictions of one random tree; trees that are constant on the candidates are passed over.

    When the first `tries` drawn trees are all constant: mean plus seeded normal noise times sigma.
    """
    n = len(surrogate.model.trees)
    state, order = seed, []
    for _ in range(min(n, tries)):
        state = (state * 1_103_515_245 + 12_345) % (1 << 31)
        order.append(state % n)
    scored = surrogate.per_tree(candidates)
    spreads = scored.agg(*[F.stddev_pop(F.get("trees", F.lit(i))).alias(f"s{i}") for i in sorted(set(order))]).first()
    usable = [i for i in order if (spreads[f"s{i}"] or 0.0) > 1e-8]
    if usable:
        return scored.withColumn("acquisition", F.get("trees", F.lit(usable[0]))).drop("trees")
    u, v = uniform(key, F.lit(seed), F.lit("u")), uniform(key, F.lit(seed), F.lit("v"))
    noise = F.sqrt(-2 * F.log(F.greatest(u, F.lit(1e-12)))) * F.cos(F.lit(6.283185307179586) * v)
    mean, spread = array_stats(F.col("trees"))
    return scored.withColumn("acquisition", mean + noise * F.greatest(spread * F.lit(surrogate.scale), F.lit(1e-6))).drop("trees")


def acquisition(name: str, surrogate: ForestSurrogate, observed: DataFrame, candidates: DataFrame, key: str, y: str = "y", seed: int = 42, **options) -> DataFrame:
    """Candidates with an `acquisition` column by the named score."""
    if name == "random":
        return candidates.withColumn("acquisition", uniform(key, F.lit(seed)))
    if name == "thompson":
        return thompson_score(surrogate, candidates, key, seed)
    best = float(observed.agg(F.max(y)).first()[0])
    best = surrogate.raw_to_rank(best) if isinstance(surrogate, RankSurrogate) else best
    by_ei = lambda df: surrogate.predict(df).withColumn("acquisition", expected_improvement("mu", "sigma", best))
    if name == "ei":
        return by_ei(candidates)
    if name == "lfbo":
        return elite_score(observed, candidates, y, surrogate.features, seed=seed, fallback=by_ei, **options)
    if name == "lfbo_ssl":
        scored = surrogate.predict(candidates)
        return elite_score(observed, scored, y, surrogate.features, seed=seed, pseudo=scored, fallback=lambda df: by_ei(df.drop("mu", "sigma")), **options)
    if name == "consensus":
        ei = by_ei(candidates).withColumnRenamed("acquisition", "__ei")
        plain = lambda df: df.withColumn("acquisition", F.col("__ei"))
        both = elite_score(observed, ei, y, surrogate.features, seed=seed, fallback=plain, **options)
        return consensus(both, "__ei", "acquisition", key, out="__both").drop("__ei", "acquisition").withColumnRenamed("__both", "acquisition")
    raise ValueError(f"unknown score {name}")


def refit_batch(observed: DataFrame, candidates: DataFrame, key: str, make: Callable[[], ForestSurrogate], size: int = 3, strategy: str = "constant_liar", y: str = "y", score: str = "ei") -> DataFrame:
    """C4: each pick joins the observations with a stand-in value before the next fit.

    The stand-in is the best observed value ('constant_liar') or the rounded prediction ('kriging_believer').
    """
    surrogate, picks = make(), []
    best = float(observed.agg(F.max(y)).first()[0])
    base = cut(observed.select(surrogate.features, F.col(y).cast("double").alias(y)))  # every refit reads it
    seen, pool = base, candidates
    for _ in range(size):
        model = make().fit(seen)
        top = acquisition(score, model, seen, model.predict(pool), key, y) if score != "ei" else model.predict(pool).withColumn("acquisition", expected_improvement("mu", "sigma", best))
        pick = top.orderBy(F.desc("acquisition"), key).select(key, "mu", "acquisition").first()
        if pick is None:
            break
        picks.append((len(picks) + 1, pick[key], best if strategy == "constant_liar" else float(round(pick["mu"]))))
        # one filter and one union, however many picks there are
        chosen, values = [k for _, k, _ in picks], F.create_map(*[F.lit(x) for _, k, v in picks for x in (k, v)])
        taken = F.col(key).isin(chosen)
        seen = base.unionByName(candidates.filter(taken).select(surrogate.features, F.element_at(values, F.col(key)).alias(y)))
        pool = candidates.filter(~taken)
    return observed.sparkSession.createDataFrame(picks, f"batch_rank int, `{key}` {dict(candidates.dtypes)[key]}, stand_in double")


# ---- rows and clusters ------------------------------------------------------------------------


def oversample(df: DataFrame, key: str, vector: str, label: str, targets: Mapping, neighbours: int = 5, seed: int = 42) -> DataFrame:
    """Rows of each class up to its target count by interpolation towards one of the nearest rows of the class.

    The missing rows of a class are dealt evenly over its rows in a hashed order.
    """
    rows = df.select(F.col(key), F.col(vector).cast("array<double>").alias("vec"), label)
    kept = rows.select(F.col(key).cast("string").alias("row"), "vec", label)
    sizes = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    short = {c: (n - sizes[c]) for c, n in targets.items() if sizes.get(c, 0) >= 2 and n > sizes[c]}
    if not short:
        return kept
    per_class = lambda f: F.element_at(F.create_map(*[x for c in short for x in (F.lit(c), F.lit(f(c)))]), F.col(label))
    near = nearest_neighbours(rows, key, "vec", neighbours, within=label, groups=list(short))
    base = rows.filter(F.col(label).isin(list(short))).withColumn("__d", draw(key, F.lit(seed)))
    dealt = number_rows(base, [label], "__d", key, out="__rn", settle=True)
    copies = per_class(lambda c: short[c] // sizes[c]) + (F.col("__rn") <= per_class(lambda c: short[c] % sizes[c])).cast("int")
    made = dealt.withColumn("__n", copies).filter(F.col("__n") > 0).select(key, "vec", label, F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("copy"))
    pick = made.withColumn("rank", (draw(key, "copy", F.lit(seed)) % per_class(lambda c: min(neighbours, sizes[c] - 1)) + 1).cast("int"))
    other = rows.select(F.col(key).alias("neighbour"), F.col("vec").alias("to"))
    met = pick.join(near.select(F.col("id").alias(key), "neighbour", "rank"), [key, "rank"]).join(other, "neighbour")
    made_up = met.withColumn("__u", uniform(key, "copy", F.lit(seed), F.lit("u"))).select(
        F.concat_ws("+", F.col(key).cast("string"), F.col("copy").cast("string")).alias("row"),
        F.zip_with("vec", "to", lambda x, y: x + (y - x) * F.col("__u")).alias("vec"), label,
    )
    return kept.unionByName(made_up)


def cluster_sweep(df: DataFrame, features: str, label: str, rare, ks: Sequence[int], n_folds: int = 3, least: int = 5, seed: int = 42) -> DataFrame:
    """Per k the silhouette (squared Euclidean) and whether group folds leave at least `least` rare rows in each fold."""
    rows = []
    for k in ks:
        clustered = KMeans(featuresCol=features, predictionCol="cluster", k=k, seed=seed).fit(df).transform(df)
        silhouette = ClusteringEvaluator(featuresCol=features, predictionCol="cluster").evaluate(clustered)
        folds = group_folds(clustered.select("cluster", label), "cluster", label, n_folds, seed)
        worst = folds.groupBy("fold").agg(F.count_if(F.col(label) == rare).alias("n")).agg(F.min("n"), F.count(F.lit(1))).first()
        rows.append((k, float(silhouette), int(worst[0] or 0), bool(worst[1] == n_folds and (worst[0] or 0) >= least)))
    out = df.sparkSession.createDataFrame(rows, "k int, silhouette double, fewest_rare long, feasible boolean")
    best = out.agg(F.max_by("k", F.struct(F.col("feasible").cast("int"), F.col("silhouette")))).scalar()
    return out.withColumn("chosen", F.col("k") == best)


class KappaEvaluator(Evaluator):
    """Quadratic weighted kappa as an evaluator."""

    def __init__(self, truth: str, predicted: str = "prediction", classes: int = 3):
        super().__init__()
        self.truth, self.predicted, self.classes = truth, predicted, classes

    def _evaluate(self, dataset: DataFrame) -> float:
        return float(quadratic_kappa(dataset, [], self.truth, self.predicted, self.classes).first()["qwk"])

    def isLargerBetter(self) -> bool:
        return True


def concurrently(jobs: Sequence[Callable[[], object]], parallelism: int, spark: SparkSession) -> list:
    """Results of the jobs in order, `parallelism` of them at a time. When one fails, the Spark jobs of the others are cancelled and its error is raised."""
    tag, stopped = f"sweep-{uuid.uuid4().hex}", threading.Event()

    def tagged(job):
        if stopped.is_set():
            return None
        spark.sparkContext.addJobTag(tag)
        spark.sparkContext.setInterruptOnCancel(True)
        try:
            return job()
        except BaseException:
            stopped.set()
            raise
        finally:
            spark.sparkContext.removeJobTag(tag)

    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(tagged), job) for job in jobs]
        wait(started, return_when=FIRST_EXCEPTION)
        failed = next((f for f in started if f.done() and not f.cancelled() and f.exception()), None)
        if failed is not None:
            spark.sparkContext.cancelJobsWithTag(tag)
            raise failed.exception()
        return [f.result() for f in started]


def fold_sweep(df: DataFrame, fold: str, n_folds: int, grid: Sequence[Mapping], fit: Callable[[DataFrame, Mapping], Transformer], evaluate: Callable[[DataFrame], float], parallelism: int = 4) -> DataFrame:
    """One row per parameter set and fold with its score; feeds `sweep_summary`. The table is written once, and a few settings and folds are fitted at a time."""
    rows = cut(df)

    def one(i: int, params: Mapping, f: int):
        model = fit(rows.filter(F.col(fold) != f), params)
        return i, str(dict(sorted(params.items()))), f, float(evaluate(model.transform(rows.filter(F.col(fold) == f))))

    jobs = [partial(one, i, params, f) for i, params in enumerate(grid) for f in range(n_folds)]
    return df.sparkSession.createDataFrame(concurrently(jobs, parallelism, df.sparkSession), "setting int, params string, fold int, score double")


def score_sweep(df: DataFrame, fold: str, n_folds: int, grid: Sequence[Mapping], score: Callable[[DataFrame, DataFrame, Mapping], DataFrame], key: str, y: str, parallelism: int = 4) -> DataFrame:
    """Held-out scores, rows (setting, params, fold, id, y, score), one per row and setting.

    `score(train, test, params)` adds a column `score` to the test rows, whose target it does not see. Each setting and fold is written as it is done, a few at a time.
    """
    rows = cut(df)

    def one(i: int, params: Mapping, f: int) -> DataFrame:
        test = rows.filter(F.col(fold) == f)
        scored = score(rows.filter(F.col(fold) != f), test.drop(y), params).select(F.col(key).alias("id"), F.col("score").cast("double").alias("score"))
        told = test.select(F.col(key).alias("id"), F.col(y).cast("double").alias("y")).join(scored, "id")
        return cut(told.select(F.lit(i).alias("setting"), F.lit(json.dumps(dict(sorted(params.items())))).alias("params"), F.lit(f).alias("fold"), "id", "y", "score"))

    jobs = [partial(one, i, params, f) for i, params in enumerate(grid) for f in range(n_folds)]
    return reduce(DataFrame.unionByName, concurrently(jobs, parallelism, df.sparkSession))


def sweep_metrics(scored: DataFrame, threshold: float, k: int) -> DataFrame:
    """Per setting and fold the share of hits (y >= threshold) among the k best, NDCG at k, ROC-AUC and average precision of hits, Spearman and the error on the tail.

    A metric that is not defined for a fold is null: AUC without both classes, NDCG without gain, Spearman of a constant, tail error without a tail.
    """
    by, hit = ["setting", "params", "fold"], F.col("y") >= threshold
    top = precision_at(scored, by, hit, "score", "id", [k]).select(*by, F.col("precision_at_k").alias("hit_at_k"))
    curves = ranking_quality(scored, by, hit, "score")
    both = F.col("prevalence").between(1e-300, 1 - 1e-15)
    curves = curves.select(*by, F.when(both, F.col("roc_auc")).alias("roc_auc"), F.when(both, F.col("average_precision")).alias("pr_auc"))
    parts = [top, ndcg_at(scored, by, "y", "score", "id", k), curves, spearman(scored, by, "score", "y", "id"), tail_rmse(scored, by, "y", "score", threshold)]
    return reduce(lambda a, b: a.join(b, by, "left"), parts)


def gamma_sweep(df: DataFrame, fold: str, n_folds: int, gammas: Sequence[float], key: str, y: str, features: str = "features", trees: int = 100, depth: int = 5, parallelism: int = 4) -> DataFrame:
    """Held-out elite scores (M7) for each share of elites."""
    elite = lambda train, test, p: elite_score(train, test, y, features, p["gamma"], trees, depth).withColumnRenamed("acquisition", "score")
    return score_sweep(df, fold, n_folds, [{"gamma": g} for g in gammas], elite, key, y, parallelism)


def alpha_sweep(df: DataFrame, fold: str, n_folds: int, alphas: Sequence[float], key: str, y: str, features: str = "features", trees: int = 30, depth: int = 6, parallelism: int = 4) -> DataFrame:
    """Held-out predictions of the regression surrogate (M4) for each power of the tail weights."""
    forest = lambda train, test, p: ForestSurrogate(y, features, trees, depth, alpha=p["alpha"])._learn(train).predict(test).withColumnRenamed("mu", "score")
    return score_sweep(df, fold, n_folds, [{"alpha": a} for a in alphas], forest, key, y, parallelism)


# ---- assembly by variant -----------------------------------------------------------------------


# fixed values: the steps of each model variant, in order; `rf` are forests, `gb` boosted trees
STEPS = {
    "": ("impute", "variance", "oversample", "model"),
    "_mi": ("impute", "variance", "information", "oversample", "model"),
    "_cl": ("impute", "clusters", "variance", "oversample", "model"),
    "_cl_mi": ("impute", "clusters", "variance", "information", "oversample", "model"),
}
VARIANTS = {kind + name: steps for kind in ("rf", "gb") for name, steps in STEPS.items()}
# fixed values: parameters of a variant that was not tuned, and rows that classes 1 and 2 have at least
UNTUNED = {
    "rf": {"trees": 300, "depth": 10, "least_rows": 3},
    "gb": {"trees": 300, "depth": 4, "least_rows": 5, "step": 0.05, "share": 0.8},
}
LEAST_ROWS_OF_CLASS = {1: 180, 2: 250}


def variant_parameters(variant: str, tuned: Mapping[str, Mapping] | None = None) -> dict:
    """A variant's tuned parameters, by its name; those of its kind where there are none."""
    return dict((tuned or {}).get(variant) or UNTUNED[variant[:2]])


def assemble(variant: str, label: str, features: str = "features", regression: bool = False, key: str | None = None, tuned: Mapping[str, Mapping] | None = None, **options) -> TrainingPipeline:
    """The pipeline of a variant: medians for missing places, cluster columns, varying columns, selection, more rows of small classes, model.

    Everything is fitted on the rows given to `fit` alone. Oversampling needs a unique `key` column and is left out without one, and in regression. `options` goes before tuned
    parameters: trees, depth, least_rows, step, share; classes, clusters, k, k_continuous, discrete, targets. The pipeline and what it fits can be saved and loaded.
    """
    chosen = variant_parameters(variant, tuned) | {k: v for k, v in options.items() if k in ("trees", "depth", "least_rows", "step", "share")}
    stages, at = [], features
    for step in VARIANTS[variant]:
        if step == "impute":
            stages.append(MedianFill(at, "filled"))
            at = "filled"
        elif step == "clusters":
            stages.append(ClusterColumns(at, "with_clusters", options.get("clusters", 10)))
            at = "with_clusters"
        elif step == "variance":
            stages.append(VarianceThresholdSelector(featuresCol=at, outputCol="varying", varianceThreshold=0.0))
            at = "varying"
        elif step == "information":
            stages.append(InformationSelector(at, label, "selected", options.get("k", 100), options.get("k_continuous", 1000), options.get("discrete", ())))
            at = "selected"
        elif step == "oversample":
            if key is not None and not regression:
                stages.append(Oversample(at, label, key, options.get("targets", LEAST_ROWS_OF_CLASS)))
        elif not regression:
            stages.append((OrdinalForest if variant.startswith("rf") else OrdinalBoost)(label, at, options.get("classes", 3), **chosen))
        elif variant.startswith("rf"):
            stages.append(RandomForestRegressor(featuresCol=at, labelCol=label, numTrees=chosen["trees"], maxDepth=chosen["depth"], minInstancesPerNode=chosen["least_rows"], seed=42))
        else:
            stages.append(GBTRegressor(featuresCol=at, labelCol=label, maxIter=chosen["trees"], maxDepth=chosen["depth"], minInstancesPerNode=chosen["least_rows"],
                                       stepSize=chosen["step"], subsamplingRate=chosen["share"], seed=42))
    return TrainingPipeline(stages=stages)
