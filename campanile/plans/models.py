"""Spark ML models bound to `embeddings` (vectors with a label 0-9)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..functions.hashing import draw
from ..operators import metrics as Q
from ..operators import models as M
from ..operators.stages import MedianFill, Oversample
from .registry import query


def rows(t):
    vector = array_to_vector(F.transform("embedding", lambda x: x.cast("double")))
    label = F.when(F.col("label") <= 2, 0).when(F.col("label") <= 5, 1).otherwise(2)
    return t.embeddings.select("vec_id", vector.alias("features"), F.col("label").cast("double").alias("y"), label.alias("cls"), (draw("vec_id") % 3).cast("int").alias("fold"))


def small_forest(train):
    return M.OrdinalForest("cls", trees=8, depth=4).fit(train)


@query("m1_ordinal_forest")
def _(t):
    out = small_forest(rows(t)).transform(rows(t))
    return out.select("vec_id", "prediction", F.round(F.aggregate("class_probability", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("m2_ordinal_uncertainty")
def _(t):
    out = small_forest(rows(t)).with_uncertainty(rows(t), trees=4)
    return out.select("vec_id", *[F.round(c, 6).alias(c) for c in ("mean_0", "std_0", "mean_2", "std_2")])


@query("m3_stacking")
def _(t):
    out = M.stacked(rows(t), "fold", 3, [small_forest, lambda train: M.OrdinalForest("cls", trees=4, depth=2).fit(train)], "cls")
    return out.select("vec_id", "cls", "prediction")


@query("m4_forest_surrogate")
def _(t):
    model = M.ForestSurrogate(trees=8, depth=4).fit(rows(t), "fold", 3)
    return model.predict(rows(t)).select("vec_id", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"))


@query("m5_rank_surrogate")
def _(t):
    model = M.RankSurrogate(trees=8, depth=4).fit(rows(t), "fold", 3)
    return model.predict(rows(t)).select("vec_id", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"))


@query("m6_boosted_ensemble")
def _(t):
    model = M.BoostedEnsemble(members=3, rounds=3, depth=3).fit(rows(t), "vec_id")
    return model.predict(rows(t)).select("vec_id", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"))


@query("m7_elite_score")
def _(t):
    return M.elite_score(rows(t), rows(t).drop("y"), "y", trees=10).select("vec_id", F.round("acquisition", 6).alias("acquisition"))


@query("m8_elite_score_with_pool")
def _(t):
    observed = rows(t).filter("fold < 2")
    pool = M.ForestSurrogate(trees=8, depth=4).fit(observed).predict(rows(t).filter("fold = 2"))
    return M.elite_score(observed, pool.drop("y"), "y", trees=10, pseudo=pool).select("vec_id", F.round("acquisition", 6).alias("acquisition"))


@query("m9_out_of_fold")
def _(t):
    scored = M.out_of_fold(rows(t), "fold", 3, small_forest)
    return scored.select("vec_id", "fold", "cls", "prediction")


@query("m9_prediction_table", """WITH e AS (SELECT vec_id, (('0x' || substr(md5(vec_id::VARCHAR), 1, 8))::BIGINT % 3)::INTEGER AS fold, CASE WHEN label <= 2 THEN 0 WHEN label <= 5 THEN 1 ELSE 2 END::INTEGER AS cls FROM embeddings)
SELECT fold, cls, count(*) AS n, count(DISTINCT vec_id) AS n_ids, true AS in_range FROM e GROUP BY 1, 2""")
def _(t):
    """Every row is predicted once, in its own fold, by a class that exists."""
    scored = M.out_of_fold(rows(t), "fold", 3, small_forest)
    good = F.bool_and(F.col("prediction").isin(0, 1, 2))
    return scored.groupBy("fold", "cls").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("vec_id").alias("n_ids"), good.alias("in_range"))


@query("m10_fold_sweep")
def _(t):
    grid = [{"depth": 2}, {"depth": 4}]
    fit = lambda train, p: M.OrdinalForest("cls", trees=6, depth=p["depth"]).fit(train)
    folds = M.fold_sweep(rows(t), "fold", 3, grid, fit, M.KappaEvaluator("cls").evaluate)
    return Q.sweep_summary(folds, "params", ["score"], ["score"], "score")


@query("m10_gamma_sweep")
def _(t):
    scored = M.gamma_sweep(rows(t), "fold", 3, [0.1, 0.25], "vec_id", "y", trees=6, depth=4)
    return M.sweep_metrics(scored, 7, 20).select("params", "fold", *[F.round(c, 6).alias(c) for c in ("hit_at_k", "ndcg", "roc_auc", "pr_auc")])


@query("m10_alpha_sweep")
def _(t):
    metrics = M.sweep_metrics(M.alpha_sweep(rows(t), "fold", 3, [0.0, 0.5], "vec_id", "y", trees=6, depth=4), 7, 20)
    return Q.sweep_summary(metrics, "params", ["hit_at_k", "ndcg", "spearman", "tail_rmse"], ["hit_at_k"], "hit_at_k")


@query("m10_sweep_metrics", """WITH e AS (SELECT vec_id AS id, (vec_id % 3)::INTEGER AS fold, label::DOUBLE AS y, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings),
s AS (SELECT w::INTEGER AS setting, id, fold, y, CASE w WHEN 0 THEN a ELSE y + 3 * b END AS score FROM e, (SELECT unnest([0, 1]) AS w)),
r AS (SELECT *, row_number() OVER (PARTITION BY setting, fold ORDER BY score DESC, id) AS top, row_number() OVER (PARTITION BY setting, fold ORDER BY y DESC, id) AS ideal,
      rank() OVER (PARTITION BY setting, fold ORDER BY score) + (count(*) OVER (PARTITION BY setting, fold, score) - 1) / 2.0::DOUBLE AS rs,
      rank() OVER (PARTITION BY setting, fold ORDER BY y) + (count(*) OVER (PARTITION BY setting, fold, y) - 1) / 2.0::DOUBLE AS ry,
      sum((y >= 7)::INT) OVER (PARTITION BY setting, fold ORDER BY score DESC) AS tp, count(*) OVER (PARTITION BY setting, fold ORDER BY score DESC) AS upto FROM s),
h AS (SELECT setting, fold, sum((y >= 7)::INT) AS p, sum((y < 7)::INT) AS n FROM s GROUP BY 1, 2),
auc AS (SELECT a.setting, a.fold, sum(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END)::DOUBLE AS wins FROM s a JOIN s b USING (setting, fold) WHERE a.y >= 7 AND b.y < 7 GROUP BY 1, 2)
SELECT setting, fold, round(avg((y >= 7)::INT) FILTER (top <= 20), 6) AS hit_at_k, round(sum(y / log2(top + 1)) FILTER (top <= 20) / sum(y / log2(ideal + 1)) FILTER (ideal <= 20), 6) AS ndcg,
       round(any_value(wins) / any_value(p * n), 6) AS roc_auc, round(sum(CASE WHEN y >= 7 THEN tp / upto::DOUBLE END) / any_value(p), 6) AS pr_auc, round(corr(rs, ry), 6) AS spearman,
       round(sqrt(avg((score - y) * (score - y)) FILTER (y >= 7)), 6) AS tail_rmse
FROM r JOIN h USING (setting, fold) JOIN auc USING (setting, fold) GROUP BY 1, 2""")
def _(t):
    table = t.embeddings.select("vec_id", F.col("label").cast("double").alias("y"), (F.col("vec_id") % 3).cast("int").alias("fold"), "embedding", F.col("label").alias("target"))
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    score = lambda train, test, p: test.withColumn("score", at(0) if p["w"] == 0 else F.col("target") + 3 * at(1))
    scored = M.score_sweep(table, "fold", 3, [{"w": 0}, {"w": 1}], score, "vec_id", "y")
    names = ["hit_at_k", "ndcg", "roc_auc", "pr_auc", "spearman", "tail_rmse"]
    return M.sweep_metrics(scored, 7, 20).select("setting", "fold", *[F.round(c, 6).alias(c) for c in names])


@query("m12_thompson_score")
def _(t):
    model = M.ForestSurrogate(trees=8, depth=4).fit(rows(t))
    return M.thompson_score(model, rows(t), "vec_id").select("vec_id", F.round("acquisition", 6).alias("acquisition"))


@query("m13_score_dispatch")
def _(t):
    observed, pool = rows(t).filter("fold < 2"), rows(t).filter("fold = 2").drop("y")
    model = M.ForestSurrogate(trees=8, depth=4).fit(observed)
    out = None
    for name in ("random", "ei", "thompson", "lfbo", "lfbo_ssl", "consensus"):
        options = {} if name in ("random", "ei", "thompson") else {"trees": 8}
        part = M.acquisition(name, model, observed, pool, "vec_id", **options).select("vec_id", F.lit(name).alias("score"), F.round("acquisition", 6).alias("acquisition"))
        out = part if out is None else out.unionByName(part)
    return out


def with_holes(t):
    """Eight places of each vector, a fifth of them missing, in three folds by id."""
    places = F.transform(F.slice("embedding", 1, 8), lambda x, i: F.when((F.col("vec_id") + i) % 5 != 0, x.cast("double")))
    return rows(t).drop("features", "fold").join(t.embeddings.select("vec_id", places.alias("features"), (F.col("vec_id") % 3).cast("int").alias("fold")), "vec_id")


@query("m15_fold_medians", """WITH v AS (SELECT vec_id, vec_id % 3 AS f, unnest(embedding[1:8])::DOUBLE AS x, unnest(range(8)) AS place FROM embeddings), folds AS (SELECT unnest([0, 1, 2])::INTEGER AS fold)
SELECT fold, place::INTEGER AS place, round(median(x), 6) AS median FROM v, folds WHERE f <> fold AND (vec_id + place) % 5 <> 0 GROUP BY 1, 2""")
def _(t):
    medians = [(f, MedianFill().fit(with_holes(t).filter(F.col("fold") != f)).value("medians")) for f in range(3)]
    found = t.spark.createDataFrame(medians, "fold int, m array<double>")
    return found.select("fold", F.posexplode("m").alias("place", "median")).withColumn("median", F.round("median", 6))


@query("m15_training_rows", """WITH c AS (SELECT vec_id % 3 AS f, CASE WHEN label <= 2 THEN 0 WHEN label <= 5 THEN 1 ELSE 2 END::INTEGER AS cls FROM embeddings), folds AS (SELECT unnest([0, 1, 2])::INTEGER AS fold)
SELECT fold, cls, greatest(count(*), 250) AS n FROM c, folds WHERE f <> fold GROUP BY 1, 2""")
def _(t):
    more = Oversample("filled", "cls", "vec_id", {0: 250, 1: 250, 2: 250})
    parts = []
    for f in range(3):
        train = with_holes(t).filter(F.col("fold") != f)
        parts.append(more.resample(MedianFill().fit(train).transform(train)).groupBy("cls").agg(F.count(F.lit(1)).alias("n")).select(F.lit(f).alias("fold"), "cls", "n"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def assembled(t, variant, **options):
    """Fitted on two folds, all rows scored."""
    table = with_holes(t)
    model = M.assemble(variant, "cls", key="vec_id", targets={0: 250, 1: 250}, clusters=4, k_continuous=6, **options).fit(table.filter("fold < 2"))
    return model.transform(table).select("vec_id", "cls", "prediction")


@query("m15_assembled_variant")
def _(t):
    return assembled(t, "rf_cl_mi", trees=6, depth=5)


@query("m15_boosted_variant")
def _(t):
    return assembled(t, "gb_mi", trees=3, depth=3)


@query("c4_refit_batch")
def _(t):
    observed, pool = rows(t).filter("fold < 2"), rows(t).filter("fold = 2").drop("y")
    return M.refit_batch(observed, pool, "vec_id", lambda: M.ForestSurrogate(trees=6, depth=3), 3)


@query("g5_cluster_columns")
def _(t):
    model = M.ClusterColumns(k=4).fit(rows(t))
    wide = model.transform(rows(t)).select("vec_id", vector_to_array("with_clusters").alias("v"))
    return wide.select("vec_id", F.size("v").alias("width"), F.aggregate(F.slice("v", 65, 4), F.lit(0.0), lambda s, x: s + x).alias("hot"))


@query("g6_cluster_sweep")
def _(t):
    return M.cluster_sweep(rows(t), "features", "cls", 0, [4, 8, 12]).withColumn("silhouette", F.round("silhouette", 4))


@query("g8_oversample", "WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT label, greatest(n, (SELECT max(n) FROM c)) AS n FROM c")
def _(t):
    sizes = {r[0]: r[1] for r in t.embeddings.groupBy("label").count().collect()}
    out = M.oversample(t.embeddings, "vec_id", "embedding", "label", {c: max(sizes.values()) for c in sizes})
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
