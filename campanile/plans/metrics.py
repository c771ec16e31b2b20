"""Label, ranking, calibration and comparison metrics bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import draw
from ..operators import features as X
from ..operators import joins as J
from ..operators import metrics as M
from .registry import query


def r6(*names, digits=6):
    return {n: F.round(n, digits) for n in names}


def predictions(t):
    return t.events.select(F.col("event_type").alias("model"), "event_id", F.col("value").alias("y"), F.lit(20.0).alias("mu"), (F.pmod("user_id", F.lit(10)) * 4.0).alias("sigma"))


PRED = """pred AS (SELECT event_type AS model, event_id, value AS y, 20.0::DOUBLE AS mu, (user_id % 10) * 4.0::DOUBLE AS sigma FROM events),
z AS (SELECT *, CASE WHEN sigma > 1e-10 THEN (y - mu) / sigma END AS z FROM pred)"""
CAL_GAP = " + ".join(f"abs(avg((abs(z) <= {z!r}::DOUBLE)::INT) - {c!r}::DOUBLE)" for c, z in zip(M.LEVELS, M.LEVEL_Z))


@query("a23_calibration", f"""WITH {PRED} SELECT model, count(z) AS n_valid, count(*) - count(z) AS n_zero_sigma, round(avg(z), 6) AS mean_z, round(stddev_pop(z), 6) AS std_z,
round(avg((abs(z) <= 1)::INT), 6) AS within_1, round(avg((abs(z) <= 2)::INT), 6) AS within_2, round(avg((abs(z) <= 3)::INT), 6) AS within_3,
round(({CAL_GAP}) / 19, 6) AS calibration_error, NULL::VARCHAR AS error FROM z GROUP BY 1""")
def _(t):
    return M.calibration(predictions(t), ["model"]).withColumns(r6("mean_z", "std_z", "within_1", "within_2", "within_3", "calibration_error"))


@query("a24_sigma_scale", f"WITH {PRED} SELECT round(greatest(stddev_pop(z), 0.1), 6) AS sigma_scale, CASE WHEN stddev_pop(z) BETWEEN 0.7 AND 1.8 THEN 'good' WHEN stddev_pop(z) BETWEEN 0.4 AND 3.0 THEN 'ok' ELSE 'poor' END AS quality FROM z")
def _(t):
    return M.sigma_scale(M.z_scores(predictions(t))).withColumns(r6("sigma_scale"))


@query("a25_search_bounds", "SELECT round(greatest(quantile_cont(o_totalprice, 0.05), 30000), 6) AS low, round(least(quantile_cont(o_totalprice, 0.95), 450000), 6) AS high FROM orders")
def _(t):
    return M.search_bounds(t.orders, "o_totalprice", hard=(30000, 450000)).withColumns(r6("low", "high"))


ELITE = """tau AS (SELECT quantile_cont(o_totalprice, 0.85::DOUBLE) AS tau FROM orders),
lab AS (SELECT o_orderkey, o_totalprice AS y, tau, (o_totalprice >= tau)::INTEGER AS elite, greatest(o_totalprice - tau, 1e-6) AS gain FROM orders, tau),
obs AS (SELECT *, CASE WHEN elite = 1 THEN gain / (SELECT avg(gain) FROM lab WHERE elite = 1) ELSE 1 END AS weight FROM lab)"""


@query("a26_elite_labels", f"WITH {ELITE} SELECT o_orderkey, elite, round(tau, 4) AS tau, round(weight, 6) AS weight FROM obs")
def _(t):
    out = M.elite_labels(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice")
    return out.select("o_orderkey", "elite", F.round("tau", 4).alias("tau"), F.round("weight", 6).alias("weight"))


@query("a26_degenerate_flag", f"WITH {ELITE} SELECT min(elite) = max(elite) AS degenerate FROM obs")
def _(t):
    return M.is_degenerate(M.elite_labels(t.orders.select("o_totalprice"), "o_totalprice"))


@query("a27_tail_weights", """WITH y AS (SELECT o_orderkey, o_totalprice / 58800 AS y FROM orders), s AS (SELECT *, greatest(0, least(10, round_even(y, 0)))::INTEGER AS slot FROM y),
f AS (SELECT slot, greatest(count(*) / (SELECT count(*) FROM y)::DOUBLE, 0.001) AS freq FROM s GROUP BY 1),
w AS (SELECT o_orderkey, CASE WHEN y >= 7 THEN pow(1 / freq, 0.5) ELSE 1 END AS w FROM s JOIN f USING (slot))
SELECT o_orderkey, round(w / (SELECT avg(w) FROM w), 6) AS weight FROM w""")
def _(t):
    # the rarest bin has about 3 of 10,000 orders, less than the floor of the frequency
    y = t.orders.select("o_orderkey", (F.col("o_totalprice") / 58800).alias("y"))
    return M.tail_weights(y, "y").select("o_orderkey", F.round("weight", 6).alias("weight"))


@query("a28_class_weights", """WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderkey, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n)::DOUBLE, 6) AS class_weight FROM orders JOIN c USING (o_orderstatus)""")
def _(t):
    return M.class_weights(t.orders, "o_orderstatus").select("o_orderkey", F.round("class_weight", 6).alias("class_weight"))


CLASSES = """c AS (SELECT o_orderkey, o_orderpriority AS model, (CASE WHEN o_totalprice <= 150000 THEN 0 WHEN o_totalprice <= 300000 THEN 1 ELSE 2 END)::INTEGER AS truth,
(('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT) AS d FROM orders), cls AS (SELECT *, (CASE WHEN d % 4 = 0 THEN d // 4 % 3 ELSE truth END)::INTEGER AS pred FROM c)"""


def classes(t):
    d = draw("o_orderkey")
    truth = F.when(F.col("o_totalprice") <= 150000, 0).when(F.col("o_totalprice") <= 300000, 1).otherwise(2)
    return t.orders.select(
        "o_orderkey", F.col("o_orderpriority").alias("model"), truth.alias("truth"),
        F.when(d % 4 == 0, F.floor(d / 4) % 3).otherwise(truth).cast("int").alias("pred"),
        (d % 3).cast("int").alias("fold"), (F.floor(d / 3) % 5).cast("int").alias("repeat"), "o_totalprice", "o_orderstatus",
    )


@query("a29_quadratic_kappa", f"""WITH {CLASSES}, n AS (SELECT model, count(*)::DOUBLE AS n FROM cls GROUP BY 1),
o AS (SELECT model, truth, pred, count(*) AS o FROM cls GROUP BY 1, 2, 3), a AS (SELECT model, truth, count(*) AS a FROM cls GROUP BY 1, 2), p AS (SELECT model, pred, count(*) AS p FROM cls GROUP BY 1, 2),
num AS (SELECT model, sum((truth - pred) * (truth - pred) / 4.0::DOUBLE * o) AS num FROM o GROUP BY 1),
den AS (SELECT a.model, sum((truth - pred) * (truth - pred) / 4.0::DOUBLE * a.a * p.p / n) AS den FROM a JOIN p USING (model) JOIN n USING (model) GROUP BY 1)
SELECT model, round(1 - num / den, 6) AS qwk FROM num JOIN den USING (model)""")
def _(t):
    return M.quadratic_kappa(classes(t), ["model"], "truth", "pred").withColumns(r6("qwk"))


@query("a30_error_rates", f"WITH {CLASSES} SELECT model, round(avg(abs(truth - pred)), 6) AS mae, round(avg((abs(truth - pred) <= 1)::INT), 6) AS within_1, round(avg((truth = pred)::INT), 6) AS exact FROM cls GROUP BY 1")
def _(t):
    return M.error_rates(classes(t), ["model"], "truth", "pred").withColumns(r6("mae", "within_1", "exact"))


@query("a31_confusion", f"""WITH {CLASSES}, dom AS (SELECT model, i.i AS truth, j.j AS predicted FROM (SELECT DISTINCT model FROM cls), (SELECT unnest([0, 1, 2, 3])::INTEGER AS i) i, (SELECT unnest([0, 1, 2, 3])::INTEGER AS j) j),
k AS (SELECT d.model, d.truth, d.predicted, count(c.pred) AS n FROM dom d LEFT JOIN cls c ON c.model = d.model AND c.truth = d.truth AND c.pred = d.predicted GROUP BY 1, 2, 3)
SELECT model, truth, predicted, n, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY model, truth), 0)::DOUBLE, 0), 6) AS share FROM k""")
def _(t):
    return M.confusion(classes(t), ["model"], "truth", "pred", [0, 1, 2, 3]).withColumns(r6("share"))


RANKED = "r AS (SELECT o_orderkey, o_orderpriority AS model, o_orderstatus = 'F' AS pos, floor(o_totalprice / 5000) AS score FROM orders)"


def ranked(t):
    return t.orders.select("o_orderkey", F.col("o_orderpriority").alias("model"), (F.col("o_orderstatus") == "F").alias("pos"), F.floor(F.col("o_totalprice") / 5000).cast("double").alias("score"))


STEPS = f"""{RANKED}, f AS (SELECT model, score, count(*) FILTER (pos) AS pos, count(*) FILTER (NOT pos) AS neg FROM r GROUP BY 1, 2),
s AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY score DESC) AS tp, sum(neg) OVER (PARTITION BY model ORDER BY score DESC) AS fp, sum(pos) OVER (PARTITION BY model) AS p, sum(neg) OVER (PARTITION BY model) AS n FROM f)"""


@query("a32_ranking_quality", f"""WITH {STEPS} SELECT model, round(sum(pos * (n - fp + neg / 2.0::DOUBLE)) / max(p * n), 6) AS roc_auc, round(sum(pos * tp / (tp + fp)::DOUBLE) / max(p), 6) AS average_precision,
round(max(p / (p + n)::DOUBLE), 6) AS prevalence FROM s GROUP BY 1""")
def _(t):
    return M.ranking_quality(ranked(t), ["model"], F.col("pos"), "score").withColumns(r6("roc_auc", "average_precision", "prevalence"))


@query("a52_curve_points", f"WITH {STEPS} SELECT model, score, round(fp / n::DOUBLE, 6) AS fpr, round(tp / p::DOUBLE, 6) AS tpr, round(tp / (tp + fp)::DOUBLE, 6) AS precision FROM s")
def _(t):
    return M.curve_points(ranked(t), ["model"], F.col("pos"), "score").withColumns(r6("fpr", "tpr", "precision"))


@query("a52_z_histogram", f"""WITH {PRED}, b AS (SELECT model, least(floor((greatest(-5, least(5, z)) + 5) / (10.0::DOUBLE / 30)), 29)::INTEGER AS bin FROM z WHERE z IS NOT NULL)
SELECT model, bin, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY model) * (10.0::DOUBLE / 30)), 6) AS density FROM b GROUP BY 1, 2""")
def _(t):
    return M.z_histogram(predictions(t), ["model"]).withColumns(r6("density"))


@query("a52_reliability_points", f"WITH {PRED}, l AS (SELECT unnest([{', '.join(f'{c}::DOUBLE' for c in M.LEVELS)}]) AS level, unnest([{', '.join(f'{z!r}::DOUBLE' for z in M.LEVEL_Z)}]) AS zq) SELECT model, level, round(avg((abs(z) <= zq)::INT), 6) AS observed FROM z, l WHERE z IS NOT NULL GROUP BY 1, 2")
def _(t):
    return M.reliability_points(predictions(t), ["model"]).withColumns(r6("observed"))


@query("a33_precision_at_k", f"""WITH {CLASSES}, x AS (SELECT model, (d % 3)::INTEGER AS fold, truth = 2 AS hit, row_number() OVER (PARTITION BY model, d % 3 ORDER BY pred DESC, o_orderkey) AS rank FROM cls), k AS (SELECT unnest([5, 10, 50])::INTEGER AS k)
SELECT model, fold, k, round(avg(hit::INT), 6) AS precision_at_k, max(hit::INTEGER) AS hit_at_k FROM x, k WHERE rank <= k GROUP BY 1, 2, 3""")
def _(t):
    return M.precision_at(classes(t), ["model", "fold"], F.col("truth") == 2, "pred", "o_orderkey", [5, 10, 50]).withColumns(r6("precision_at_k"))


@query("a33_precision_pivot", f"""WITH {CLASSES}, x AS (SELECT model, (d % 3)::INTEGER AS fold, truth = 2 AS hit, row_number() OVER (PARTITION BY model, d % 3 ORDER BY pred DESC, o_orderkey) AS rank FROM cls), k AS (SELECT unnest([5, 50])::INTEGER AS k),
p AS (SELECT model, fold, k, avg(hit::INT) AS p FROM x, k WHERE rank <= k GROUP BY 1, 2, 3) SELECT model, round(avg(p) FILTER (k = 5), 6) AS k5, round(avg(p) FILTER (k = 50), 6) AS k50 FROM p GROUP BY 1""")
def _(t):
    p = M.precision_at(classes(t), ["model", "fold"], F.col("truth") == 2, "pred", "o_orderkey", [5, 50])
    return p.groupBy("model").agg(*[F.round(F.avg(F.when(F.col("k") == k, F.col("precision_at_k"))), 6).alias(f"k{k}") for k in (5, 50)])


@query("a34_ndcg", f"""WITH {CLASSES}, x AS (SELECT model, truth, row_number() OVER (PARTITION BY model ORDER BY pred DESC, o_orderkey) AS r, row_number() OVER (PARTITION BY model ORDER BY truth DESC, o_orderkey) AS ri FROM cls)
SELECT model, round(sum(truth / log2(r + 1)) FILTER (r <= 100) / sum(truth / log2(ri + 1)) FILTER (ri <= 100), 6) AS ndcg FROM x GROUP BY 1""")
def _(t):
    return M.ndcg_at(classes(t), ["model"], "truth", "pred", "o_orderkey", 100).withColumns(r6("ndcg"))


@query("a35_spearman", """WITH x AS (SELECT event_type, value, user_id, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0::DOUBLE AS rx,
rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2.0::DOUBLE AS ry FROM events) SELECT event_type, round(corr(rx, ry), 6) AS spearman FROM x GROUP BY 1""")
def _(t):
    return M.spearman(t.events, ["event_type"], "value", "user_id", "event_id").withColumns(r6("spearman"))


@query("a36_tail_rmse", "SELECT event_type, round(sqrt(avg(pow(20 - value, 2)) FILTER (value >= 30)), 6) AS tail_rmse FROM events GROUP BY 1")
def _(t):
    return M.tail_rmse(t.events.withColumn("mu", F.lit(20.0)), ["event_type"], "value", "mu", 30).withColumns(r6("tail_rmse"))


FOLDS = "f AS (SELECT ((user_id % 5) / 10.0)::DOUBLE AS gamma, event_type AS fold, avg(value) AS hit, stddev_pop(value) AS ndcg, count(*)::DOUBLE AS n_pos FROM events GROUP BY 1, 2)"


@query("a37_sweep_summary", f"""WITH {FOLDS}, s AS (SELECT gamma, avg(hit) AS hit_mean, stddev_pop(hit) AS hit_std, avg(ndcg) AS ndcg_mean, stddev_pop(ndcg) AS ndcg_std, median(n_pos) AS n_pos_median FROM f GROUP BY 1)
SELECT gamma, round(hit_mean, 6) AS hit_mean, round(hit_std, 6) AS hit_std, round(ndcg_mean, 6) AS ndcg_mean, round(ndcg_std, 6) AS ndcg_std, n_pos_median, gamma = (SELECT gamma FROM s ORDER BY hit_mean DESC, gamma LIMIT 1) AS is_best FROM s""")
def _(t):
    folds = t.events.groupBy((F.pmod("user_id", F.lit(5)) / 10.0).alias("gamma"), F.col("event_type").alias("fold")).agg(
        F.avg("value").alias("hit"), F.stddev_pop("value").alias("ndcg"), F.count(F.lit(1)).cast("double").alias("n_pos"))
    return M.sweep_summary(folds, "gamma", ["hit", "ndcg"], ["n_pos"], "hit").withColumns(r6("hit_mean", "hit_std", "ndcg_mean", "ndcg_std"))


@query("a38_repeated_mean", f"""WITH {CLASSES}, f AS (SELECT model, (d % 3) AS fold, (d // 3 % 5) AS rep, avg((truth = pred)::INT) AS acc FROM cls GROUP BY 1, 2, 3), r AS (SELECT model, rep, avg(acc) AS m FROM f GROUP BY 1, 2)
SELECT model, round((SELECT avg(m) FROM r WHERE r.model = f.model), 6) AS mean_value, round(stddev_samp(acc), 6) AS std_value FROM f GROUP BY 1""")
def _(t):
    folds = classes(t).groupBy("model", "fold", "repeat").agg(F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("acc"))
    return M.repeated_mean(folds, ["model"], "repeat", "acc").withColumns(r6("mean_value", "std_value"))


LC = "lc AS (SELECT o_orderpriority AS model, year(o_orderdate)::INTEGER AS size, month(o_orderdate) AS fold, avg((o_orderstatus = 'F')::INT) * 1.5::DOUBLE AS tr, avg((o_orderstatus = 'F')::INT) + 0.1::DOUBLE AS va FROM orders GROUP BY 1, 2, 3), c AS (SELECT model, size, avg(tr) AS train_mean, stddev_pop(tr) AS train_std, avg(va) AS val_mean, stddev_pop(va) AS val_std, avg(tr) - avg(va) AS gap FROM lc GROUP BY 1, 2)"


def learning_scores(t):
    rate = F.avg((F.col("o_orderstatus") == "F").cast("double"))
    return t.orders.groupBy(F.col("o_orderpriority").alias("model"), F.year("o_orderdate").alias("size"), F.month("o_orderdate").alias("fold")).agg((rate * 1.5).alias("tr"), (rate + 0.1).alias("va"))


@query("a39_learning_curve", f"WITH {LC} SELECT model, size, round(train_mean, 6) AS train_mean, round(train_std, 6) AS train_std, round(val_mean, 6) AS val_mean, round(val_std, 6) AS val_std, round(gap, 6) AS gap FROM c")
def _(t):
    return M.learning_curve(learning_scores(t), "model", "size", "tr", "va").withColumns(r6("train_mean", "train_std", "val_mean", "val_std", "gap"))


@query("a39_final_gap", f"WITH {LC} SELECT model, max(size) AS size, round(arg_max(gap, size), 6) AS gap, round(arg_max(val_mean, size), 6) AS val_mean, CASE WHEN arg_max(gap, size) > 0.10 THEN 'possible overfitting' WHEN arg_max(gap, size) > 0.04 THEN 'moderate gap' ELSE 'fairly tight train/validation fit' END AS gap_class FROM c GROUP BY 1")
def _(t):
    return M.final_gap(M.learning_curve(learning_scores(t), "model", "size", "tr", "va"), "model", "size").withColumns(r6("gap", "val_mean"))


def pairs(t):
    m = t.events.groupBy("event_type", F.col("user_id").alias("seed")).agg(F.avg("value").alias("af"), F.count(F.lit(1)).cast("double").alias("regret"))
    return J.paired(m, "event_type", "click", "error", "seed", ["af", "regret"])


PAIRS = """m AS (SELECT event_type, user_id AS seed, avg(value) AS af, count(*)::DOUBLE AS regret FROM events GROUP BY 1, 2),
p AS (SELECT a.seed, a.af AS af_a, b.af AS af_b, a.regret AS ra, b.regret AS rb FROM m a JOIN m b USING (seed) WHERE a.event_type = 'click' AND b.event_type = 'error'),
d AS (SELECT seed, 'af' AS metric, af_a AS a, af_b AS b, af_a - af_b AS delta FROM p UNION ALL SELECT seed, 'regret', ra, rb, rb - ra FROM p)"""
METRICS = {"af": True, "regret": False}


@query("a40_paired_deltas", f"WITH {PAIRS} SELECT metric, count(*) AS n_valid, round(avg((delta > 0)::INT), 6) AS win_rate, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(quantile_cont(delta, 0.25::DOUBLE), 6) AS q1, round(median(delta), 6) AS median_delta, round(quantile_cont(delta, 0.75::DOUBLE), 6) AS q3 FROM d GROUP BY 1")
def _(t):
    cols = ["win_rate", "mean_a", "mean_b", "q1", "median_delta", "q3"]
    return M.paired_summary(pairs(t), "seed", METRICS).withColumns(r6(*cols)).select("metric", "n_valid", *cols)


# the integral of the density by Simpson's rule
CDF = "(0.5 + Z9 / 1200 * list_sum([(CASE WHEN i % 400 = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-(Z9 * i / 400) * (Z9 * i / 400) / 2) for i in range(401)]) / sqrt(2 * pi()))".replace("Z9", "greatest(-9, least(9, z))")
# exact for up to 50 deltas without ties or zeros: subsets of the ranks counted by their sum, one rank after another
SUBSETS = "list_reduce([[1.0::DOUBLE]] || [[0.0::DOUBLE for i in range(k)] for k in range(1, n::INTEGER + 1)], lambda c, z: [x[1] + x[2] for x in list_zip(c || z, z || c)])"
P_VALUE = f"CASE WHEN n <= 50 AND ties = 0 AND zeros = 0 THEN list_sum({SUBSETS}[t::INTEGER + 1:]) / pow(2, n) ELSE 1 - {CDF} END"
WILCOXON = f"""{PAIRS}, rk AS (SELECT metric, delta, rank() OVER (PARTITION BY metric ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY metric, abs(delta)) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY metric, abs(delta)) AS tie FROM d),
w AS (SELECT metric, count(*)::DOUBLE AS n, sum(CASE WHEN delta > 0 THEN r WHEN delta = 0 THEN r / 2 ELSE 0 END) AS t, sum(tie * tie - 1)::DOUBLE AS ties, count(*) FILTER (delta = 0) AS zeros FROM rk GROUP BY 1),
zz AS (SELECT metric, n, t, ties, zeros, (t - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24) AS z FROM w)"""


@query("a41_signed_rank", f"WITH {WILCOXON} SELECT metric, round({P_VALUE}, 6) AS p_value FROM zz")
def _(t):
    return M.signed_rank(M.paired_deltas(pairs(t), "seed", METRICS), ["metric"]).withColumns(r6("p_value"))


@query("a42_decision", f"""WITH {WILCOXON}, pv AS (SELECT metric, n, {P_VALUE} AS p FROM zz), s AS (SELECT metric, median(delta) AS m, avg((delta > 0)::INT) AS w FROM d GROUP BY 1)
SELECT metric, CASE WHEN n < 3 THEN 'insufficient_data' WHEN n < 10 THEN 'underpowered' WHEN m > 0 AND p < 0.05 AND w >= 0.6 THEN 'A_wins' WHEN m < 0 AND 1 - p < 0.05 AND w <= 0.4 THEN 'B_likely_better' ELSE 'tie' END AS decision FROM pv JOIN s USING (metric)""")
def _(t):
    return M.paired_compare(pairs(t), "seed", METRICS).select("metric", "decision")


IMP = "imp AS (SELECT l_returnflag AS model, l_suppkey AS feature, avg(l_extendedprice) AS importance FROM lineitem GROUP BY 1, 2)"


def importance(t):
    rows = t.lineitem.select(F.col("l_returnflag").alias("model"), F.col("l_suppkey").alias("feature"), "l_extendedprice")
    return M.importance_means(rows, ["model", "feature"], "l_extendedprice")


@query("a43_importance_means", f"WITH {IMP} SELECT model, feature, round(importance, 4) AS importance FROM imp")
def _(t):
    return importance(t).withColumns(r6("importance", digits=4))


@query("a43_top_features", f"WITH {IMP}, top AS (SELECT feature FROM imp GROUP BY 1 ORDER BY max(importance) DESC, feature LIMIT 20) SELECT model, feature, round(importance, 4) AS importance FROM imp WHERE feature IN (SELECT feature FROM top)")
def _(t):
    return M.top_features(importance(t), "feature").withColumns(r6("importance", digits=4))


@query("a43_importance_pivot", f"""WITH {IMP} SELECT feature, {', '.join(f"round(coalesce(avg(importance) FILTER (model = '{m}'), 0), 4) AS model_{m}" for m in 'ANRX')} FROM imp GROUP BY 1""")
def _(t):
    out = M.importance_pivot(importance(t), "feature", "model", list("ANRX"))
    return out.select("feature", *[F.round(m, 4).alias(f"model_{m}") for m in "ANRX"])


@query("a43_importance_by_group", "SELECT p_brand, round(sum(p_retailprice), 4) AS total, round(avg(p_retailprice), 4) AS mean_value, count(*) AS n_features FROM part GROUP BY 1")
def _(t):
    return M.importance_by_group(t.part, "p_brand", "p_retailprice").withColumns(r6("total", "mean_value", digits=4))


@query("a44_dataset_summary", "SELECT count(*) AS n_rows, max(y) AS best_score, arg_min(o_orderkey, (-y, o_orderkey)) AS best_item FROM (SELECT o_orderkey, least(9, floor(o_totalprice / 50000))::DOUBLE AS y FROM orders)")
def _(t):
    y = F.least(F.lit(9.0), F.floor(F.col("o_totalprice") / 50000).cast("double"))
    return M.dataset_summary(t.orders.select("o_orderkey", y.alias("y")), "y", "o_orderkey", "o_orderkey")


@query("a44_iteration_history", "SELECT conv_id, count(*) AS n_rows, sum(count(*)) OVER (ORDER BY conv_id)::BIGINT AS n_data FROM conversations GROUP BY 1")
def _(t):
    from ..functions.scan import running

    per = t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return running(per, [], "conv_id", F.lit(0), {"n_data": ("sum", "n_rows")})


@query("a45_next_id", "SELECT 'GUI-' || (count(*) FILTER (lower(o_orderstatus) = 'f') + 1) AS next_id FROM orders")
def _(t):
    return M.next_id(t.orders, "o_orderstatus", "o_orderkey", mark="f")


@query("a46_group_variance", """WITH g AS (SELECT o_custkey, count(*) AS n, var_samp(o_totalprice / 50000) AS v, avg(o_totalprice / 50000) AS m FROM orders GROUP BY 1 HAVING count(*) >= 2)
SELECT round(avg(v), 6) AS within_var, round(var_samp(m), 6) AS between_var, round(var_samp(m) / (avg(v) + 1e-9), 6) AS ratio, var_samp(m) / (avg(v) + 1e-9) > 2 AS passes FROM g""")
def _(t):
    y = t.orders.select("o_custkey", (F.col("o_totalprice") / 50000).alias("y"))
    return M.group_variance(y, "o_custkey", "y").withColumns(r6("within_var", "between_var", "ratio"))


LONG = """long AS (SELECT 'quantity' AS feature, l_quantity AS value, l_returnflag AS label FROM lineitem UNION ALL SELECT 'linenumber', l_linenumber, l_returnflag FROM lineitem UNION ALL SELECT 'month', month(l_shipdate), l_returnflag FROM lineitem)"""


def long_features(t):
    values = {"quantity": F.col("l_quantity"), "linenumber": F.col("l_linenumber").cast("double"), "month": F.month("l_shipdate").cast("double")}
    rows = F.array(*[F.struct(F.lit(k).alias("feature"), v.alias("value")) for k, v in values.items()])
    return t.lineitem.select(F.col("l_returnflag").alias("label"), F.explode(rows).alias("s")).select("s.*", "label")


MI = f"""{LONG}, c AS (SELECT feature, value, label, count(*)::DOUBLE AS n_xy FROM long GROUP BY 1, 2, 3), s AS (SELECT *, sum(n_xy) OVER (PARTITION BY feature, value) AS n_x, sum(n_xy) OVER (PARTITION BY feature, label) AS n_y, sum(n_xy) OVER (PARTITION BY feature) AS n FROM c),
mi AS (SELECT feature, greatest(sum(n_xy / n * ln(n_xy * n / (n_x * n_y))), 0) AS mi FROM s GROUP BY 1)"""


@query("a47_mutual_information", f"WITH {MI} SELECT feature, round(mi, 8) AS mi FROM mi")
def _(t):
    return X.mutual_information(long_features(t)).withColumns(r6("mi", digits=8))


@query("a48_binned_information", """WITH e AS (SELECT list_sort(quantile_cont(l_extendedprice, [0.1::DOUBLE, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS q FROM lineitem),
b AS (SELECT len(list_filter(q, lambda x: x <= l_extendedprice)) AS value, l_returnflag AS label FROM lineitem, e),
c AS (SELECT value, label, count(*)::DOUBLE AS n_xy FROM b GROUP BY 1, 2), s AS (SELECT *, sum(n_xy) OVER (PARTITION BY value) AS n_x, sum(n_xy) OVER (PARTITION BY label) AS n_y, sum(n_xy) OVER () AS n FROM c)
SELECT 'price' AS feature, round(greatest(sum(n_xy / n * ln(n_xy * n / (n_x * n_y))), 0), 8) AS mi FROM s""")
def _(t):
    return X.binned_information(t.lineitem.select(F.lit("price").alias("feature"), F.col("l_extendedprice").alias("value"), F.col("l_returnflag").alias("label"))).withColumns(r6("mi", digits=8))


@query("a48_neighbour_information", """WITH e AS (SELECT event_id, event_type AS c, value::DOUBLE AS x, count(*) OVER (PARTITION BY event_type) AS n FROM events),
u AS (SELECT *, least(3, n - 1) AS k, [abs(lag(x, 1) OVER w - x), abs(lag(x, 2) OVER w - x), abs(lag(x, 3) OVER w - x), abs(lead(x, 1) OVER w - x), abs(lead(x, 2) OVER w - x), abs(lead(x, 3) OVER w - x)] AS gaps
      FROM e WHERE n > 1 WINDOW w AS (PARTITION BY c ORDER BY x, event_id)),
r AS (SELECT *, list_sort(list_filter(gaps, lambda g: g IS NOT NULL))[k] AS r FROM u),
upto AS (SELECT x AS at, sum(count(*)) OVER (ORDER BY x) AS upto FROM u GROUP BY x),
m AS (SELECT n, k, greatest(1, coalesce(b.upto, 0) - coalesce(a.upto, 0))::BIGINT AS m FROM r ASOF LEFT JOIN upto b ON r.x + r.r > b.at ASOF LEFT JOIN upto a ON r.x - r.r >= a.at),
psi AS (SELECT i, coalesce(sum(1.0::DOUBLE / nullif(i - 1, 0)) OVER (ORDER BY i), 0) AS psi FROM (SELECT row_number() OVER () AS i FROM events))
SELECT 'value' AS feature, round(greatest(0, (SELECT psi FROM psi WHERE i = (SELECT count(*) FROM m)) + avg(pk.psi) - avg(pn.psi) - avg(pm.psi)), 6) AS mi
FROM m JOIN psi pk ON pk.i = m.k JOIN psi pn ON pn.i = m.n JOIN psi pm ON pm.i = m.m""")
def _(t):
    long = t.events.select("event_id", F.lit("value").alias("feature"), "value", F.col("event_type").alias("label"))
    return X.neighbour_information(long, "event_id").withColumns(r6("mi"))


@query("a49_signal_class", f"WITH {MI} SELECT feature, CASE WHEN mi * 1000 >= 0.05 THEN 'strong' WHEN mi * 1000 >= 0.01 THEN 'weak' ELSE 'noise' END AS signal FROM mi")
def _(t):
    return X.mutual_information(long_features(t)).select("feature", X.signal_class(F.col("mi") * 1000).alias("signal"))


@query("a50_survival_report", "SELECT p_name || '_' || p_partkey AS name, p_size > 10 AS in_variance, p_size > 40 AS in_ranking FROM part")
def _(t):
    catalog = t.part.select(F.concat_ws("_", "p_name", "p_partkey").alias("name"), "p_size")
    return X.survival_report(catalog, catalog.filter("p_size > 10"), catalog.filter("p_size > 40")).drop("p_size")


VECS = "v AS (SELECT vec_id, label % 3 = 0 AS zeroed, embedding FROM embeddings)"


def maybe_zero(t):
    v = F.when(F.col("label") % 3 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    return t.embeddings.select("vec_id", v.alias("v"))


@query("a51_zero_vectors", f"WITH {VECS} SELECT count(*) AS n_parsed, count(*) FILTER (zeroed) AS n_zero, round(avg(zeroed::INT), 6) AS zero_share FROM v")
def _(t):
    return X.zero_vectors(maybe_zero(t), "vec_id", "v").withColumns(r6("zero_share"))


@query("a51_zero_examples", f"WITH {VECS} SELECT vec_id FROM v WHERE zeroed ORDER BY 1 LIMIT 10")
def _(t):
    return X.zero_vector_examples(maybe_zero(t), "vec_id", "v")


@query("w7_scaled_rank", """SELECT event_id, round((rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0::DOUBLE - 1) / greatest(count(*) OVER (PARTITION BY event_type) - 1, 1), 6) AS rank01 FROM events""")
def _(t):
    return M.scaled_rank(t.events, ["event_type"], "value", "event_id").select("event_id", F.round("rank01", 6).alias("rank01"))


@query("w8_rank_in_sample", """WITH s AS (SELECT value FROM events WHERE event_type = 'click'), n AS (SELECT count(*) AS n FROM s)
SELECT event_id, value, round(greatest(0, least(1, ((SELECT count(*) FROM s WHERE s.value <= e.value) - 1) / greatest(n - 1, 1)::DOUBLE)), 6) AS rank01 FROM events e, n WHERE event_type <> 'click'""")
def _(t):
    is_click = F.col("event_type") == "click"
    return M.rank_in_sample(t.events.filter(~is_click), t.events.filter(is_click), "value", "event_id").withColumns(r6("rank01"))


@query("w9_consensus", """WITH r AS (SELECT event_id, count(*) OVER () AS n, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY user_id) + (count(*) OVER (PARTITION BY user_id) - 1) / 2.0::DOUBLE AS rb,
row_number() OVER (ORDER BY value, event_id) AS ia, row_number() OVER (ORDER BY user_id, event_id) AS ib FROM events)
SELECT event_id, round(CASE WHEN ia > n - greatest(1, floor(n * 0.1::DOUBLE)) AND ib > n - greatest(1, floor(n * 0.1::DOUBLE)) THEN (ra / n + rb / n) / 2 + 1 ELSE rb / n END, 6) AS consensus FROM r""")
def _(t):
    base = t.events.select("event_id", "value", "user_id")
    return M.consensus(base, "value", "user_id", "event_id").select("event_id", F.round("consensus", 6).alias("consensus"))


@query("w10_elbow", """WITH r AS (SELECT p_retailprice * p_size AS s, p_partkey, row_number() OVER (ORDER BY p_retailprice * p_size DESC, p_partkey) AS rn, max(p_retailprice * p_size) OVER () AS peak, count(*) OVER () AS n FROM part),
d AS (SELECT rn, n, s, peak, (lead(s, 2) OVER (ORDER BY rn) - 2 * lead(s, 1) OVER (ORDER BY rn) + s) / peak AS d2 FROM r), b AS (SELECT max(n) AS n, (SELECT rn FROM d ORDER BY d2 DESC NULLS LAST, rn LIMIT 1) AS at_rank, min(rn - 1) FILTER (s < peak * 0.05::DOUBLE) AS below FROM d)
SELECT greatest(50, least(at_rank, n)) AS elbow, greatest(1, least(below, at_rank, n)) AS cliff FROM b""")
def _(t):
    return X.elbow(t.part.select("p_partkey", (F.col("p_retailprice") * F.col("p_size")).alias("score")), "score", "p_partkey")


@query("w14_bin_statistics", """WITH e AS (SELECT quantile_cont(o_totalprice, [0.0::DOUBLE, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM orders),
b AS (SELECT len(list_filter(q, lambda x: x <= o_totalprice))::INTEGER AS bin, o_totalprice AS x, o_custkey::DOUBLE AS y FROM orders, e)
SELECT bin, count(*) AS n, round(avg(y), 4) AS mean_y, round(stddev_pop(y) / sqrt(count(*)), 4) AS se_y, round(median(x), 4) AS median_x FROM b WHERE bin BETWEEN 1 AND 10 GROUP BY 1 HAVING count(*) >= 3""")
def _(t):
    y = t.orders.select("o_totalprice", F.col("o_custkey").cast("double").alias("y"))
    return M.bin_statistics(y, "o_totalprice", "y").drop("semivariance").withColumns(r6("mean_y", "se_y", "median_x", digits=4))


@query("w15_new_rows", "SELECT conv_id, count(*) AS n_data, (count(*) - coalesce(lag(count(*)) OVER (ORDER BY conv_id), 0)) AS n_new FROM conversations GROUP BY 1")
def _(t):
    from ..functions.scan import lagged, number_rows

    per = t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_data"))
    steps = lagged(number_rows(per, [], "conv_id", F.lit(0)), [], "n_data", "rn", "previous")
    return steps.select("conv_id", "n_data", (F.col("n_data") - F.coalesce("previous", F.lit(0))).alias("n_new"))


@query("m8_pseudo_weights", """WITH tau AS (SELECT quantile_cont(value, 0.85::DOUBLE) AS tau FROM events), p AS (SELECT event_id, value * 0.9 AS mu, 1 + user_id % 10 AS sigma FROM events), ms AS (SELECT median(sigma) AS ms FROM p),
g AS (SELECT event_id, (mu >= tau)::INTEGER AS elite, greatest(mu - tau, 1e-6) AS gain, 0.3::DOUBLE / (1 + sigma / ms) AS trust FROM p, tau, ms)
SELECT event_id, elite, round(trust * CASE WHEN elite = 1 THEN gain / greatest((SELECT avg(gain) FROM g WHERE elite = 1), 1e-6) ELSE 1 END, 6) AS weight FROM g""")
def _(t):
    observed, pool = surrogate_pool(t)
    return M.pseudo_weights(observed, pool).select("event_id", "elite", F.round("weight", 6).alias("weight"))


def surrogate_pool(t):
    observed = M.elite_labels(t.events.select("event_id", "value"), "value")
    pool = t.events.select("event_id", (F.col("value") * 0.9).alias("mu"), (1 + F.pmod("user_id", F.lit(10))).cast("double").alias("sigma"))
    return observed, pool


@query("m8_pseudo_diagnostics", """WITH tau AS (SELECT quantile_cont(value, 0.85::DOUBLE) AS tau FROM events), p AS (SELECT value * 0.9 AS mu, 1 + user_id % 10 AS sigma FROM events)
SELECT count(*) AS n_pseudo, count(*) FILTER (mu >= tau) AS n_pseudo_pos, round(avg((mu >= tau)::INT), 6) AS frac_pseudo_pos, median(sigma) AS sigma_median, quantile_cont(sigma::DOUBLE, 0.9::DOUBLE) AS sigma_p90, round(max(tau), 6) AS tau,
(SELECT count(*) FROM events) AS n_observed, (SELECT count(*) FROM events, tau WHERE value >= tau) AS n_observed_pos FROM p, tau""")
def _(t):
    observed, pool = surrogate_pool(t)
    return M.pseudo_diagnostics(observed, M.pseudo_weights(observed, pool)).withColumns(r6("frac_pseudo_pos", "tau"))
