"""Neighbour and pair diagnostics bound to `embeddings`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import neighbours as B
from .metrics import r6
from .registry import query

PAIRS = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
pairs AS (SELECT a.vec_id AS i, b.vec_id AS j, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d, abs(a.label - b.label)::DOUBLE AS dy, a.label AS la, b.label AS lb FROM e a JOIN e b ON a.vec_id {op} b.vec_id)"""
KNN = PAIRS.replace("{op}", "<>") + ", knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM pairs) WHERE rank <= 5)"


@query("j14_nearest_neighbours", f"WITH {KNN} SELECT i AS id, j AS neighbour, round(d, 6) AS distance, rank::INTEGER AS rank FROM knn")
def _(t):
    return B.nearest_neighbours(t.embeddings, "vec_id", "embedding", 5).withColumns(r6("distance"))


ELITE = ", tau AS (SELECT quantile_cont(label, 0.75::DOUBLE) AS tau FROM embeddings)"


def elite(t):
    return M.elite_labels(t.embeddings.select("vec_id", F.col("label").cast("double").alias("y")), "y", 0.25)


@query("c14_label_agreement", f"WITH {KNN}{ELITE} SELECT i AS id, round(avg(((la >= tau) = (lb >= tau))::INT), 6) AS agreement FROM knn, tau GROUP BY 1")
def _(t):
    near = B.nearest_neighbours(t.embeddings, "vec_id", "embedding", 5)
    return B.label_agreement(near, elite(t), "vec_id", "elite").withColumns(r6("agreement"))


@query("c14_agreement_verdict", f"WITH {KNN}{ELITE}, a AS (SELECT i, avg(((la >= tau) = (lb >= tau))::INT) AS g FROM knn, tau GROUP BY 1) SELECT round(avg(g), 6) AS mean_agreement, avg(g) >= 0.7 AS passes FROM a")
def _(t):
    near = B.nearest_neighbours(t.embeddings, "vec_id", "embedding", 5)
    return B.agreement_verdict(B.label_agreement(near, elite(t), "vec_id", "elite")).withColumns(r6("mean_agreement"))


SAMPLE = """e AS (SELECT row_number() OVER (ORDER BY vec_id) AS rn, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), n AS (SELECT count(*) AS n FROM e),
dr AS (SELECT ('0x' || substr(md5(s || '|42|a'), 1, 15))::BIGINT % n + 1 AS a, ('0x' || substr(md5(s || '|42|b'), 1, 15))::BIGINT % n + 1 AS b FROM range(0, 8000) r(s), n),
p AS (SELECT * FROM (SELECT DISTINCT least(a, b) AS i, greatest(a, b) AS j FROM dr WHERE a <> b) ORDER BY ('0x' || substr(md5(i || '|' || j || '|42'), 1, 15))::BIGINT, i, j LIMIT 2000),
sp AS (SELECT x.vec_id AS id_a, y.vec_id AS id_b, list_distance(x.v, y.v) AS distance, abs(x.label - y.label)::DOUBLE AS dy FROM p JOIN e x ON x.rn = i JOIN e y ON y.rn = j)"""


def sample(t):
    return B.sampled_pairs(t.embeddings, "vec_id", "embedding", "label")


@query("j15_sampled_pairs", f"WITH {SAMPLE} SELECT id_a, id_b, round(distance, 6) AS distance, dy FROM sp")
def _(t):
    return sample(t).withColumns(r6("distance"))


@query("c15_distance_outcome", f"""WITH {SAMPLE}, r AS (SELECT rank() OVER (ORDER BY distance) + (count(*) OVER (PARTITION BY distance) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY dy) + (count(*) OVER (PARTITION BY dy) - 1) / 2.0::DOUBLE AS b FROM sp)
SELECT round(corr(a, b), 5) AS spearman, corr(a, b) > 0.15 AS passes FROM r""")
def _(t):
    pairs = sample(t).withColumn("id", F.xxhash64("id_a", "id_b"))
    rho = M.spearman(pairs.withColumn("g", F.lit(0)), ["g"], "distance", "dy", "id")
    return rho.select(F.round("spearman", 5).alias("spearman"), (F.col("spearman") > 0.15).alias("passes"))


@query("c15_distance_bins", f"""WITH {SAMPLE}, q AS (SELECT quantile_cont(distance, [0.0::DOUBLE, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM sp),
b AS (SELECT len(list_filter(q, lambda x: x <= distance))::INTEGER AS bin, distance, dy FROM sp, q) SELECT bin, count(*) AS n, round(avg(dy), 5) AS mean_y, round(stddev_pop(dy) / sqrt(count(*)), 5) AS se_y, round(median(distance), 5) AS median_x FROM b WHERE bin BETWEEN 1 AND 10 GROUP BY 1""")
def _(t):
    return M.bin_statistics(sample(t), "distance", "dy").drop("semivariance").withColumns(r6("mean_y", "se_y", "median_x", digits=5))


VARIO = PAIRS.replace("{op}", "<") + """, q AS (SELECT quantile_cont(d, [0.0::DOUBLE, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM pairs),
b AS (SELECT len(list_filter(q, lambda x: x <= d))::INTEGER AS bin, d, dy FROM pairs, q), v AS (SELECT bin, count(*) AS n, median(d) AS median_distance, avg(dy * dy) / 2 AS semivariance FROM b WHERE bin BETWEEN 1 AND 10 GROUP BY 1 HAVING count(*) >= 3)"""


@query("c16_semivariogram", f"WITH {VARIO} SELECT bin, n, round(median_distance, 5) AS median_distance, round(semivariance, 5) AS semivariance FROM v")
def _(t):
    out = B.semivariogram(t.embeddings, "vec_id", "embedding", "label")
    return out.withColumns(r6("median_distance", "semivariance", digits=5))


@query("c16_sill_verdict", f"""WITH {VARIO}, r AS (SELECT *, row_number() OVER (ORDER BY bin) AS rn, lag(semivariance) OVER (ORDER BY bin) AS prev, count(*) OVER () // 2 AS mid FROM v)
SELECT round(avg((semivariance > prev)::INT) FILTER (rn <= mid + 1 AND prev IS NOT NULL), 5) AS rising, round(stddev_pop(semivariance) FILTER (rn > mid) / (avg(semivariance) FILTER (rn > mid) + 1e-9), 5) AS flat,
avg((semivariance > prev)::INT) FILTER (rn <= mid + 1 AND prev IS NOT NULL) >= 0.5 AND stddev_pop(semivariance) FILTER (rn > mid) / (avg(semivariance) FILTER (rn > mid) + 1e-9) < 0.25 AS has_sill FROM r""")
def _(t):
    return B.sill_verdict(B.semivariogram(t.embeddings, "vec_id", "embedding", "label", medians=False)).withColumns(r6("rising", "flat", digits=5))
