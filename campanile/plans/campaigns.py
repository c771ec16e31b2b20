"""Campaign metrics bound to `orders`.

Items are orders, the score is a price bin 0-9, the run label joins priority
and a hashed seed, and the first fifth of each run's pool by date is selected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import draw
from ..functions.scan import number_rows
from ..operators import campaigns as C
from .registry import Tables, query

HIT = 7.0
MIN_GROUP = 12

ITEMS = """
draws AS (SELECT *, ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT AS draw FROM orders),
items AS (
  SELECT o_orderpriority AS method, ((draw // 10) % 10)::INTEGER AS seed, o_orderkey AS item_id, o_custkey AS raw_group,
         o_orderdate AS placed, least(9, floor(o_totalprice / 50000))::DOUBLE AS y,
         CASE WHEN draw % 10 < 3 THEN 'init' ELSE 'pool' END AS role
  FROM draws)"""
SCORED = ITEMS + """,
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY method, seed, role ORDER BY placed, item_id) AS pos,
         count(*) OVER (PARTITION BY method, seed, role) AS n_role FROM items),
scored AS (
  SELECT method, seed, item_id, raw_group, y, role,
         CASE WHEN role = 'pool' AND pos <= floor(n_role * 0.2::DOUBLE) THEN pos END AS iteration FROM numbered)"""
COUNTS = """
  count(*) FILTER (role = 'init') AS n_init, count(*) FILTER (role = 'pool') AS n_pool,
  count(*) FILTER (iteration IS NOT NULL) AS n_selected,
  count(*) FILTER (role = 'pool' AND y >= 7) AS n_pool_hits,
  count(*) FILTER (role = 'pool' AND y >= 7 AND iteration IS NOT NULL) AS n_found,
  avg(y) FILTER (role = 'pool') AS mean_pool, avg(y) FILTER (iteration IS NOT NULL) AS mean_selected,
  count(*) FILTER (iteration IS NOT NULL AND y >= 7) AS n_selected_hits,
  max(y) AS best_all, max(y) FILTER (iteration IS NOT NULL) AS best_selected,
  max(y) FILTER (iteration IS NOT NULL OR role = 'init') AS best_seen"""
AF = "CASE WHEN n_selected > 0 AND n_pool_hits > 0 THEN (n_found / n_pool_hits::DOUBLE) / (n_selected / n_pool::DOUBLE) END"
EF = "CASE WHEN n_selected > 0 AND mean_pool > 0 THEN mean_selected / mean_pool END"
SUMMARY = SCORED + f""",
counts AS (SELECT method, seed, {COUNTS} FROM scored GROUP BY ALL),
summary AS (
  SELECT method, seed, {AF} AS AF, {EF} AS EF,
         CASE WHEN n_selected > 0 THEN n_selected_hits / n_selected::DOUBLE ELSE 0 END AS hit_rate,
         CASE WHEN n_pool > 0 THEN n_pool_hits / n_pool::DOUBLE ELSE 0 END AS baseline_hit_rate,
         CASE WHEN n_pool_hits > 0 THEN n_found / n_pool_hits::DOUBLE ELSE 0 END AS hit_discovery_rate,
         coalesce(best_seen, 0) AS best_score_final, best_all - coalesce(best_selected, 0) AS simple_regret_final,
         n_selected AS n_evaluated, n_init, 7.0::DOUBLE AS hit_threshold
  FROM counts)"""
GROUPED = SCORED + f""",
sizes AS (SELECT raw_group, count(*) AS size FROM scored GROUP BY 1),
merged AS (SELECT s.*, CASE WHEN size < 12 THEN 'rare' ELSE s.raw_group::VARCHAR END AS group_id
           FROM scored s JOIN sizes USING (raw_group)),
gcounts AS (SELECT method, seed, group_id, {COUNTS} FROM merged GROUP BY ALL),
gsummary AS (
  SELECT method, seed, group_id, {AF} AS AF, {EF} AS EF,
         CASE WHEN n_selected > 0 THEN n_selected_hits / n_selected::DOUBLE ELSE 0 END AS hit_rate,
         CASE WHEN n_pool > 0 THEN n_pool_hits / n_pool::DOUBLE ELSE 0 END AS baseline_hit,
         CASE WHEN n_pool_hits > 0 THEN n_found / n_pool_hits::DOUBLE ELSE 0 END AS hit_discovery_rate,
         n_pool, n_selected, n_pool_hits FROM gcounts)"""


def r6(*names: str):
    return {n: F.round(n, 6) for n in names}


def items(t: Tables) -> DataFrame:
    d = draw("o_orderkey")
    return t.orders.select(
        F.col("o_orderpriority").alias("method"),
        (F.floor(d / 10) % 10).cast("int").alias("seed"),
        F.col("o_orderkey").alias("item_id"),
        F.col("o_custkey").alias("raw_group"),
        F.col("o_orderdate").alias("placed"),
        F.least(F.lit(9.0), F.floor(F.col("o_totalprice") / 50000).cast("double")).alias("y"),
        F.when(d % 10 < 3, F.lit("init")).otherwise(F.lit("pool")).alias("role"),
    )


def micros(name: str):
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(name).cast("timestamp_ntz"))


def scored(t: Tables, settle: bool = False) -> DataFrame:
    base = items(t).withColumn("placed", micros("placed"))
    numbered = number_rows(base, ["method", "seed", "role"], "placed", "item_id", out="pos", total="n_role", settle=settle)
    chosen = (F.col("role") == "pool") & (F.col("pos") <= F.floor(F.col("n_role") * 0.2))
    return numbered.select("method", "seed", "item_id", "raw_group", "y", "role", F.when(chosen, F.col("pos")).alias("iteration"))


def grouped(t: Tables) -> DataFrame:
    return C.merge_rare_groups(scored(t), "raw_group", MIN_GROUP, population=items(t))


RUN = ["method", "seed"]


@query("a11_rare_group_sizes", "WITH" + GROUPED + " SELECT group_id, count(*) AS n_items FROM merged GROUP BY 1")
def _(t):
    return C.merge_rare_groups(items(t), "raw_group", MIN_GROUP).groupBy("group_id").agg(F.count(F.lit(1)).alias("n_items"))


@query("a11_group_directory", """
WITH sizes AS (SELECT o_custkey::VARCHAR AS label, count(*) AS size, min(o_orderkey) AS first_seen FROM orders GROUP BY 1),
merged AS (SELECT CASE WHEN size >= 12 THEN label END AS label, sum(size)::BIGINT AS size, min(first_seen) AS first_seen, count(*) AS n FROM sizes GROUP BY 1)
SELECT row_number() OVER (ORDER BY first_seen) - 1 AS group_no,
       coalesce(CASE WHEN length(label) > 30 THEN substr(label, 1, 30) || '...' ELSE label END, 'rare (' || n || ' groups)') AS group_name, size
FROM merged""")
def _(t):
    return C.group_directory(t.orders, "o_custkey", MIN_GROUP, "o_orderkey")


@query("a12_hit_base_rate", "WITH" + ITEMS + " SELECT method, round(avg((y >= 7)::INT), 6) AS base_rate, count(*) AS n_items FROM items GROUP BY 1")
def _(t):
    return C.base_rate(items(t), ["method"], HIT).withColumns(r6("base_rate"))


@query("a13_acceleration_factor", "WITH" + SUMMARY + " SELECT method, seed, round(AF, 6) AS AF FROM summary")
def _(t):
    return C.campaign_counts(scored(t), RUN, HIT).select(*RUN, F.round(C.acceleration(), 6).alias("AF"))


@query("a14_enhancement_factor", "WITH" + SUMMARY + " SELECT method, seed, round(EF, 6) AS EF FROM summary")
def _(t):
    return C.campaign_counts(scored(t), RUN, HIT).select(*RUN, F.round(C.mean_ratio_ef(), 6).alias("EF"))


@query("a15_run_summary", "WITH" + SUMMARY + """ SELECT method, seed, round(AF, 6) AS AF, round(EF, 6) AS EF, round(hit_rate, 6) AS hit_rate,
round(baseline_hit_rate, 6) AS baseline_hit_rate, round(hit_discovery_rate, 6) AS hit_discovery_rate, best_score_final, simple_regret_final,
n_evaluated, n_init, hit_threshold FROM summary""")
def _(t):
    return C.run_summary(scored(t), RUN, HIT).withColumns(r6("AF", "EF", "hit_rate", "baseline_hit_rate", "hit_discovery_rate"))


@query("a16_group_summary", "WITH" + GROUPED + """ SELECT method, seed, group_id, round(AF, 6) AS AF, round(EF, 6) AS EF, round(hit_rate, 6) AS hit_rate,
round(baseline_hit, 6) AS baseline_hit, round(hit_discovery_rate, 6) AS hit_discovery_rate, n_pool, n_selected, n_pool_hits FROM gsummary""")
def _(t):
    return C.group_summary(grouped(t), [*RUN, "group_id"], HIT).withColumns(r6("AF", "EF", "hit_rate", "baseline_hit", "hit_discovery_rate"))


def _seed_aggs(metrics):
    return ", ".join(
        f"round(avg({m}), 6) AS {m}_mean, round(stddev_pop({m}), 6) AS {m}_std, count({m}) AS {m}_n" for m in metrics
    )


METRICS = ["AF", "EF", "hit_discovery_rate"]


def rounded():
    return r6(*[f"{m}_{k}" for m in METRICS for k in ("mean", "std")])


@query("a17_leaderboard_over_runs", "WITH" + GROUPED + f""" SELECT method, group_id, {_seed_aggs(METRICS)} FROM gsummary GROUP BY 1, 2""")
def _(t):
    return C.across_seeds(C.group_summary(grouped(t), [*RUN, "group_id"], HIT), ["method", "group_id"], METRICS).withColumns(rounded())


@query("a17_across_seeds", "WITH" + SUMMARY + f""" SELECT method, {_seed_aggs(METRICS)} FROM summary GROUP BY 1 ORDER BY avg(AF) DESC NULLS LAST, method""")
def _(t):
    table = C.across_seeds(C.run_summary(scored(t), RUN, HIT), ["method"], METRICS)
    return C.order_undefined_last(table.withColumns(rounded()), "AF_mean", "method")


@query("a18_macro_total_row", "WITH" + GROUPED + f""", per_seed AS (SELECT method, seed, avg(AF) AS AF, avg(EF) AS EF, avg(hit_discovery_rate) AS hit_discovery_rate FROM gsummary GROUP BY 1, 2)
SELECT method, group_id, {_seed_aggs(METRICS)} FROM gsummary GROUP BY 1, 2
UNION ALL SELECT method, 'total', {_seed_aggs(METRICS)} FROM per_seed GROUP BY 1""")
def _(t):
    groups = C.group_summary(grouped(t), [*RUN, "group_id"], HIT)
    return C.macro_total(groups, ["method"], "seed", "group_id", METRICS).withColumns(rounded())


@query("a19_weighted_over_groups", "WITH" + GROUPED + f""", per_seed AS (SELECT method, seed,
  {", ".join(f"sum({m} * n_pool) / nullif(sum(n_pool) FILTER ({m} IS NOT NULL), 0) AS {m}" for m in METRICS)} FROM gsummary GROUP BY 1, 2)
SELECT method, {_seed_aggs(METRICS)} FROM per_seed GROUP BY 1""")
def _(t):
    groups = C.group_summary(grouped(t), [*RUN, "group_id"], HIT)
    return C.across_seeds(C.weighted_over_groups(groups, RUN, "n_pool", METRICS), ["method"], METRICS).withColumns(rounded())


SEEDS = [str(i) for i in range(10)]


@query("a20_metric_pivot", "WITH" + GROUPED + """ SELECT method || '|' || group_id AS method, """ + ", ".join(
    f"""round(CASE WHEN count(*) FILTER (seed = {s} AND AF IS NULL) = 0 THEN avg(AF) FILTER (seed = {s}) END, 6) AS s{s}""" for s in SEEDS
) + """ FROM gsummary GROUP BY 1""")
def _(t):
    groups = C.group_summary(grouped(t), [*RUN, "group_id"], HIT)
    named = groups.select(F.concat_ws("|", "method", "group_id").alias("method"), F.concat(F.lit("s"), F.col("seed").cast("string")).alias("surrogate"), "AF")
    domain = [f"s{s}" for s in SEEDS]
    return C.metric_pivot(named, "method", "surrogate", domain, "AF").withColumns(r6(*domain))


COLD_METRICS = ["AF", "EF", "hit_rate"]


@query("a21_cold_start_curve", "WITH" + SUMMARY + """, c AS (SELECT seed / 10.0::DOUBLE AS frac, AF, EF, hit_rate, baseline_hit_rate FROM summary),
f AS (SELECT frac FROM c GROUP BY 1 HAVING avg(hit_rate) > 1.05::DOUBLE * avg(baseline_hit_rate))
SELECT frac, """ + ", ".join(
    f"round(CASE WHEN count({m}) = count(*) THEN avg({m}) END, 6) AS {m}_mean, round(stddev_pop({m}), 6) AS {m}_std, count({m}) AS {m}_n" for m in COLD_METRICS
) + """, (SELECT min(frac) FROM f) AS first_fraction FROM c GROUP BY 1""")
def _(t):
    summary = C.run_summary(scored(t), RUN, HIT).withColumn("frac", F.col("seed") / 10.0)
    out = C.cold_start(summary, "frac", COLD_METRICS, "hit_rate", "baseline_hit_rate", factor=1.05)
    return out.withColumns(r6(*[f"{m}_{k}" for m in COLD_METRICS for k in ("mean", "std")]))


@query("a22_best_method", "WITH" + SUMMARY + " SELECT method, round(avg(AF), 6) AS mean_value FROM summary GROUP BY 1 HAVING avg(AF) IS NOT NULL ORDER BY avg(AF) DESC, method LIMIT 1")
def _(t):
    return C.best_method(C.run_summary(scored(t), RUN, HIT), "method", "AF").withColumns(r6("mean_value"))


CURVES = SCORED + """,
tot AS (SELECT method, seed, max(y) AS best_all, max(y) FILTER (role = 'init') AS best_init, count(*) FILTER (role = 'pool' AND y >= 7) AS n_pool_hits FROM scored GROUP BY 1, 2),
sel AS (SELECT s.*, best_all, best_init, n_pool_hits FROM scored s JOIN tot USING (method, seed) WHERE iteration IS NOT NULL),
curves AS (SELECT method, seed, iteration, item_id, y,
  greatest(best_init, max(y) OVER w) AS best_so_far, best_all - max(y) OVER w AS regret,
  CASE WHEN n_pool_hits > 0 THEN sum((y >= 7)::INT) OVER w / n_pool_hits::DOUBLE ELSE 0 END AS discovered,
  avg(y) OVER w AS cumulative_mean
  FROM sel WINDOW w AS (PARTITION BY method, seed ORDER BY iteration ROWS UNBOUNDED PRECEDING))"""


def curve_table(t):
    return C.curves(scored(t, settle=True), RUN, HIT)


@query("w1_running_best", "WITH" + CURVES + " SELECT method, seed, iteration, best_so_far FROM curves")
def _(t):
    return curve_table(t).select(*RUN, "iteration", "best_so_far")


@query("w2_simple_regret", "WITH" + CURVES + " SELECT method, seed, iteration, regret FROM curves")
def _(t):
    return curve_table(t).select(*RUN, "iteration", "regret")


@query("w3_hit_discovery", "WITH" + CURVES + " SELECT method, seed, iteration, round(discovered, 6) AS discovered FROM curves")
def _(t):
    return curve_table(t).select(*RUN, "iteration", F.round("discovered", 6).alias("discovered"))


@query("w4_cumulative_mean", "WITH" + CURVES + " SELECT method, seed, iteration, round(cumulative_mean, 6) AS cumulative_mean FROM curves")
def _(t):
    return curve_table(t).select(*RUN, "iteration", F.round("cumulative_mean", 6).alias("cumulative_mean"))


@query("w5_rolling_mean", "WITH" + SCORED + """, r AS (SELECT method, seed, iteration, avg(y) OVER w AS rolling_mean, count(*) OVER w AS n FROM scored WHERE iteration IS NOT NULL
WINDOW w AS (PARTITION BY method, seed ORDER BY iteration ROWS 9 PRECEDING)) SELECT method, seed, iteration, round(rolling_mean, 6) AS rolling_mean FROM r WHERE n = 10""")
def _(t):
    history = scored(t).filter(F.col("iteration").isNotNull()).select(*RUN, "iteration", "y")
    return C.rolling_mean(history, RUN, "y").select(*RUN, "iteration", F.round("rolling_mean", 6).alias("rolling_mean"))


@query("w6_seed_band", "WITH" + CURVES + """, len AS (SELECT method, min(n) AS shortest FROM (SELECT method, seed, max(iteration) AS n FROM curves GROUP BY 1, 2) GROUP BY 1)
SELECT method, iteration, round(avg(best_so_far), 6) AS mean_value, round(stddev_pop(best_so_far), 6) AS std_value, count(*) AS n_seeds
FROM curves JOIN len USING (method) WHERE iteration <= shortest GROUP BY 1, 2""")
def _(t):
    return C.seed_band(curve_table(t), "method", "seed", "best_so_far").withColumns(r6("mean_value", "std_value"))


@query("w16_group_share", "WITH" + GROUPED + """, g AS (SELECT method, seed, count(DISTINCT group_id) AS n_groups FROM merged GROUP BY 1, 2)
SELECT method, seed, group_id, iteration, count(*) OVER (PARTITION BY method, seed, group_id ORDER BY iteration) AS group_count, round(iteration / n_groups::DOUBLE, 6) AS expected
FROM merged JOIN g USING (method, seed) WHERE iteration IS NOT NULL""")
def _(t):
    all_items = grouped(t)
    groups = all_items.groupBy(*RUN).agg(F.countDistinct("group_id").alias("n_groups"))
    shares = C.group_share(all_items.filter(F.col("iteration").isNotNull()), RUN, "group_id", groups)
    return shares.select(*RUN, "group_id", "iteration", "group_count", F.round("expected", 6).alias("expected"))
