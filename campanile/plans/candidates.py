"""Groups, samples, candidate scores, batches and trust regions bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import draw, uniform
from ..functions import numeric as N
from ..operators import campaigns as C
from ..operators import candidates as K
from ..operators import features as X
from ..operators import groups as G
from ..operators import joins as J
from ..session import cut
from .campaigns import GROUPED, SCORED, grouped, micros, scored
from .metrics import CDF, r6
from .registry import query

Y = "least(9, floor(o_totalprice / 50000))::DOUBLE"


def y():
    return F.least(F.lit(9.0), F.floor(F.col("o_totalprice") / 50000).cast("double"))


def md5_draw(*parts):
    text = " || '|' || ".join(parts)
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


@query("g2_stratified_folds", f"""SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {md5_draw("o_orderkey::VARCHAR", "'7'")}, o_orderkey) - 1) % 3)::INTEGER AS fold FROM orders""")
def _(t):
    return G.stratified_folds(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", 3, seed=7).select("o_orderkey", "fold")


@query("g1_group_folds")
def _(t):
    rows = t.orders.select("o_orderkey", "o_custkey", F.when(F.col("o_totalprice") <= 150000, 0).when(F.col("o_totalprice") <= 300000, 1).otherwise(2).alias("cls"))
    folds = G.group_folds(rows, "o_custkey", "cls", 3)
    return folds.groupBy("fold", "cls").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("n_groups"))


@query("g1_fold_invariants", """WITH c AS (SELECT CASE WHEN o_totalprice <= 150000 THEN 0 WHEN o_totalprice <= 300000 THEN 1 ELSE 2 END::INTEGER AS cls, count(*) AS n FROM orders GROUP BY 1)
SELECT cls, n, 0::BIGINT AS split_groups, 3::BIGINT AS n_folds, true AS even FROM c""")
def _(t):
    """Whole groups in one fold each, all rows dealt, and no fold's share of a class off an even one by more than a tenth of the class and two of the largest groups."""
    rows = t.orders.select("o_orderkey", "o_custkey", F.when(F.col("o_totalprice") <= 150000, 0).when(F.col("o_totalprice") <= 300000, 1).otherwise(2).alias("cls"))
    folds = G.group_folds(rows, "o_custkey", "cls", 3)
    per_group = folds.groupBy("o_custkey").agg(F.countDistinct("fold").alias("k"), F.count(F.lit(1)).alias("n"))
    over = per_group.agg(F.count_if(F.col("k") > 1).alias("split_groups"), F.max("n").alias("largest"))
    cells = folds.groupBy("cls", "fold").agg(F.count(F.lit(1)).alias("n"))
    told = cells.groupBy("cls").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_folds"), F.max("n").alias("most"), F.min("n").alias("fewest"))
    even = F.greatest(F.col("most") - F.col("n") / 3, F.col("n") / 3 - F.col("fewest")) <= 0.1 * F.col("n") + 2 * F.col("largest")
    return told.crossJoin(over).select("cls", "n", "split_groups", "n_folds", even.alias("even"))


@query("g1_repeated_group_folds")
def _(t):
    rows = t.orders.select("o_orderkey", "o_custkey", F.when(F.col("o_totalprice") <= 150000, 0).when(F.col("o_totalprice") <= 300000, 1).otherwise(2).alias("cls"))
    folds = G.repeated_folds(rows, lambda df, seed: G.group_folds(df, "o_custkey", "cls", 3, seed), 2)
    return folds.groupBy("repeat", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("g3_init_pool_split", f"""WITH r AS (SELECT o_orderkey, o_custkey::VARCHAR AS g, greatest(0, least(9, trunc({Y})))::INTEGER AS bin, {md5_draw("o_orderkey::VARCHAR", "'0'")} AS d FROM orders),
b AS (SELECT g, bin, count(*) AS n FROM r GROUP BY 1, 2), p AS (SELECT g, sum(n) AS size, min(n) AS least_n, count(*) AS nb FROM b GROUP BY 1),
q AS (SELECT r.*, size, least_n >= 2 AND floor(size * 0.3::DOUBLE) >= nb AND size - floor(size * 0.3::DOUBLE) >= nb AS strat FROM r JOIN p USING (g)),
d AS (SELECT *, CASE WHEN strat THEN bin ELSE -1 END AS cell FROM q), z AS (SELECT *, row_number() OVER (PARTITION BY g, cell ORDER BY d, o_orderkey) AS rn, count(*) OVER (PARTITION BY g, cell) AS n FROM d)
SELECT o_orderkey, CASE WHEN size < 2 OR rn <= CASE WHEN strat THEN round_even(n * 0.3::DOUBLE, 0) ELSE greatest(1, floor(n * 0.3::DOUBLE)) END THEN 'init' ELSE 'pool' END AS role FROM z""")
def _(t):
    rows = t.orders.select("o_orderkey", "o_custkey", y().alias("y"))
    return G.init_pool_split(rows, "o_custkey", "y", "o_orderkey").select("o_orderkey", "role")


@query("g4_held_out_groups", "SELECT o_custkey, count(*) AS n_pool, (SELECT count(*) FROM orders) - count(*) AS n_init, greatest(1, floor(count(*) * 0.30::DOUBLE))::BIGINT AS budget FROM orders GROUP BY 1 HAVING count(*) >= 12")
def _(t):
    return G.held_out_groups(t.orders, "o_custkey", least=12)


@query("g4_leave_group_out", "SELECT held, (CASE WHEN o_orderpriority = held THEN 'pool' ELSE 'init' END) AS role, count(*) AS n FROM orders, (SELECT DISTINCT o_orderpriority AS held FROM orders) GROUP BY 1, 2")
def _(t):
    held = G.held_out_groups(t.orders, "o_orderpriority")
    # equal rows fold first: a join on a few groups would send all orders to as many tasks
    rows = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_rows"))
    return G.split_sizes(G.leave_group_out(rows, "o_orderpriority", held), "o_orderpriority", "n_rows")


BOX = {"equivalents": (1.0, 100.0), "temperature": (300.0, 400.0), "phi": (0.0, 1.0)}


def lhs_sql(p, low, high, log=False):
    u = f"(row_number() OVER (ORDER BY {md5_draw('p_partkey::VARCHAR', repr(p), repr('0'))}, p_partkey) - 1 + {md5_draw('p_partkey::VARCHAR', repr(p), repr('0'), repr('jitter'))} / 4294967296.0::DOUBLE) / (SELECT count(*) FROM part)"
    return f"round(exp({u} * (ln({high}::DOUBLE) - ln({low}::DOUBLE)) + ln({low}::DOUBLE)), 6) AS {p}" if log else f"round({u} * ({high - low}::DOUBLE) + {low}::DOUBLE, 6) AS {p}"


@query("g7_latin_hypercube", f"SELECT p_partkey, {lhs_sql('equivalents', 1.0, 100.0, True)}, {lhs_sql('temperature', 320.0, 360.0)}, {lhs_sql('phi', 0.0, 1.0)} FROM part")
def _(t):
    out = G.latin_hypercube(t.part, "p_partkey", BOX, ["equivalents"], override={"temperature": (320.0, 360.0)})
    return out.withColumns(r6("equivalents", "temperature", "phi"))


@query("g9_balanced_resample", f"""WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1), w AS (SELECT o_orderkey, o_orderstatus, floor((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n)::DOUBLE + {md5_draw("o_orderkey::VARCHAR", "'3'")} / 4294967296.0::DOUBLE)::BIGINT AS copies FROM orders JOIN c USING (o_orderstatus))
SELECT o_orderkey, o_orderstatus, unnest(range(1, copies + 1))::INTEGER AS copy FROM w""")
def _(t):
    return G.balanced_resample(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", seed=3)


# a row counts as often as bounds of the Poisson distribution lie at or below its draw
@query("g10_bootstrap_weights", f"""WITH b AS (SELECT [list_sum([1 / exp(1.0::DOUBLE) / factorial(j::INTEGER)::DOUBLE for j in range(k + 1)]) for k in range(18)] AS bounds)
SELECT o_orderkey, {', '.join(f"len([x for x in bounds if x <= {md5_draw('o_orderkey::VARCHAR', "'0'", f"'{m}'")} / 4294967296.0::DOUBLE])::DOUBLE AS boot_{m}" for m in range(3))} FROM orders, b""")
def _(t):
    return G.bootstrap_weights(t.orders.select("o_orderkey"), "o_orderkey", 3)


@query("c1_candidate_features", """WITH b AS (SELECT min(l_quantity) AS q0, max(l_quantity) AS q1, min(l_tax) AS t0, max(l_tax) AS t1 FROM lineitem), k AS (SELECT p_partkey, r_name, greatest(0, least(1, (p_size - q0) / (q1 - q0))) AS q, greatest(0, least(1, (0.04::DOUBLE - t0) / (t1 - t0))) AS x FROM part, region, b)
SELECT p_partkey, r_name, round(q, 6) AS l_quantity_norm, round(x, 6) AS l_tax_norm, round(q * x, 6) AS t_x_ratio, (q > 0.85)::INT::DOUBLE AS high_t FROM k""")
def _(t):
    ranges = X.Ranges.fit(t.lineitem, ["l_quantity", "l_tax"])
    pairs = J.product(t.part.select("p_partkey", F.col("p_size").cast("double").alias("l_quantity")), t.region.select("r_name"))
    out = K.candidate_features(pairs, {"l_tax": 0.04}, ranges, "l_quantity", "l_tax", "l_tax")
    return out.select("p_partkey", "r_name", *[F.round(c, 6).alias(c) for c in ("l_quantity_norm", "l_tax_norm", "t_x_ratio")], "high_t")


@query("c2_diversity_penalty", "WITH" + GROUPED + """, g AS (SELECT method, seed, count(DISTINCT group_id) AS n_groups FROM merged GROUP BY 1, 2),
s AS (SELECT method, seed, item_id, y, count(*) OVER (PARTITION BY method, seed, group_id ORDER BY iteration) AS n, iteration / n_groups::DOUBLE AS e FROM merged JOIN g USING (method, seed) WHERE iteration IS NOT NULL)
SELECT method, seed, item_id, round(y / (1 + 0.5::DOUBLE * greatest(0, n - e) / (e + 1e-9)), 6) AS score FROM s""")
def _(t):
    items = grouped(t)
    groups = items.groupBy("method", "seed").agg(F.countDistinct("group_id").alias("n_groups"))
    shares = C.group_share(items.filter(F.col("iteration").isNotNull()), ["method", "seed"], "group_id", groups)
    return shares.select("method", "seed", "item_id", F.round(K.diversity_penalty("y", "group_count", "expected"), 6).alias("score"))


def batch_sql(size):
    base = "WITH b AS (SELECT min(p_retailprice) AS s0, max(p_retailprice) AS s1, min(p_size) AS x0, max(p_size) AS x1 FROM part), c AS (SELECT p_partkey, p_brand, (p_retailprice - s0) / (s1 - s0 + 1e-9) AS q, (p_size - x0) / (x1 - x0)::DOUBLE AS x, (p_partkey % 10) / 9.0::DOUBLE AS z FROM part, b)"
    for i in range(1, size + 1):
        if i == 1:
            worth, near = "q", "NULL::DOUBLE"
        else:
            worth = "0.7::DOUBLE * q + 0.3::DOUBLE * near"
        prev = f"n{i - 1}" if i > 1 else "c"
        base += f", p{i} AS (SELECT *, {worth} AS combined FROM {prev} {'WHERE p_partkey NOT IN (' + ' UNION ALL '.join(f'SELECT p_partkey FROM p{j}' for j in range(1, i)) + ')' if i > 1 else ''} ORDER BY combined DESC, p_partkey LIMIT 1)"
        gap = f"0.5::DOUBLE * sqrt((c.x - p{i}.x) * (c.x - p{i}.x) + (c.z - p{i}.z) * (c.z - p{i}.z)) / sqrt(2.0::DOUBLE) + 0.5::DOUBLE * (c.p_brand <> p{i}.p_brand)::INT"
        near = gap if i == 1 else f"least(c.near, {gap})"
        base += f", n{i} AS (SELECT c.p_partkey, c.p_brand, c.q, c.x, c.z, {near} AS near FROM {prev} c, p{i})"
    return base + " " + " UNION ALL ".join(f"SELECT {i}::INTEGER AS batch_rank, p_partkey, round(combined, 6) AS combined FROM p{i}" for i in range(1, size + 1))


@query("c3_diverse_batch", batch_sql(5))
def _(t):
    rows = t.part.select("p_partkey", "p_brand", "p_retailprice", "p_size", (F.col("p_partkey") % 10).alias("z"))
    return K.diverse_batch(rows, "p_partkey", "p_retailprice", ["p_size", "z"], "p_brand", 5).withColumns(r6("combined"))


@query("c5_batch_strategy", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'constant_liar' WHEN p_size % 3 = 1 THEN p_type ELSE NULL END AS requested,
CASE WHEN p_size % 3 = 0 THEN 'constant_liar' ELSE 'kriging_believer' END AS for_ei, 'diverse_greedy' AS for_lfbo, CASE WHEN p_size % 3 = 0 THEN 'constant_liar' WHEN p_size % 3 = 1 THEN p_type ELSE 'diverse_greedy' END AS for_other FROM part""")
def _(t):
    asked = F.when(F.col("p_size") % 3 == 0, "constant_liar").when(F.col("p_size") % 3 == 1, F.col("p_type"))
    rows = t.part.select("p_partkey", asked.alias("requested"))
    return rows.withColumns({f"for_{n}": K.batch_strategies(F.lit(s), "requested") for n, s in (("ei", "ei"), ("lfbo", "lfbo"), ("other", "unheard of"))})


@query("m11_expected_improvement", f"""WITH x AS (SELECT event_id, value AS mu, (user_id % 10)::DOUBLE AS sigma FROM events), g AS (SELECT *, mu - 30 - 0.01::DOUBLE AS g, CASE WHEN sigma > 1e-10 THEN (mu - 30 - 0.01::DOUBLE) / sigma END AS z FROM x)
, r AS (SELECT event_id, round(CASE WHEN sigma > 1e-10 THEN g * ({CDF}) + sigma * exp(-z * z / 2) / sqrt(2 * pi()) ELSE greatest(g, 0) END, 6) AS ei FROM g)
SELECT event_id, CASE WHEN ei = 0 THEN 0 ELSE ei END AS ei FROM r""")
def _(t):
    rows = t.events.select("event_id", F.col("value").alias("mu"), F.pmod("user_id", F.lit(10)).cast("double").alias("sigma"))
    ei = K.expected_improvement("mu", F.nullif("sigma", F.lit(0.0)), 30.0)
    flat = K.expected_improvement("mu", F.lit(0.0) + F.when(F.col("sigma") == 0, F.lit(1e-12)), 30.0)
    rounded = rows.select("event_id", F.round(F.when(F.col("sigma") > 0, ei).otherwise(flat), 6).alias("ei"))
    return rounded.withColumn("ei", F.when(F.col("ei") == 0, F.lit(0.0)).otherwise(F.col("ei")))


@query("m14_fallback_chain", """WITH s AS (SELECT 0.00005::DOUBLE * o_orderkey / (SELECT max(o_orderkey) FROM orders) AS ssl, 0.5::DOUBLE AS plain, o_totalprice AS ei FROM orders)
SELECT 0 AS rung, 'ssl' AS name, round(max(ssl), 8) AS maximum, round(max(ssl) - min(ssl), 8) AS spread, false AS chosen FROM s UNION ALL SELECT 1, 'plain', max(plain), max(plain) - min(plain), false FROM s UNION ALL SELECT 2, 'ei', round(max(ei), 8), round(max(ei) - min(ei), 8), true FROM s""")
def _(t):
    top = t.orders.agg(F.max("o_orderkey")).scalar()
    rows = t.orders.withColumn("top", top).select((0.00005 * F.col("o_orderkey") / F.col("top")).alias("ssl"), F.lit(0.5).alias("plain"), F.col("o_totalprice").alias("ei"))
    return K.fallback_chain(rows, ["ssl", "plain", "ei"]).withColumns(r6("maximum", "spread", digits=8))


@query("t9_epsilon_greedy", f"""WITH x AS (SELECT o_custkey, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS best, arg_min(o_orderkey, ({md5_draw("o_orderkey::VARCHAR", "'5'")}, o_orderkey)) AS lucky FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN {md5_draw("o_custkey::VARCHAR", "'5'", "'explore'")} / 4294967296.0::DOUBLE < 0.1 THEN lucky ELSE best END AS o_orderkey, {md5_draw("o_custkey::VARCHAR", "'5'", "'explore'")} / 4294967296.0::DOUBLE < 0.1 AS explored FROM x""")
def _(t):
    return K.epsilon_greedy(t.orders, ["o_custkey"], "o_totalprice", "o_orderkey", 0.1, seed=5)


def campaign_steps(t):
    return t.orders.select("o_custkey", "o_orderkey", y().alias("y"), (micros("o_orderdate") / 86_400_000_000 * 10_000_000 + F.col("o_orderkey")).alias("at"))


@query("c7_trust_region", f"""WITH h AS (SELECT o_custkey, o_orderkey, {Y} AS y, row_number() OVER w AS rn, max({Y}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
f AS (SELECT o_custkey, max(y) AS best, count(*) AS n, list({{'l': 0.8::DOUBLE, 's': 0::INTEGER, 'f': 0::INTEGER, 'u': CASE WHEN before IS NULL OR y > before + 1e-6 THEN 1 ELSE 0 END::INTEGER}} ORDER BY rn) AS ups FROM h GROUP BY 1),
r AS (SELECT o_custkey, best, n, list_reduce(list_prepend({{'l': 0.8::DOUBLE, 's': 0::INTEGER, 'f': 0::INTEGER, 'u': 0::INTEGER}}, ups), lambda a, x: {{
 'l': CASE WHEN x.u = 1 AND a.s + 1 >= 3 THEN least(a.l * 2, 1.6::DOUBLE) WHEN x.u = 0 AND a.f + 1 >= 3 THEN CASE WHEN a.l / 2 < 0.1::DOUBLE THEN 0.8::DOUBLE ELSE a.l / 2 END ELSE a.l END,
 's': CASE WHEN x.u = 1 THEN CASE WHEN a.s + 1 >= 3 THEN 0 ELSE a.s + 1 END ELSE 0 END::INTEGER, 'f': CASE WHEN x.u = 0 THEN CASE WHEN a.f + 1 >= 3 THEN 0 ELSE a.f + 1 END ELSE 0 END::INTEGER, 'u': 0::INTEGER}}) AS e FROM f)
SELECT o_custkey, e.l AS length, e.s AS successes, e.f AS failures, best, n AS n_updates FROM r""")
def _(t):
    return K.trust_region(campaign_steps(t), "o_custkey", "at", "y")


PARAMS = "p AS (SELECT o_custkey, 'price' AS param, min(o_totalprice) AS low, max(o_totalprice) AS high, avg(o_totalprice) AS center, stddev_pop(o_totalprice) AS spread FROM orders GROUP BY 1)"


def params(t):
    v = F.col("o_totalprice")
    return t.orders.groupBy("o_custkey").agg(F.lit("price").alias("param"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("center"), F.stddev_pop(v).alias("spread"))


@query("c8_region_bounds", f"""WITH {PARAMS}, s AS (SELECT *, CASE WHEN high > low THEN greatest(0.5, least(2.0, spread / greatest((high - low) / 4, 1e-9))) ELSE 1 END AS scale FROM p), b AS (SELECT *, 0.4::DOUBLE * scale * (high - low) / 2 AS half FROM s),
k AS (SELECT *, greatest(low, least(high, center - half)) AS a, greatest(low, least(high, center + half)) AS z FROM b) SELECT o_custkey, round(scale, 6) AS scale, round(CASE WHEN a < z THEN a ELSE low END, 4) AS region_low, round(CASE WHEN a < z THEN z ELSE high END, 4) AS region_high FROM k""")
def _(t):
    scaled = params(t).withColumn("scale", K.param_scale())
    out = K.region_bounds(scaled, F.lit(0.4))
    return out.select("o_custkey", F.round("scale", 6).alias("scale"), F.round("region_low", 4).alias("region_low"), F.round("region_high", 4).alias("region_high"))


@query("c8_region_start", f"WITH {PARAMS} SELECT o_custkey, round(greatest(0.3, least(0.8, coalesce(avg(CASE WHEN high > low THEN least(1, 2 * spread / (high - low)) END), 0.8))), 6) AS length FROM p GROUP BY 1")
def _(t):
    return K.region_start(params(t), ["o_custkey"]).withColumns(r6("length"))


@query("c9_recentre", "SELECT arg_min(p_partkey, (CASE WHEN p_name = 'red widget' AND p_type = 'PROMO' AND p_size >= 5 THEN 0 WHEN p_type = 'PROMO' THEN 1 ELSE 2 END, -p_size, p_partkey)) AS p_partkey, 'exact' AS source, max(p_size) FILTER (p_name = 'red widget' AND p_type = 'PROMO') AS best FROM part")
def _(t):
    return K.recentre(t.part, F.col("p_name") == "red widget", F.col("p_type") == "PROMO", "p_size", "p_partkey")


@query("c10_score_scope", "SELECT count(*) AS n, max(p_size) AS best, 'neighborhood' AS scope FROM part WHERE p_type = 'PROMO'")
def _(t):
    return K.score_scope(t.part.filter("p_type = 'PROMO'"), "p_size")


@query("c11_similarity_level", "SELECT p_partkey, CASE WHEN p_size / 50.0::DOUBLE < 0.30 THEN 'low' WHEN p_size / 50.0::DOUBLE < 0.60 THEN 'medium' ELSE 'high' END AS level FROM part")
def _(t):
    return t.part.select("p_partkey", K.similarity_level(F.col("p_size") / 50.0).alias("level"))


@query("c13_shingle_fingerprint", r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) > 0) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, ('0x' || substr(md5(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]), 1, 8))::BIGINT % 512 AS bit FROM w, unnest(range(1, len(w) - 1)) AS u(i)) SELECT doc_id, count(bit)::INTEGER AS n_bits, coalesce(sum(bit), 0)::BIGINT AS bit_sum FROM documents LEFT JOIN s USING (doc_id) GROUP BY 1""")
def _(t):
    bits = t.documents.select("doc_id", "text").repartition("doc_id").select("doc_id", K.shingle_fingerprint("text", 512).alias("b"))
    return bits.select("doc_id", F.size("b").alias("n_bits"), F.aggregate("b", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("bit_sum"))


@query("c17_pair_label", "SELECT p_partkey, CASE WHEN p_size >= 40 THEN upper(p_type) ELSE upper(p_type) || '+' || upper(p_brand) END AS with_phi, CASE WHEN p_size < 10 THEN upper(p_type) ELSE upper(p_type) || '+' || upper(p_brand) END AS by_name FROM part")
def _(t):
    second = F.when(F.col("p_size") >= 10, F.col("p_brand"))
    return t.part.select("p_partkey", K.pair_label("p_type", "p_brand", F.col("p_size") / 40).alias("with_phi"), K.pair_label("p_type", second).alias("by_name"))


@query("c18_experiment_matrix", """WITH m AS (SELECT DISTINCT p_type AS method, p_type LIKE 'E%' AS sensitive FROM part), s AS (SELECT r_name AS surrogate FROM region), k AS (SELECT (42 + 111 * n_nationkey)::INTEGER AS seed FROM nation)
SELECT method, surrogate, seed, method || '|' || surrogate || '|seed=' || seed AS label FROM m, s, k WHERE sensitive UNION ALL SELECT method, NULL, seed, method || '|seed=' || seed FROM m, k WHERE NOT sensitive""")
def _(t):
    methods = t.part.select(F.col("p_type").alias("method"), F.startswith("p_type", F.lit("E")).alias("sensitive")).distinct()
    return J.experiment_matrix(methods, t.region.select(F.col("r_name").alias("surrogate")), t.nation.select((42 + 111 * F.col("n_nationkey")).cast("int").alias("seed")))


TARGET = "t AS (SELECT list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) > 0)) AS tt FROM documents WHERE doc_id = 0)"
DOCS = f"""{TARGET}, d AS (SELECT doc_id, lang, source, n_chars, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) > 0)) AS tok, embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
tan AS (SELECT d.*, coalesce(len(list_intersect(tok, tt)) / nullif(len(list_distinct(list_concat(tok, tt))), 0)::DOUBLE, 0) AS a, (source = (SELECT source FROM documents WHERE doc_id = 0))::INT::DOUBLE AS b FROM d, t),
fp AS (SELECT *, a * (0.35::DOUBLE / 0.9) + b * (0.55::DOUBLE / 0.9) AS fp_sim FROM tan),
ref AS (SELECT embedding AS r FROM fp WHERE embedding IS NOT NULL ORDER BY fp_sim DESC, doc_id LIMIT 1),
sim AS (SELECT fp.*, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), list_transform(r, lambda x: x::DOUBLE)) AS feat_sim FROM fp, ref),
com AS (SELECT *, 0.3::DOUBLE * fp_sim + 0.7::DOUBLE * greatest(0, least(1, coalesce(feat_sim, 0))) AS combined_sim FROM sim)"""


def doc_rows(t):
    tokens = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) > 0))
    vec = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    docs = t.documents.select("doc_id", "text", "lang", "source", "n_chars").repartition("doc_id").select("doc_id", "lang", "source", "n_chars", tokens.alias("tok"), F.array("source").alias("src"))
    target = docs.filter("doc_id = 0")
    rows = docs.join(vec, "doc_id", "left").withColumns({"tt": target.select("tok").scalar(), "ts": target.select("src").scalar()})
    fp = K.set_similarity({"linker": (F.col("tt"), 0.35), "precursor": (F.col("ts"), 0.55), "modulator": (None, 0.10)}, {"linker": "tok", "precursor": "src", "modulator": "src"})
    return K.blended_similarity(rows, "doc_id", fp, "vec")


@query("j13_set_similarity", f"WITH {DOCS} SELECT doc_id, round(fp_sim, 6) AS fp_sim FROM fp")
def _(t):
    return doc_rows(t).select("doc_id", F.round("fp_sim", 6).alias("fp_sim"))


@query("j12_max_similarity", "SELECT round(max(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), list_transform(q, lambda x: x::DOUBLE))), 6) AS max_similarity FROM embeddings, (SELECT list_reverse(embedding) AS q FROM embeddings WHERE vec_id = 0)")
def _(t):
    target = t.embeddings.filter("vec_id = 0").select(F.reverse("embedding")).scalar()
    return K.max_similarity(t.embeddings, "embedding", target).withColumns(r6("max_similarity"))


@query("c6_nearest_rows", f"WITH {DOCS} SELECT doc_id, round(combined_sim, 6) AS combined_sim FROM com WHERE combined_sim >= 0.05 ORDER BY combined_sim DESC, doc_id LIMIT 15")
def _(t):
    return K.nearest_rows(doc_rows(t), "doc_id").select("doc_id", F.round("combined_sim", 6).alias("combined_sim"))


@query("c6_neighbourhood_template", f"""WITH {DOCS}, nb AS (SELECT *, n_chars % 10 AS score, greatest(100, least(5000, n_chars)) AS v FROM com WHERE combined_sim >= 0.05 ORDER BY combined_sim DESC, doc_id LIMIT 15),
c AS (SELECT count(*) FILTER (score >= 5) AS ns FROM nb) SELECT 'n_chars' AS param, round(CASE WHEN max(ns) >= 2 THEN sum(v * combined_sim * (score + 1)) FILTER (score >= 5) / sum(combined_sim * (score + 1)) FILTER (score >= 5) ELSE sum(v * combined_sim * (score + 1)) / sum(combined_sim * (score + 1)) END, 4) AS center,
round(stddev_pop(v), 4) AS spread FROM nb, c""")
def _(t):
    # a handful of rows, which the template reads four times
    rows = cut(K.nearest_rows(doc_rows(t), "doc_id").withColumn("score", F.col("n_chars") % 10))
    out = K.neighbourhood_template(rows, "doc_id", "tok", "lang", "en", "score", {"n_chars": (100, 5000)})
    return out.withColumns(r6("center", "spread", digits=4))
