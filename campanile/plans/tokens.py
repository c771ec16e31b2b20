"""Inventories, lookups, joins, set operations and ordering bound to the test tables."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions.scan import number_rows
from ..operators import inventory as I
from ..operators import joins as J
from .registry import query


# fixed value: characters of the texts whose tokens one task counts
CHARS_PER_TASK = 8_000_000


def doc_tokens(t):
    """Tokens of each document. The number of parts follows the texts, so a task counts the tokens of a bounded share of them."""
    parts = max(1, math.ceil((t.documents.agg(F.sum(F.length("text"))).first()[0] or 0) / CHARS_PER_TASK), int(t.spark.conf.get("spark.sql.shuffle.partitions")))
    return I.token_inventory(t.documents.select("doc_id", "text").repartition(parts, "doc_id"), "doc_id", F.split(F.lower("text"), "[^a-z]+"))


WORDS = """
words AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS token FROM documents),
inventory AS (SELECT doc_id, token, count(*)::DOUBLE AS count FROM words WHERE token <> '' GROUP BY 1, 2)"""


@query("a6_token_totals", "WITH" + WORDS + " SELECT token, count(*) AS n_docs, sum(count) AS total FROM inventory GROUP BY 1")
def _(t):
    return doc_tokens(t).groupBy("token").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("count").alias("total"))


PART_WORDS = """
words AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS token, 1.0::DOUBLE AS w FROM part UNION ALL SELECT p_partkey, p_type, p_size::DOUBLE FROM part),
inventory AS (SELECT p_partkey, token, sum(w) AS count FROM words GROUP BY 1, 2)"""


def part_inventory(t):
    extra = F.array(F.struct(F.col("p_type").alias("token"), F.col("p_size").cast("double").alias("weight")))
    return I.token_inventory(t.part, "p_partkey", F.split("p_name", " "), extra)


@query("a6_token_inventory", "WITH" + PART_WORDS + " SELECT p_partkey, token, count FROM inventory")
def _(t):
    return part_inventory(t)


@query("a6_wide_inventory", "WITH" + PART_WORDS + """ SELECT p_partkey, coalesce(sum(count) FILTER (token = 'ring'), 0) AS "Total_ring", coalesce(sum(count) FILTER (token = 'ECONOMY'), 0) AS "Total_ECONOMY" FROM inventory GROUP BY 1""")
def _(t):
    return I.widen(part_inventory(t), "p_partkey", ["ring", "ECONOMY"])


FAMILIES = {"colour": ["red", "blue", "green"], "size": ["small", "large"], "kind": ["ring", "widget"]}


@query("a7_token_families", "WITH" + PART_WORDS + """, f AS (SELECT p_partkey, coalesce(sum(count) FILTER (token IN ('red', 'blue', 'green')), 0) AS colour_count,
coalesce(sum(count) FILTER (token IN ('small', 'large')), 0) AS size_count, coalesce(sum(count) FILTER (token IN ('ring', 'widget')), 0) AS kind_count FROM inventory GROUP BY 1)
SELECT *, colour_count + size_count + kind_count AS family_count, (colour_count + size_count + kind_count > 0)::INT::DOUBLE AS present,
CASE WHEN colour_count > 0 THEN 1 WHEN size_count > 0 THEN 2 WHEN kind_count > 0 THEN 3 ELSE 0 END::DOUBLE AS family_type FROM f""")
def _(t):
    return I.token_family_block(part_inventory(t), "p_partkey", FAMILIES)


@query("a8_one_hot", """SELECT c_custkey, """ + ", ".join(
    f"""(coalesce(CASE WHEN c_acctbal >= 0 THEN c_mktsegment END, 'Unknown') = '{d}')::INT::DOUBLE AS "segment_{d}" """
    for d in ["AUTOMOBILE", "BUILDING", "Unknown"]) + " FROM customer")
def _(t):
    seg = t.customer.select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("segment"))
    out = I.one_hot(seg, "segment", I.observed_domain(seg, "segment"))
    return out.select("c_custkey", "segment_AUTOMOBILE", "segment_BUILDING", "segment_Unknown")


def flag_inventory(t):
    return t.lineitem.groupBy(F.concat("l_returnflag", "l_linestatus").alias("flag"), F.col("l_suppkey").alias("token")).agg(F.sum("l_quantity").alias("count"))


def vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("token"), F.col("embedding").alias("vector"))


FLAGS = "inventory AS (SELECT l_returnflag || l_linestatus AS flag, l_suppkey AS token, sum(l_quantity) AS count FROM lineitem GROUP BY 1, 2)"


@query("a9_weighted_vector_sum", f"""WITH {FLAGS} SELECT flag, (i - 1)::INTEGER AS pos, round(sum(count * embedding[i]::DOUBLE), 3) AS value
FROM inventory JOIN embeddings ON token = vec_id, unnest(range(1, 65)) AS u(i) GROUP BY 1, 2""")
def _(t):
    return I.weighted_vector_sum(flag_inventory(t), vectors(t), "flag").withColumn("value", F.round("value", 3))


@query("a9_weighted_quality", f"""WITH {FLAGS}, q AS (SELECT s_suppkey AS token, (s_acctbal < 0)::INT::DOUBLE AS n_bad, abs(s_acctbal) / 10000 AS bad_fraction FROM supplier)
SELECT flag, sum(count * n_bad) AS n_bad, round(sum(count * bad_fraction) / greatest(sum(count), 1), 6) AS bad_fraction FROM inventory JOIN q USING (token) GROUP BY 1""")
def _(t):
    q = t.supplier.select(F.col("s_suppkey").alias("token"), (F.col("s_acctbal") < 0).cast("double").alias("n_bad"), (F.abs("s_acctbal") / 10000).alias("bad_fraction"))
    return I.weighted_quality(flag_inventory(t), q, "flag").withColumn("bad_fraction", F.round("bad_fraction", 6))


@query("a10_presence_block", f"""WITH {FLAGS} SELECT flag, token, count, (vec_id IS NULL)::INT::DOUBLE AS missing, (i - 1)::INTEGER AS pos, coalesce(embedding[i]::DOUBLE, 0) AS value
FROM inventory LEFT JOIN embeddings ON token = vec_id, unnest(range(1, 65)) AS u(i) WHERE i = 1 OR vec_id IS NOT NULL""")
def _(t):
    v = vectors(t).withColumn("vector", F.col("vector").cast("array<double>"))
    return I.presence_block(flag_inventory(t), v, "flag")


@query("v9_token_ratio", """SELECT c_custkey, coalesce(n_f / nullif(n_o, 0)::DOUBLE, CASE WHEN n_p > 0 THEN n_p END::DOUBLE, 1.0) AS ratio FROM (SELECT o_custkey AS c_custkey,
nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1)""")
def _(t):
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(*[F.count_if(F.col("o_orderstatus") == s).alias(s) for s in "FOP"])
    ratio = I.token_ratio(F.col("F"), F.col("O"), recorded=F.when(F.col("P") > 0, F.col("P").cast("double")), fallback=1.0)
    return n.select("c_custkey", ratio.alias("ratio"))


@query("j1_left_join", "SELECT o_orderkey, o_orderstatus, l_linenumber::DOUBLE AS l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def _(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("double").alias("l_linenumber"), "l_quantity")
    return t.orders.select("o_orderkey", "o_orderstatus").join(lines, "o_orderkey", "left")


@query("j2_left_join_fill", "SELECT o_orderkey, coalesce(sum(l_quantity), 0) AS quantity, coalesce(max(l_discount), 0) AS discount FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def _(t):
    block = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("quantity"), F.max("l_discount").alias("discount"))
    return I.lookup(t.orders.select("o_orderkey"), block, "o_orderkey", {"quantity": 0.0, "discount": 0.0})


@query("j3_lookup_default", "SELECT c_custkey, coalesce(n_name, 'elsewhere') AS n_name, coalesce(n_regionkey, -1) AS n_regionkey FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey")
def _(t):
    near = t.nation.filter("n_regionkey < 3").withColumnRenamed("n_nationkey", "c_nationkey")
    return I.lookup(t.customer.select("c_custkey", "c_nationkey"), near, "c_nationkey", {"n_name": "elsewhere", "n_regionkey": -1}).drop("c_nationkey")


@query("j4_paired_seeds", """WITH m AS (SELECT event_type, (user_id % 10)::INTEGER AS seed, avg(value) AS mean_value FROM events GROUP BY 1, 2)
SELECT a.seed, round(a.mean_value, 6) AS mean_value_a, round(b.mean_value, 6) AS mean_value_b FROM m a JOIN m b USING (seed) WHERE a.event_type = 'click' AND b.event_type = 'error'""")
def _(t):
    m = t.events.groupBy("event_type", F.pmod("user_id", F.lit(10)).cast("int").alias("seed")).agg(F.avg("value").alias("mean_value"))
    out = J.paired(m, "event_type", "click", "error", "seed", ["mean_value"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean_value_a", "mean_value_b")})


@query("j5_candidate_product", "SELECT p_partkey, p_size, r_name FROM part, region")
def _(t):
    return J.product(t.part.select("p_partkey", "p_size"), t.region.select("r_name"))


@query("j6_unordered_pairs", "SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_name < y.n_name UNION ALL SELECT n_name, '' FROM nation")
def _(t):
    return J.unordered_pairs(t.nation, "n_name")


@query("j6_pairs_with_ratios", """WITH p AS (SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_name < y.n_name)
SELECT a, b, unnest([0.25, 0.5, 0.75])::DOUBLE AS phi FROM p UNION ALL SELECT b, a, unnest([0.25, 0.75])::DOUBLE FROM p UNION ALL SELECT n_name, '', 1.0 FROM nation""")
def _(t):
    return J.with_ratios(J.unordered_pairs(t.nation, "n_name"), [0.25, 0.5, 0.75])


@query("j7_observed_pairs", """WITH w AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part), k AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS k FROM part WHERE p_size > 25 AND p_name NOT LIKE 'red%' UNION SELECT 'ring')
SELECT a, CASE WHEN b IN (SELECT k FROM k) THEN b ELSE '' END AS b, min(p_partkey) AS first_seen FROM w WHERE a IN (SELECT k FROM k) GROUP BY 1, 2""")
def _(t):
    words = F.split("p_name", " ")
    w = t.part.select("p_partkey", words[0].alias("a"), words[1].alias("b"))
    known = t.part.filter("p_size > 25 and p_name not like 'red%'").select(words[0].alias("k")).distinct()
    known = known.unionByName(t.part.select(F.lit("ring").alias("k")).distinct()).distinct()
    return J.observed_pairs(w, "a", "b", known, "k", "p_partkey")


@query("j8_exact_successes", "SELECT DISTINCT upper(p_type) AS member FROM part WHERE p_name = 'red widget' AND p_size >= 25 UNION SELECT DISTINCT upper(p_brand) FROM part WHERE p_name = 'red widget' AND p_size >= 25")
def _(t):
    return J.members_used(J.exact_successes(t.part, {"p_name": "red widget"}, "p_size", 25), ["p_type", "p_brand"])


@query("j9_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(t):
    busy = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return J.without(t.customer.select("c_custkey"), busy, ["c_custkey"])


@query("j10_nearest_allowed", """SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 1.0::DOUBLE ELSE (SELECT v FROM (VALUES (0.0::DOUBLE, 0), (0.25, 1), (0.5, 2), (0.75, 3), (1.0, 4)) AS a(v, i) ORDER BY abs(v - p_size / 50.0::DOUBLE), i LIMIT 1) END AS phi FROM part""")
def _(t):
    x = F.when(F.col("p_type") == "PROMO", F.lit(1.0)).otherwise(N.nearest_allowed(F.col("p_size") / 50.0, [0.0, 0.25, 0.5, 0.75, 1.0]))
    return t.part.select("p_partkey", x.alias("phi"))


@query("j11_local_index", "SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS local_index FROM orders")
def _(t):
    numbered = number_rows(t.orders.select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], "o_orderkey", F.lit(0))
    return numbered.select("o_orderkey", "o_orderpriority", (F.col("rn") - 1).alias("local_index"))


ALIGN = "trained AS (SELECT s_suppkey AS token, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos FROM supplier WHERE s_acctbal > 0)"


def trained(t):
    kept = t.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("token"))
    return number_rows(kept, [], "token", F.lit(0)).select("token", (F.col("rn") - 1).alias("pos"))


@query("j16_align_tokens", f"WITH {FLAGS}, {ALIGN} SELECT flag, token, pos, count FROM inventory JOIN trained USING (token)")
def _(t):
    return I.align_tokens(flag_inventory(t), trained(t))[0]


@query("j16_unseen_tokens", f"WITH {FLAGS}, {ALIGN} SELECT token, sum(count) AS n_dropped FROM inventory WHERE token NOT IN (SELECT token FROM trained) GROUP BY 1")
def _(t):
    return I.align_tokens(flag_inventory(t), trained(t))[1]


@query("u1_union_by_name", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, NULL::VARCHAR AS brand FROM customer UNION ALL SELECT p_partkey, p_name, NULL, p_brand FROM part")
def _(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return J.union_by_name(a, t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand")))


@query("u2_member_union", "SELECT upper(p_type) AS member FROM part UNION SELECT upper(p_brand) FROM part UNION SELECT upper(n_name) FROM nation")
def _(t):
    return J.members_used(t.part, ["p_type", "p_brand"]).union(J.members_used(t.nation, ["n_name"])).distinct()


@query("u3_intersect", "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
def _(t):
    return t.customer.filter("c_acctbal > 5000").select(F.col("c_custkey").alias("k")).intersect(t.orders.filter("o_totalprice > 400000").select("o_custkey"))


@query("u4_except", "SELECT o_custkey AS k FROM orders WHERE o_totalprice > 400000 EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def _(t):
    return t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("k")).subtract(t.customer.filter("c_acctbal > 5000").select("c_custkey"))


@query("t1_score_order", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY 2 DESC, 1")
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")


@query("t2_batch_first_order", "SELECT p_partkey, round_even(p_retailprice / 100, 0) AS rounded, p_size FROM part ORDER BY (p_size = 50) DESC, 2 DESC, 3, 1")
def _(t):
    rows = t.part.select("p_partkey", F.bround(F.col("p_retailprice") / 100).alias("rounded"), "p_size")
    return rows.orderBy(F.desc(F.col("p_size") == 50), F.desc("rounded"), "p_size", "p_partkey")


@query("t3_filtered_top_k", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 ORDER BY 2 DESC, 1 LIMIT 15")
def _(t):
    return t.orders.filter("o_totalprice >= 1000").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15)


@query("t4_first_at_maximum", "SELECT o_orderpriority, max(o_totalprice) AS best, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS item FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_orderpriority").agg(
        F.max("o_totalprice").alias("best"), F.min_by("o_orderkey", F.struct(-F.col("o_totalprice"), F.col("o_orderkey"))).alias("item")
    )


@query("t5_stratified_top_k", """WITH f AS (SELECT p_partkey, p_size % 2 = 0 AS is_discrete, p_retailprice AS score FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY is_discrete ORDER BY score DESC, p_partkey) AS rn FROM f) SELECT p_partkey, is_discrete, score FROM r WHERE rn <= CASE WHEN is_discrete THEN 100 ELSE 300 END""")
def _(t):
    scores = t.part.select("p_partkey", (F.col("p_size") % 2 == 0).alias("is_discrete"), F.col("p_retailprice").alias("score"))
    from ..operators.features import stratified_top

    return stratified_top(scores, "is_discrete", {True: 100, False: 300}, "score", "p_partkey")


@query("t6_single_top_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY 2 DESC, 1 LIMIT 300")
def _(t):
    return t.part.select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(300)


@query("t7_top_contributions", """WITH x AS (SELECT vec_id, (i - 1)::INTEGER AS pos, embedding[i]::DOUBLE AS value, row_number() OVER (PARTITION BY vec_id ORDER BY abs(embedding[i]) DESC, i) AS rank FROM embeddings, unnest(range(1, 65)) AS u(i))
SELECT vec_id, pos, value, rank::INTEGER AS rank FROM x WHERE rank <= 5""")
def _(t):
    tagged = F.transform("embedding", lambda x, i: F.struct((-F.abs(x.cast("double"))).alias("k"), i.alias("pos"), x.cast("double").alias("value")))
    top = F.slice(F.array_sort(tagged), 1, 5)
    out = t.embeddings.select("vec_id", F.posexplode(top).alias("r", "s"))
    return out.select("vec_id", F.col("s.pos").alias("pos"), F.col("s.value").alias("value"), (F.col("r") + 1).alias("rank"))


@query("t8_undefined_last", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS metric FROM orders ORDER BY 2 DESC NULLS LAST, 1")
def _(t):
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("metric"))
    return rows.orderBy(F.col("metric").desc_nulls_last(), "o_orderkey")


@query("w11_last_per_group", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"))


@query("w12_newest_per_key", "SELECT user_id, event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS newest, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def _(t):
    newest = F.row_number().over(W.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id")))
    return t.events.withColumn("rn", newest).filter("rn = 1").select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("newest"), "event_id")


@query("w13_batch_ranks", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS batch_rank FROM conversations")
def _(t):
    numbered = number_rows(t.conversations.select("conv_id", "turn"), ["conv_id"], "turn", F.lit(0), out="batch_rank")
    return numbered
