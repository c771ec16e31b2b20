"""Feature statistics, scaling, catalogs and scalar functions bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import numeric as N
from ..functions import text as S
from ..functions.quantile import quantiles
from ..operators import features as X
from ..sources.files import layout_hash
from .metrics import r6
from .registry import query

NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("p17_varying_columns", """SELECT 'l_quantity' AS "column" FROM lineitem HAVING min(l_quantity) <> max(l_quantity) UNION ALL SELECT 'l_tax' FROM lineitem HAVING min(l_tax) <> max(l_tax)""")
def _(t):
    return X.varying_columns(t.lineitem.withColumn("constant", F.lit(3.0)), ["l_quantity", "constant", "l_tax"])


@query("p18_correlated_columns", """WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS r1, corr(l_quantity, l_quantity * 2 + l_tax) AS r2, corr(l_extendedprice, l_quantity * 2 + l_tax) AS r3 FROM lineitem)
SELECT 'l_extendedprice' AS "column", round(abs(r1), 6) AS max_r FROM c WHERE abs(r1) > 0.8 UNION ALL SELECT 'twice', round(greatest(abs(r2), abs(r3)), 6) FROM c WHERE greatest(abs(r2), abs(r3)) > 0.8""")
def _(t):
    df = t.lineitem.withColumn("twice", F.col("l_quantity") * 2 + F.col("l_tax"))
    return X.correlated_columns(df, ["l_quantity", "l_extendedprice", "twice"], 0.8).withColumns(r6("max_r"))


@query("p19_min_max_scaling", "SELECT o_orderkey, round((o_totalprice - (SELECT min(o_totalprice) FROM orders)) / (SELECT max(o_totalprice) - min(o_totalprice) FROM orders), 6) AS price FROM orders")
def _(t):
    ranges = X.Ranges.fit(t.orders, ["o_totalprice"])
    return t.orders.select("o_orderkey", F.round(ranges.scaled("o_totalprice", clip=True), 6).alias("price"))


@query("p20_standard_scaling", "SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders), 6) AS price FROM orders")
def _(t):
    model = X.Standard.fit(t.orders, ["o_totalprice"])
    return t.orders.select("o_orderkey", F.round(model.scaled("o_totalprice"), 6).alias("price"))


SCALED = """b AS (SELECT min(l_quantity) AS a0, max(l_quantity) AS a1, min(l_extendedprice) AS b0, max(l_extendedprice) AS b1, min(l_tax) AS c0, max(l_tax) AS c1 FROM lineitem),
s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity - a0) / (a1 - a0) AS t, (l_extendedprice - b0) / (b1 - b0) AS r, (l_tax - c0) / (c1 - c0) AS h FROM lineitem, b)"""


@query("p21_interactions", f"WITH {SCALED} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(t * r, 6) AS t_x_ratio, round(t * h, 6) AS t_x_hours, round(r * h, 6) AS ratio_x_hours, round(t * t, 6) AS t_squared, round(r * r, 6) AS ratio_squared, (t > 0.85)::INT::DOUBLE AS high_t FROM s")
def _(t):
    ranges = X.Ranges.fit(t.lineitem, ["l_quantity", "l_extendedprice", "l_tax"])
    cols = X.interactions(ranges.scaled("l_quantity"), ranges.scaled("l_extendedprice"), ranges.scaled("l_tax"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.round(c, 6).alias(n) for n, c in cols.items()])


@query("p22_column_blocks", "SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total, s_acctbal FROM embeddings JOIN supplier ON s_suppkey = vec_id")
def _(t):
    blocks = [t.embeddings.select(F.col("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), "label"), t.supplier.select(F.col("s_suppkey").alias("vec_id"), "s_acctbal")]
    wide = X.concat_blocks(blocks, "vec_id", {"vector": ["embedding", "s_acctbal"]})
    parts = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x) - F.col("s_acctbal")
    return wide.select("vec_id", "label", F.round(parts, 4).alias("total"), "s_acctbal")


@query("p23_concentrations", """WITH q AS (SELECT p_partkey, p_retailprice / 1000 AS c, (p_size - 10) / 20.0::DOUBLE AS ratio, p_size / 10.0::DOUBLE AS e FROM part), g AS (SELECT *, CASE WHEN ratio > 0 THEN ratio ELSE 1 END AS q FROM q)
SELECT p_partkey, round(q * c, 6) AS metal_conc, round(e * c, 6) AS mod_conc, round(c * (1 + q + e), 6) AS total_conc, round(q * c * 2, 6) AS metal_umol, round(c * 2, 6) AS linker_umol, round(e * c * 2, 6) AS mod_umol FROM g""")
def _(t):
    cols = X.concentrations(F.col("p_retailprice") / 1000, (F.col("p_size") - 10) / 20.0, F.col("p_size") / 10.0, F.lit(2.0))
    return t.part.select("p_partkey", *[F.round(c, 6).alias(n) for n, c in cols.items()])


@query("p28_feasibility", """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 280 + l_quantity * 2 AS temp, coalesce(CASE WHEN s_suppkey % 4 <> 0 THEN 310 + s_suppkey % 80 END, 500) - 15 AS lim FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN temp <= lim THEN 1 ELSE exp(-(temp - lim) / 15) END, 6) AS score FROM x""")
def _(t):
    limits = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.when(F.col("s_suppkey") % 4 != 0, (310 + F.col("s_suppkey") % 80).cast("double")).alias("limit"))
    rows = t.lineitem.join(limits, "l_suppkey", "left")
    score = X.feasibility(280 + F.col("l_quantity") * 2, "limit")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(score, 6).alias("score"))


CATALOG = """blocks AS (SELECT n_nationkey AS block_no, n_name AS prefix, (n_regionkey + 2)::INTEGER AS width, n_regionkey FROM nation),
st AS (SELECT *, coalesce(sum(width) OVER (ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM blocks),
cat AS (SELECT (start + i)::BIGINT AS pos, prefix || '_' || i AS name, 'region' || n_regionkey AS "group", n_regionkey % 2 = 0 AS is_discrete FROM st, range(0, 10) r(i) WHERE i < width)"""


def catalog(t):
    blocks = t.nation.select(
        F.col("n_nationkey").alias("block_no"), F.col("n_name").alias("prefix"), F.concat(F.lit("region"), F.col("n_regionkey").cast("string")).alias("group"),
        (F.col("n_regionkey") % 2 == 0).alias("is_discrete"), (F.col("n_regionkey") + 2).alias("width"),
    )
    return X.feature_catalog(blocks)


@query("p29_feature_catalog", f'WITH {CATALOG} SELECT pos, name, "group", is_discrete FROM cat')
def _(t):
    return catalog(t).withColumn("pos", F.col("pos").cast("bigint"))


@query("p30_name_lineage", f"""WITH {CATALOG} SELECT name, "group" FROM cat WHERE name NOT LIKE '%_0' AND is_discrete UNION ALL SELECT r_name, 'cluster' FROM region""")
def _(t):
    base = catalog(t).select("name", "group", "is_discrete")
    steps = [("drop", base.filter("name like '%\\_0'")), ("select", base.filter("is_discrete")), ("append", t.region.select(F.col("r_name").alias("name"), F.lit("cluster").alias("group")))]
    return X.lineage(base, steps).select("name", "group")


@query("p31_sanitised_vectors", """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CASE WHEN x > 0.2 THEN 0 ELSE x::DOUBLE END)), 4) AS total, (list_max(embedding) > 0.2)::INT::DOUBLE AS any_bad,
round(len(list_filter(embedding, lambda x: x > 0.2)) / 64.0::DOUBLE, 6) AS bad_fraction FROM embeddings""")
def _(t):
    dirty = F.transform("embedding", lambda x: F.when(x > 0.2, F.lit(float("nan"))).otherwise(x.cast("double")))
    parts = X.sanitise_vector("v")
    rows = t.embeddings.select("vec_id", dirty.alias("v"))
    return rows.select("vec_id", F.round(N.array_sum(parts["clean"]), 4).alias("total"), parts["any_bad"].alias("any_bad"), F.round(parts["bad_fraction"], 6).alias("bad_fraction"))


@query("s10_layout_hash", f"""WITH {CATALOG} SELECT sha256(string_agg(name || ':' || "group", '|' ORDER BY pos) || '|' || count(*)) AS layout FROM cat""")
def _(t):
    return layout_hash(catalog(t), "pos", ["name", "group"])


@query("f1_strings", """SELECT p_partkey, CASE WHEN length(p_name) > 6 THEN substr(p_name, 1, 6) || '...' ELSE p_name END AS short, upper(trim(p_type)) AS kind, replace(p_brand, 'Brand#', '') AS brand_no,
starts_with(p_name, 'red') AS is_red, array_to_string(list_filter(string_split(p_name, ' '), lambda x: NOT starts_with(x, 's')), ' ') AS kept FROM part""")
def _(t):
    return t.part.select(
        "p_partkey", S.shorten("p_name", 6).alias("short"), F.upper(F.trim("p_type")).alias("kind"), F.replace("p_brand", F.lit("Brand#"), F.lit("")).alias("brand_no"),
        F.startswith("p_name", F.lit("red")).alias("is_red"), S.without_part("p_name", " ", "s").alias("kept"),
    )


ROMAN = "CASE {x} WHEN 'I' THEN 1 WHEN 'II' THEN 2 WHEN 'III' THEN 3 WHEN 'IV' THEN 4 WHEN 'V' THEN 5 WHEN 'VI' THEN 6 WHEN 'VII' THEN 7 WHEN 'VIII' THEN 8 END"
NUMERAL = "CASE p_size % 9 WHEN 1 THEN 'I' WHEN 2 THEN 'II' WHEN 3 THEN 'III' WHEN 4 THEN 'IV' WHEN 5 THEN 'V' WHEN 6 THEN 'VI' WHEN 7 THEN 'VII' WHEN 8 THEN 'VIII' ELSE '' END"


@query("f2_regexes", f"""WITH n AS (SELECT p_partkey, p_name, p_size, {NUMERAL} AS r FROM part)
SELECT p_partkey, coalesce({ROMAN.format(x='r')}, 0)::INTEGER AS at_end, coalesce({ROMAN.format(x='r')}, CASE WHEN p_name = 'red widget' THEN 9 END, 0)::INTEGER AS in_parentheses, p_size::INTEGER AS seed,
regexp_full_match(p_name, '[a-z]+ r.*') AS matches FROM n""")
def _(t):
    numeral = F.element_at(F.array(*[F.lit(x) for x in ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII")]), (F.pmod("p_size", F.lit(9)) + 1).cast("int"))
    rows = t.part.select("p_partkey", "p_name", "p_size", numeral.alias("r"))
    return rows.select(
        "p_partkey", S.roman_at_end(F.concat("p_name", F.lit(" "), "r")).alias("at_end"),
        F.when(F.col("r") != "", S.roman_in_parentheses(F.concat("p_name", F.lit("("), "r", F.lit(")")))).otherwise(S.roman_in_parentheses("p_name", {"red widget": 9})).alias("in_parentheses"),
        S.first_number(F.concat(F.lit("a|seed="), F.col("p_size").cast("string")), "seed=").alias("seed"), F.rlike("p_name", F.lit("^[a-z]+ r.*$")).alias("matches"),
    )


@query("f3_label_parse", """SELECT p_partkey, p_type = 'PROMO' AS is_batch, CASE WHEN p_type = 'PROMO' THEN split_part(p_name, ' ', 1) ELSE p_type END AS acq,
CASE WHEN p_type <> 'PROMO' AND p_size % 2 = 0 THEN split_part(p_name, ' ', 2) END AS surrogate, CASE WHEN p_type <> 'PROMO' THEN p_size::DOUBLE END AS seed FROM part""")
def _(t):
    words = F.split("p_name", " ")
    seed = F.concat(F.lit("seed="), F.col("p_size").cast("string"))
    label = F.when(F.col("p_type") == "PROMO", F.concat_ws("|", F.lit("batch"), words[0], words[1])).when(F.col("p_size") % 2 == 0, F.concat_ws("|", "p_type", words[1], seed)).otherwise(F.concat_ws("|", "p_type", seed))
    return t.part.select("p_partkey", S.parse_label(label).alias("l")).select("p_partkey", "l.is_batch", "l.acq", "l.surrogate", F.col("l.seed").cast("double").alias("seed"))


@query("f4_composite_key", """SELECT p_partkey, CASE WHEN p_size > 25 THEN coalesce(nullif(p_brand, 'Brand#2'), p_name) || '.' || p_type || '>>' ELSE p_type || '>>' END AS k FROM part""")
def _(t):
    best = F.when(F.col("p_size") > 25, F.nullif("p_brand", F.lit("Brand#2")))
    spare = F.when(F.col("p_size") > 25, F.col("p_name"))
    return t.part.select("p_partkey", S.composite_key([[best, spare], "p_type"]).alias("k"))


PHASES = [("red", "warm"), ("blue", "cold"), ("ring", "round")]


@query("f5_first_match", "SELECT p_partkey, CASE WHEN contains(p_name, 'red') THEN 'warm' WHEN contains(p_name, 'blue') THEN 'cold' WHEN contains(p_name, 'ring') THEN 'round' ELSE 'other' END AS phase FROM part")
def _(t):
    return t.part.select("p_partkey", S.first_match("p_name", PHASES, "other").alias("phase"))


@query("f6_dates", "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, epoch(date_trunc('second', ts))::BIGINT AS seconds FROM events")
def _(t):
    return t.events.select("event_id", F.date_format("ts", "yyyyMMdd_HHmmss").alias("stamp"), F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")).alias("seconds"))


@query("f7_math", """SELECT p_partkey, greatest(10.0::DOUBLE, least(40.0, p_size)) AS clipped, round(exp(p_size / 50.0::DOUBLE * (ln(100.0::DOUBLE) - ln(2.0::DOUBLE)) + ln(2.0::DOUBLE)), 6) AS log_scaled, round(p_size / 50.0::DOUBLE * 98 + 2, 6) AS linear,
round(log2(p_size + 1.0::DOUBLE), 6) AS discount, pow(p_size, 3)::DOUBLE AS cubed, round(sqrt(greatest(p_size - 20, 0)), 6) AS floored FROM part""")
def _(t):
    u = F.col("p_size") / 50.0
    return t.part.select(
        "p_partkey", N.clip(F.col("p_size").cast("double"), 10, 40).alias("clipped"), F.round(N.log_scale(u, 2, 100), 6).alias("log_scaled"), F.round(N.linear_scale(u, 2, 100), 6).alias("linear"),
        F.round(F.log2(F.col("p_size") + 1.0), 6).alias("discount"), F.pow("p_size", F.lit(3)).alias("cubed"), F.round(F.sqrt(F.greatest(F.col("p_size") - 20, F.lit(0))), 6).alias("floored"),
    )


@query("f8_normal", f"""WITH z AS (SELECT event_id, (value - 20) / 10 AS z FROM events) SELECT event_id, round(exp(-z * z / 2) / sqrt(2 * pi()), 6) AS pdf, round({__import__('campanile.plans.metrics', fromlist=['CDF']).CDF}, 6) AS cdf FROM z""")
def _(t):
    z = (F.col("value") - 20) / 10
    return t.events.select("event_id", F.round(N.normal_pdf(z), 6).alias("pdf"), F.round(N.normal_cdf(z), 6).alias("cdf"))


@query("f9_arrays", """WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e, list_transform(q, lambda v: v::DOUBLE) AS q FROM embeddings, q)
SELECT vec_id, round(list_dot_product(e, q), 5) AS dot, round(list_cosine_similarity(e, q), 5) AS cosine, round(list_distance(e, q), 5) AS distance, round(sqrt(list_dot_product(e, e)), 5) AS norm,
(list_position(e, list_max(e)) - 1)::INTEGER AS first, round(list_max(e[1:8]), 6) AS best_of_8 FROM x""")
def _(t):
    q = t.embeddings.filter("vec_id = 0").select("embedding").scalar()
    rows = t.embeddings.withColumn("q", q)
    return rows.select(
        "vec_id", F.round(N.dot("embedding", "q"), 5).alias("dot"), F.round(N.cosine("embedding", "q"), 5).alias("cosine"), F.round(N.euclidean("embedding", "q"), 5).alias("distance"),
        F.round(N.norm("embedding"), 5).alias("norm"), N.argsort_desc("embedding")[0].alias("first"), F.round(F.element_at(N.running_max(F.slice("embedding", 1, 8)), -1), 6).alias("best_of_8"),
    )


@query("f10_map_lookup", "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 313 WHEN 'PROMO' THEN 339 ELSE 500 END::DOUBLE AS bp FROM part")
def _(t):
    return t.part.select("p_partkey", S.lookup("p_type", {"ECONOMY": 313.0, "PROMO": 339.0}, 500.0).alias("bp"))


@query("f10_token_counts", "SELECT p_type, count(*) FILTER (p_name = 'red widget') AS red_widget, count(DISTINCT p_name) AS n_names FROM part GROUP BY 1")
def _(t):
    counts = t.part.groupBy("p_type", "p_name").agg(F.count(F.lit(1)).alias("n"))
    found = F.max(F.when(F.col("p_name") == "red widget", F.col("n")))
    return counts.groupBy("p_type").agg(F.coalesce(found, F.lit(0)).alias("red_widget"), F.count("p_name").alias("n_names"))


@query("f11_json", """SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, '{"id":' || event_id || ',"type":"' || event_type || '"}' AS doc FROM events""")
def _(t):
    k = F.from_json("props", "k bigint")["k"]
    return t.events.select("event_id", k.alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("doc"))


@query("f12_first_present", "SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN c_mktsegment END, CASE WHEN c_acctbal > 0 THEN c_name END, 'none') AS label, CASE WHEN c_acctbal <> 0 THEN 1 ELSE 0 END::INTEGER AS finite FROM customer")
def _(t):
    label = F.coalesce(F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")), F.when(F.col("c_acctbal") > 0, F.col("c_name")), F.lit("none"))
    value = F.nanvl(F.when(F.col("c_acctbal") == 0, F.lit(float("nan"))).otherwise(F.lit(1.0)), F.lit(0.0))
    return t.customer.select("c_custkey", label.alias("label"), value.cast("int").alias("finite"))


@query("f13_hash_fold", """WITH w AS (SELECT DISTINCT p_partkey, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS bit FROM part, unnest(string_split(p_name || ' ' || p_type, ' ')) AS u(w))
SELECT p_partkey, string_agg(bit::VARCHAR, ',' ORDER BY bit) AS bits FROM w GROUP BY 1""")
def _(t):
    tokens = F.split(F.concat_ws(" ", "p_name", "p_type"), " ")
    return t.part.select("p_partkey", F.array_join(H.fold_tokens(tokens, 64).cast("array<string>"), ",").alias("bits"))


@query("f13_fast_hash_fold")
def _(t):
    tokens = F.split(F.lower("text"), "[^a-z]+")
    return t.documents.select("doc_id", F.size(H.fold_tokens_fast(tokens, 2048)).alias("n_bits"))


@query("f13_fast_hash_bounds", """WITH d AS (SELECT doc_id, len(list_distinct(regexp_split_to_array(lower(text), '[^a-z]+'))) AS n FROM documents)
SELECT doc_id, n::BIGINT AS n_tokens, true AS within FROM d""")
def _(t):
    """Distinct positions are no more than the distinct tokens, and about as many as an even hash gives."""
    tokens = F.split(F.lower("text"), "[^a-z]+")
    n, bits = F.size(F.array_distinct(tokens)), F.size(H.fold_tokens_fast(tokens, 2048))
    expected = 2048 * (1 - F.pow(F.lit(1 - 1 / 2048), n))
    within = (bits <= n) & (bits >= 1) & (F.abs(bits - expected) <= 6 * F.sqrt(expected) + 1)
    return t.documents.select("doc_id", n.cast("bigint").alias("n_tokens"), within.alias("within"))


@query("q_exact_quantiles", "SELECT event_type, unnest([0.0::DOUBLE, 0.1, 0.25, 0.5, 0.9, 1.0]) AS prob, round(unnest(quantile_cont(value, [0.0::DOUBLE, 0.1, 0.25, 0.5, 0.9, 1.0])), 6) AS q FROM events GROUP BY 1")
def _(t):
    return quantiles(t.events, ["event_type"], "value", [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]).withColumns(r6("q"))
