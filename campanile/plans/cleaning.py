"""Cleaning and audit bound to `events` (dirty numbers), `orders` and `lineitem`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import draw
from ..operators import clean as C
from .registry import Tables, query

# about a third of the texts become words, blanks or broken numbers
DIRTY = """
dirty AS (
  SELECT event_id, event_type, user_id, value,
         CASE event_id % 7 WHEN 0 THEN ' NaN ' WHEN 1 THEN '' WHEN 2 THEN 'None' WHEN 3 THEN '12abc'
              ELSE json_extract_string(props, '$.k') END AS raw,
         CASE WHEN event_id % 5 <> 0 THEN value END AS gap,
         CASE WHEN event_id % 11 <> 0 THEN value * 2 END AS gap2
  FROM events)"""
NUM = r"CASE WHEN regexp_full_match(trim(raw), '[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?') THEN try_cast(trim(raw) AS DOUBLE) END"


def dirty(t: Tables):
    m = F.pmod("event_id", F.lit(7))
    raw = F.when(m == 0, " NaN ").when(m == 1, "").when(m == 2, "None").when(m == 3, "12abc").otherwise(F.get_json_object("props", "$.k"))
    return t.events.select(
        "event_id", "event_type", "user_id", "value", raw.alias("raw"),
        F.when(F.pmod("event_id", F.lit(5)) != 0, F.col("value")).alias("gap"),
        F.when(F.pmod("event_id", F.lit(11)) != 0, F.col("value") * 2).alias("gap2"),
    )


@query("p1_placeholder_to_null", "WITH" + DIRTY + " SELECT event_id, CASE WHEN lower(trim(raw)) NOT IN ('', 'none', 'nan') THEN trim(raw) END AS cleaned FROM dirty")
def _(t):
    return dirty(t).select("event_id", C.placeholder_to_null("raw").alias("cleaned"))


@query("p2_numeric_coercion", "WITH" + DIRTY + f" SELECT event_id, {NUM} AS number, coalesce({NUM}, -1) AS with_default FROM dirty")
def _(t):
    return dirty(t).select("event_id", C.to_number("raw").alias("number"), C.to_number("raw", -1).alias("with_default"))


@query("p3_key_report", "SELECT count(*) AS n_rows, count(*) FILTER (l_orderkey IS NULL)::BIGINT AS n_null, count(l_orderkey) - count(DISTINCT l_orderkey) AS n_duplicate FROM lineitem")
def _(t):
    return C.key_report(C.require_columns(t.lineitem, ["l_orderkey"]), "l_orderkey")


@query("p4_row_validation", "WITH" + DIRTY + f""", v AS (SELECT event_id, CASE WHEN raw IS NULL OR trim(raw) = '' THEN 'raw is missing' END AS r1,
CASE WHEN ({NUM}) IS NULL THEN 'raw is not a number' END AS r2, CASE WHEN ({NUM}) < 0 OR ({NUM}) > 50 THEN 'raw is out of range' END AS r3 FROM dirty)
SELECT event_id, concat_ws('; ', r1, r2, r3) AS reasons FROM v""")
def _(t):
    checked = C.validate_rows(dirty(t), ["event_type", "raw"], "raw", 0, 50)
    return checked.select("event_id", F.array_join("reasons", "; ").alias("reasons"))


@query("p4_accepted_rows", "WITH" + DIRTY + f" SELECT event_type, count(*) AS n FROM dirty WHERE ({NUM}) BETWEEN 0 AND 50 GROUP BY 1")
def _(t):
    accepted, _ = C.split_valid(C.validate_rows(dirty(t), ["event_type", "raw"], "raw", 0, 50))
    return accepted.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def diagnosed(t):
    return C.parse_diagnostics(dirty(t), "raw", C.to_number("raw").isNotNull())


@query("p5_parse_rate", "WITH" + DIRTY + f" SELECT count(*) AS n_rows, round(avg((({NUM}) IS NOT NULL)::INT), 6) AS ok_rate FROM dirty")
def _(t):
    return C.parse_rate(diagnosed(t), "raw").withColumn("ok_rate", F.round("ok_rate", 6))


@query("p5_top_failures", "WITH" + DIRTY + f" SELECT raw, count(*) AS n FROM dirty WHERE ({NUM}) IS NULL GROUP BY 1 ORDER BY n DESC, raw LIMIT 15")
def _(t):
    return C.top_failures(diagnosed(t), "raw")


@query("p6_membership_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _(t):
    broke = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return C.member_rows(t.orders, "o_custkey", broke).select("o_orderkey", "o_totalprice")


@query("p7_finite_labels", "WITH" + DIRTY + f" SELECT event_id, trunc({NUM})::INTEGER AS label FROM dirty WHERE ({NUM}) IS NOT NULL")
def _(t):
    return C.finite_labels(dirty(t), "raw").select("event_id", "label")


SCORE = "least(9, floor(o_totalprice / 50000))::DOUBLE"


def score():
    return F.least(F.lit(9.0), F.floor(F.col("o_totalprice") / 50000).cast("double"))


@query("p8_ordinal_bins", f"SELECT CASE WHEN {SCORE} <= 2 THEN 0 WHEN {SCORE} <= 5 THEN 1 ELSE 2 END AS class, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy(C.bins_at_most(score(), [2, 5], [0, 1, 2]).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("p9_display_bins", f"SELECT CASE WHEN {SCORE} >= 7 THEN 'crystalline' WHEN {SCORE} >= 3 THEN 'partial' ELSE 'amorphous' END AS shown, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy(C.bins_at_least(score(), [7, 3], ["crystalline", "partial", "amorphous"]).alias("shown")).agg(F.count(F.lit(1)).alias("n"))


@query("p10_missing_fill", "WITH" + DIRTY + """, m AS (SELECT median(gap) AS m FROM dirty)
SELECT event_id, (gap IS NULL)::INT::DOUBLE AS gap_missing, round(coalesce(gap, m), 6) AS gap, round(coalesce(gap2, 0), 6) AS gap2 FROM dirty, m""")
def _(t):
    base = dirty(t)
    filled = C.MissingFill.fit(base, ["gap2"], ["gap"]).transform(base)
    return filled.select("event_id", "gap_missing", F.round("gap", 6).alias("gap"), F.round("gap2", 6).alias("gap2"))


FOLDED = DIRTY + ", folded AS (SELECT *, (('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT % 3)::INTEGER AS fold FROM dirty)"


def folded(t):
    return dirty(t).withColumn("fold", (draw("event_id") % 3).cast("int"))


@query("p11_fold_medians", "WITH" + FOLDED + """, k AS (SELECT unnest([0, 1, 2])::INTEGER AS fold)
SELECT 'gap' AS "column", k.fold, round(median(gap), 6) AS median FROM folded f JOIN k ON f.fold <> k.fold GROUP BY 2
UNION ALL SELECT 'gap2', k.fold, round(median(gap2), 6) FROM folded f JOIN k ON f.fold <> k.fold GROUP BY 2""")
def _(t):
    return C.fold_medians(folded(t), ["gap", "gap2"], "fold", 3).withColumn("median", F.round("median", 6))


@query("p11_impute_by_fold", "WITH" + FOLDED + """, k AS (SELECT unnest([0, 1, 2])::INTEGER AS fold),
m AS (SELECT k.fold, median(gap) AS m1, median(gap2) AS m2 FROM folded f JOIN k ON f.fold <> k.fold GROUP BY 1)
SELECT event_id, round(coalesce(gap, m1), 6) AS gap, round(coalesce(gap2, m2), 6) AS gap2 FROM folded JOIN m USING (fold)""")
def _(t):
    out = C.impute_by_fold(folded(t), ["gap", "gap2"], "fold", 3)
    return out.select("event_id", F.round("gap", 6).alias("gap"), F.round("gap2", 6).alias("gap2"))


@query("p12_non_finite_to_zero", "SELECT event_id, round(CASE WHEN event_id % 5 = 0 OR value = 0 THEN 0 ELSE 1000 / value END, 6) AS v FROM events")
def _(t):
    inverse = F.when(F.pmod("event_id", F.lit(5)) == 0, F.lit(float("nan"))).when(F.col("value") == 0, F.lit(float("inf"))).otherwise(1000 / F.col("value"))
    return t.events.select("event_id", F.round(C.finite_or(inverse), 6).alias("v"))


@query("p13_range_counts", "WITH" + DIRTY + f" SELECT count(*) FILTER (({NUM}) IS NULL) AS n_null, count(*) FILTER (({NUM}) < 20) AS n_below, count(*) FILTER (({NUM}) > 80) AS n_above FROM dirty")
def _(t):
    return C.range_counts(dirty(t), "raw", 20, 80)


@query("p14_pair_filter_strict", """SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part
WHERE upper(split_part(p_name, ' ', 1)) IN ('RED', 'SMALL') AND upper(split_part(p_name, ' ', 2)) IN ('WIDGET', 'RING')""")
def _(t):
    words = F.split("p_name", " ")
    pairs = t.part.select("p_partkey", words[0].alias("a"), words[1].alias("b"))
    return C.pair_filter(pairs, "a", "b", ["RED", "SMALL", "WIDGET", "RING"], "strict").filter(F.upper("a").isin("RED", "SMALL"))


@query("p14_pair_filter_permissive", """SELECT p_partkey FROM part
WHERE upper(split_part(p_name, ' ', 1)) = 'RED' OR upper(split_part(p_name, ' ', 2)) = 'RING' OR upper(split_part(p_name, ' ', 1)) = 'RING' OR upper(split_part(p_name, ' ', 2)) = 'RED'""")
def _(t):
    words = F.split("p_name", " ")
    pairs = t.part.select("p_partkey", words[0].alias("a"), words[1].alias("b"))
    return C.pair_filter(pairs, "a", "b", ["RED", "RING"], "permissive").select("p_partkey")


@query("p15_prefix_columns", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(t):
    return t.customer.select(*C.columns_with_prefix(t.customer, "c_"))


@query("p16_token_key", """SELECT p_partkey, CASE WHEN trim(p_name) = 'small ring' THEN 'sring' WHEN trim(p_type) IN ('ECONOMY') THEN 'eco' ELSE NULL END AS from_name,
CASE WHEN p_type = 'ECONOMY' THEN 'eco' WHEN instr(trim(p_type), ' ') = 0 AND length(trim(p_type)) > 0 THEN trim(p_type) END AS from_type FROM part WHERE p_name = 'small ring' OR p_type <> 'ECONOMY' OR p_type = 'ECONOMY'""".replace("WHEN trim(p_type) IN ('ECONOMY') THEN 'eco' ELSE NULL", "ELSE NULL"))
def _(t):
    return t.part.select(
        "p_partkey",
        C.token_key("p_name", {"small ring": "sring"}).alias("from_name"),
        C.token_key("p_type", {"ECONOMY": "eco"}).alias("from_type"),
    )


@query("p24_round_half_even", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN round_even(l_extendedprice / 100 - 273.15::DOUBLE, 0) = 0 THEN 0 ELSE round_even(l_extendedprice / 100 - 273.15::DOUBLE, 0) END AS celsius,
round_even(l_quantity * 0.25::DOUBLE, 1) AS first_part, round_even(l_quantity * 0.75::DOUBLE, 1) AS second_part FROM lineitem""")
def _(t):
    a, b = C.split_volume("l_quantity", F.lit(0.25), 1)
    celsius = C.kelvin_to_celsius(F.col("l_extendedprice") / 100)
    celsius = F.when(celsius == 0, F.lit(0.0)).otherwise(celsius)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", celsius.alias("celsius"), a.alias("first_part"), b.alias("second_part"))


@query("p25_effective_fraction", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linestatus = 'F' THEN 1.0::DOUBLE ELSE greatest(0, least(1, (l_quantity - 5) / 40)) END AS phi FROM lineitem")
def _(t):
    second = F.when(F.col("l_linestatus") == "F", F.lit("none")).otherwise(F.col("l_linestatus"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", C.effective_fraction((F.col("l_quantity") - 5) / 40, second).alias("phi"))


@query("p26_friendly_columns", 'SELECT n_nationkey AS "Nation", n_name AS "Name", n_regionkey FROM nation')
def _(t):
    return C.friendly_columns(t.nation, {"n_nationkey": "Nation", "n_name": "Name", "absent": "Absent"})


MIXED = """CASE event_id % 6 WHEN 0 THEN 'null' WHEN 1 THEN event_id::VARCHAR WHEN 2 THEN printf('%.2f', value) WHEN 3 THEN ' NA' WHEN 4 THEN event_type ELSE '-7' END"""


@query("p27_smart_cast", f"""WITH m AS (SELECT event_id, trim({MIXED}) AS s FROM events),
k AS (SELECT *, CASE WHEN lower(s) IN ('', 'none', 'nan', 'null', 'na') THEN 'null' WHEN regexp_full_match(s, '[+-]?\\d+') THEN 'int' WHEN regexp_full_match(s, '[+-]?\\d+\\.\\d*') THEN 'float' ELSE 'text' END AS kind FROM m)
SELECT event_id, kind, CASE WHEN kind = 'int' THEN s::DOUBLE END AS as_int, CASE WHEN kind = 'float' THEN s::DOUBLE END AS as_float, CASE WHEN kind = 'text' THEN s END AS as_text FROM k""")
def _(t):
    m = F.pmod("event_id", F.lit(6))
    text = (
        F.when(m == 0, "null").when(m == 1, F.col("event_id").cast("string")).when(m == 2, F.format_string("%.2f", "value"))
        .when(m == 3, " NA").when(m == 4, F.col("event_type")).otherwise("-7")
    )
    return t.events.select("event_id", C.smart_cast(text).alias("s")).select("event_id", "s.kind", F.col("s.as_int").cast("double").alias("as_int"), "s.as_float", "s.as_text")


@query("a1_value_counts", "SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1")
def _(t):
    return C.value_counts(t.part, "p_type")


@query("a2_null_audit", "WITH" + DIRTY + """ SELECT * FROM (SELECT 'gap' AS "column", count(*) FILTER (gap IS NULL) AS n_null, round(100.0::DOUBLE * count(*) FILTER (gap IS NULL) / count(*), 6) AS pct_null FROM dirty
UNION ALL SELECT 'gap2', count(*) FILTER (gap2 IS NULL), round(100.0::DOUBLE * count(*) FILTER (gap2 IS NULL) / count(*), 6) FROM dirty
UNION ALL SELECT 'value', count(*) FILTER (value IS NULL), round(100.0::DOUBLE * count(*) FILTER (value IS NULL) / count(*), 6) FROM dirty) WHERE n_null > 0""")
def _(t):
    return C.null_audit(dirty(t), ["gap", "gap2", "value"]).withColumn("pct_null", F.round("pct_null", 6))


@query("a3_coercion_failures", "WITH" + DIRTY + f""", bad AS (SELECT event_id, raw FROM dirty WHERE raw IS NOT NULL AND ({NUM}) IS NULL)
SELECT 'raw' AS "column", count(*) AS n_bad, count(DISTINCT raw) AS n_distinct, (SELECT string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FROM (SELECT event_id FROM bad ORDER BY 1 LIMIT 10)) AS first_ids FROM bad""")
def _(t):
    out = C.coercion_failures(dirty(t), ["raw", "value"], "event_id")
    return out.withColumn("first_ids", F.array_join("first_ids", ","))


@query("a4_offending_rows", "WITH" + DIRTY + """, o AS (SELECT event_id, concat_ws(',', CASE WHEN gap IS NULL THEN 'gap' END, CASE WHEN gap2 IS NULL THEN 'gap2' END) AS null_columns, ((gap IS NULL)::INT + (gap2 IS NULL)::INT) AS n_null FROM dirty)
SELECT * FROM o WHERE n_null > 0""")
def _(t):
    out = C.offending_rows(dirty(t), "event_id", ["gap", "gap2", "value"])
    return out.select("event_id", F.array_join("null_columns", ",").alias("null_columns"), "n_null")


@query("a4_offender_breakdown", "WITH" + DIRTY + " SELECT event_type, count(*) AS n FROM dirty WHERE gap IS NULL OR gap2 IS NULL GROUP BY 1")
def _(t):
    return C.value_counts(C.offending_rows(dirty(t), "event_id", ["gap", "gap2"]), "event_type")


@query("a5_column_profile", "".join(
    f"""{'UNION ALL ' if i else ''}SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_distinct, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high, round(avg({c}), 4) AS mean FROM lineitem """
    for i, c in enumerate(["l_quantity", "l_discount", "l_tax"])))
def _(t):
    return C.column_profile(t.lineitem, ["l_quantity", "l_discount", "l_tax"]).withColumn("mean", F.round("mean", 4))
