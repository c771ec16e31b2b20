"""Sums by chunks of vectors, weights of many classes, and profiles from folded values."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from campanile.functions.numeric import round_half_up
from campanile.operators.clean import column_profile
from campanile.operators.features import elbow, feature_catalog
from campanile.operators.groups import balanced_resample, group_split, held_out_groups, leave_group_out, split_sizes
from campanile.operators.inventory import weighted_vector_sum
from campanile.operators.joins import unordered_pairs, with_ratios
from campanile.operators.metrics import class_weights
from campanile.operators.profiles import blend, blend_totals, enumerated_moments, moments, proportions, two_member_blend, two_member_moments
from campanile.sources.snapshots import pending_picks


@pytest.mark.parametrize("chunk", [1, 3, 32])
def test_vector_sums_of_ragged_vectors_and_hot_tokens(spark, chunk):
    vectors = {f"t{i}": [None if (i + j) % 7 == 0 else float(i * j - 3) for j in range(i % 9)] for i in range(40)} | {"gone": None}
    rows = [(k, t, float(1 + (k * 7 + n) % 5)) for k in range(6) for n, t in enumerate([*vectors, *["t8"] * 200, "unknown"])]
    expected, seen = defaultdict(float), set()
    for k, t, n in rows:
        for pos, v in enumerate(vectors.get(t) or []):
            seen.add((k, pos))
            expected[k, pos] += n * v if v is not None else 0.0
    inventory = spark.createDataFrame([(*r, "x") for r in rows], "id int, token string, count double, vector string")
    found = weighted_vector_sum(inventory, spark.createDataFrame(list(vectors.items()), "token string, vector array<double>"), "id", chunk=chunk)
    assert found.columns == ["id", "pos", "value"]
    got = {(r.id, r.pos): r.value for r in found.collect()}
    assert set(got) == seen and all((got[c] or 0.0) == pytest.approx(expected[c]) for c in seen)
    assert weighted_vector_sum(inventory.limit(0), spark.createDataFrame(list(vectors.items()), "token string, vector array<double>"), "id").count() == 0


def test_vector_sums_make_no_row_a_position_before_the_sum(spark):
    inventory = spark.range(1000).select((F.col("id") % 3).alias("key"), (F.col("id") % 50).alias("token"), F.lit(1.0).alias("count"))
    vectors = spark.range(50).select(F.col("id").alias("token"), F.array_repeat(F.lit(1.0), 64).alias("vector"))
    out = weighted_vector_sum(inventory, vectors, "key")
    assert out.agg(F.sum("value")).first()[0] == 64_000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    before = plan[plan.index("Aggregate") :]
    assert "posexplode" not in before and plan.count("posexplode") == 1


def test_class_weights_of_many_classes_and_nulls(spark):
    rows = spark.range(30_000).select("id", F.when(F.col("id") % 3 != 0, F.col("id") % 12_000).alias("label"), F.lit(9.0).alias("class_weight"))
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = class_weights(rows, "label")
    assert found.columns == rows.columns
    for r in found.collect():
        assert r.class_weight is None if r.label is None else r.class_weight == pytest.approx(30_000 / (len(sizes) * sizes[r.label]))
    assert class_weights(rows.limit(0), "label").count() == 0
    small = spark.range(3000).select("id", F.when(F.col("id") % 10 == 0, "rare").otherwise("common").alias("label"))
    by = {r.label: r.n for r in balanced_resample(small, "label", "id").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert by["rare"] == pytest.approx(1500, rel=0.1) and by["common"] == pytest.approx(1500, rel=0.1)


def test_column_profiles_with_hot_values_nulls_and_no_rows(spark):
    rows = [(1 if i % 3 == 0 else i, None, 2.5 if i % 2 else None, 7) for i in range(300)]
    df = spark.createDataFrame(rows, "a int, b double, column double, v int")
    got = {r["column"]: tuple(r)[1:] for r in column_profile(df, ["a", "b", "column", "v"]).collect()}
    a = [r[0] for r in rows]
    assert got == {"a": (len(set(a)), 1.0, 299.0, pytest.approx(sum(a) / 300)), "b": (0, None, None, None), "column": (1, 2.5, 2.5, 2.5), "v": (1, 7.0, 7.0, 7.0)}
    assert sorted(map(tuple, column_profile(df.limit(0), ["a", "b"]).collect())) == [("a", 0, None, None, None), ("b", 0, None, None, None)]


def knee(scores, least, most=None):
    """Elbow and cliff of a list, by definition."""
    s = sorted((x for x in scores if x is not None), reverse=True)
    n, peak = len(scores), s[0]
    s += [None] * (n - len(s))
    cap = n if most is None else min(n, most)
    steps = [((s[i + 2] - 2 * s[i + 1] + s[i]) / peak, -(i + 1)) for i in range(cap - 2) if s[i + 2] is not None] if peak else []
    at = -max(steps)[1] if steps else None
    low = next((i for i in range(cap) if s[i] is not None and s[i] < peak * 0.05), None)
    chosen = n if n <= least else cap if peak == 0 else max(least, min(at or cap, cap))
    return chosen, max(1, min(n if low is None else low, at or n, n))


def test_elbow_of_ties_nulls_and_flat_scores(spark, blocks):
    falling = [1000 / (1 + i) ** 1.5 for i in range(400)]
    cases = [(falling, 5, None), (falling, 5, 100), ([3.0] * 300 + [1.0] * 300 + [None] * 5, 50, None), ([0.0] * 60, 50, None), ([2.0, 1.0], 50, None), ([5.0, None], 1, None)]
    for scores, least, most in cases:
        table = spark.createDataFrame([(f"f{i}", x) for i, x in enumerate(scores)], "name string, score double")
        got = elbow(table, "score", "name", least, most).first()
        assert (got.elbow, got.cliff) == knee(scores, least, most)


def test_catalog_positions_by_blocks(spark, blocks):
    widths = [(i * 7) % 5 + 1 for i in range(300)]
    table = spark.createDataFrame([(i, f"b{i}", "g", w, i % 2 == 0) for i, w in enumerate(widths)], "block_no int, prefix string, group string, width int, is_discrete boolean")
    expected = [f"b{i}_{j}" for i, w in enumerate(widths) for j in range(w)]
    assert [r.name for r in feature_catalog(table).orderBy("pos").collect()] == expected
    assert sorted(r.pos for r in feature_catalog(table).select("pos").collect()) == list(range(len(expected)))


def test_groups_held_out_in_turn_without_copies(spark):
    rows = spark.createDataFrame([("a",)] * 30 + [("b",)] * 25 + [("c",)] * 5 + [(None,)] * 2, "g string")
    marked = leave_group_out(rows, "g", held_out_groups(rows, "g").filter("g is not null"))
    assert marked.count() == 62 and {r.g for r in marked.filter("held_out").collect()} == {"a", "b"}
    told = {(r.held, r.role): r.n for r in split_sizes(marked, "g").collect()}
    assert told == {("a", "pool"): 30, ("a", "init"): 32, ("b", "pool"): 25, ("b", "init"): 37}
    assert {r.role: r["count"] for r in group_split(marked, "g", "b").groupBy("role").count().collect()} == {"pool": 25, "init": 37}


def test_batches_kept_in_several_rows(spark):
    schema = "it int, ahead int, picks array<struct<x:string>>"
    parts = spark.createDataFrame([(1, 0, [("a",), ("b",)]), (1, 2, [("c",)]), (2, 0, [("d",)])], schema)
    gone = spark.createDataFrame([(1, 2)], "iteration int, rank int")
    assert [tuple(r) for r in pending_picks(parts, "it", "picks", gone, before="ahead").collect()] == [(2, 1, "d"), (1, 1, "a"), (1, 3, "c")]


def test_blend_moments_from_member_moments(spark):
    axis = [-2.0, -1.0, 0.0, 1.0, 2.0]
    members = spark.createDataFrame([("A", [1.0, 2.0, 3.0, 2.0, 1.0], 10.0), ("B", [0.0, 1.0, 5.0, 4.0, 2.0], None), ("C", None, 5.0)], "name string, area array<double>, unit double")
    rows = spark.createDataFrame([("a", "B", 0.3), ("a", "zz", 0.5), ("c", "A", 0.5), ("b", "c", 0.2), ("a", "b", 0.0)], "a string, b string, phi double")
    whole = two_member_blend(rows, "a", "b", "phi", members)
    slow = whole.select("a", "b", "phi", "share_1", *[c.alias(n) for n, c in moments("area", axis).items()]).collect()
    fast = two_member_moments(rows, "a", "b", "phi", members, axis).collect()
    as_text = lambda r: {k: round(v, 9) if isinstance(v, float) else v for k, v in r.asDict().items()}
    assert sorted(map(str, map(as_text, slow))) == sorted(map(str, map(as_text, fast)))


def test_pairs_of_repeated_names_and_units_that_cancel(spark):
    """As the SQL of V8 has it: each pair of rows counts, and a share over a sum of 0 is infinite, its blend undefined."""
    members = spark.createDataFrame([("A", [1.0, 2.0], -2.0), ("B", [4.0, 3.0], 2.0), ("B", [1.0, 1.0], 6.0)], "name string, area array<double>, unit double")
    pairs = unordered_pairs(members, "name", repeats=True)
    assert sorted(map(tuple, pairs.collect())) == [("A", ""), ("A", "B"), ("A", "B"), ("B", "")]
    told = two_member_moments(with_ratios(pairs, [0.5]), "a", "b", "phi", members, [0.0, 1.0]).select("a", "b", "share_1", "m0").collect()
    # -1/4 beside 1/4 (cancels) and beside 1/12
    assert sorted((r.a, r.b, round(r.share_1, 9), str(round(r.m0, 9))) for r in told) == [
        ("A", "", 1.0, "3.0"), *[("A", "B", float("-inf"), "nan")] * 2, *[("A", "B", 1.5, "3.5")] * 2, ("B", "", 1.0, "2.0"), ("B", "", 1.0, "7.0"),
    ]


def test_enumerated_blends_match_no_pair_with_anything(spark, folder):
    """V8: pairs carry the numbers of their members, so nothing is joined or moved after they are formed."""
    plan = entry.queries()["v8_enumerated_blends"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    above = plan.split("CartesianProduct")[0] if "CartesianProduct" in plan else plan.split("BroadcastNestedLoopJoin")[0]
    assert above != plan and "Join" not in above and "Exchange" not in above and "Join" not in plan.split("Union")[1].replace("BroadcastNestedLoopJoin", "")


@pytest.mark.parametrize("rows", [2, 4096])
def test_enumerated_blends_equal_blends_by_name(spark, monkeypatch, rows):
    monkeypatch.setattr("campanile.operators.profiles.FIRST_ROWS", rows)
    monkeypatch.setattr("campanile.operators.profiles.SECOND_ROWS", rows)
    axis = [-0.02, 0.0, 0.02]
    members = [("A", [1.0, 2.0, 3.0], -2.0), ("B", [4.0, 3.0, 0.5], 2.0), ("B", [1.0, 1.0, 7.0], 6.0), ("C", [0.0, 0.0, 0.0], None), ("D", None, 1.0), ("E", [2.0, 2.0, 1.0], 0.0)]
    members = spark.createDataFrame(members, "name string, area array<double>, unit double")
    slow = two_member_moments(with_ratios(unordered_pairs(members.filter("area is not null"), "name", repeats=True), [0.25, 0.5]), "a", "b", "phi", members, axis)
    fast = enumerated_moments(members, [0.25, 0.5], axis)
    as_text = lambda df: sorted(str({k: round(v, 9) if isinstance(v, float) else v for k, v in r.asDict().items()}) for r in df.select(slow.columns).collect())
    assert as_text(slow) == as_text(fast)


def test_enumerated_blends_of_odd_names(spark):
    """As the SQL of V8 has it: an empty name is a name, blanks belong to it, and a member without a name is told alone only."""
    members = spark.createDataFrame([("", [1.0], 1.0), (" A", [3.0], 1.0), (None, [5.0], 1.0)], "name string, area array<double>, unit double")
    told = enumerated_moments(members, [0.25], [0.0]).select("a", "b", "phi", "m0").collect()
    assert sorted(map(tuple, told), key=str) == sorted([("", " A", 0.25, 2.5), (" A", "", 0.25, 1.5), ("", "", 1.0, 1.0), (" A", "", 1.0, 3.0), (None, "", 1.0, 5.0)], key=str)


def test_rounding_equals_that_of_spark(spark):
    rng = np.random.default_rng(5)
    halves = (rng.integers(-10**6, 10**6, 5000) + 0.5) / 1e4
    values = np.concatenate([halves, np.nextafter(halves, 1e9), np.nextafter(halves, -1e9), rng.normal(0, 50, 5000), 10.0 ** rng.integers(-9, 18, 2000) * rng.normal(0, 1, 2000), [0.0, -0.0, -0.00001, np.nan, np.inf, -np.inf, 1e300]])
    both = spark.createDataFrame([(float(v),) for v in values], "x double").select(F.round("x", 4).alias("a"), round_half_up("x", 4).alias("b"))
    assert all(str(r.a) == str(r.b) for r in both.collect())


def test_added_up_blends_without_profiles_in_the_rows(spark):
    members = spark.createDataFrame([("A", [1.0, 2.0], 2.0), ("B", [4.0, 3.0], 6.0), ("C", None, 1.0), ("D", [1.0, 9.0], None)], "name string, area array<double>, unit double")
    rows = [(1, 0, "A", 3.0), (1, 1, "B", 1.0), (2, 0, "A", 1.0), (2, 1, "C", 1.0), (3, 0, "D", 2.0), (3, 1, "A", 2.0), (3, 2, "A", 1.0), (4, 0, "zz", 1.0)]
    slots = spark.createDataFrame(rows, "k int, slot int, name string, amount double")
    each = [r.area for r in blend(proportions(slots, "k", members), "k", members, 2).collect() if r.area is not None]
    plan = blend_totals(slots, "k", members)
    assert len(each) == 2
    assert {r.pos: (r.n, round(r.total, 9)) for r in plan.collect()} == {i: (2, round(sum(a[i] for a in each), 9)) for i in range(2)}
