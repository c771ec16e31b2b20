"""Hand-computed edge rules."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from campanile.functions import numeric as N
from campanile.functions import text as S
from campanile.operators import campaigns as C
from campanile.operators import candidates as K
from campanile.operators import clean as P
from campanile.operators import joins as J
from campanile.operators import metrics as M
from campanile.operators import profiles as V


def one(df):
    return df.first().asDict()


def test_numbers(spark):
    rows = spark.createDataFrame([("1.5",), (" 2 ",), ("nan",), ("1d",), ("",), (None,), ("-3e2",)], "x string")
    assert [r[0] for r in rows.select(P.to_number("x")).collect()] == [1.5, 2.0, None, None, None, None, -300.0]
    assert one(rows.filter("x = 'nan'").select(P.to_number("x", 4).alias("v")))["v"] == 4.0


def test_normal_cdf(spark):
    rows = spark.createDataFrame([(i / 10,) for i in range(-80, 81)], "z double")
    for z, p in rows.select("z", N.normal_cdf("z")).collect():
        assert p == pytest.approx((1 + math.erf(z / math.sqrt(2))) / 2, abs=1e-14)


def scored(spark, rows):
    return spark.createDataFrame(rows, "run long, item_id long, y double, role string, iteration long")


def test_summary_without_pool_hits(spark):
    got = one(C.run_summary(scored(spark, [(1, 1, 9.0, "init", None), (1, 2, 3.0, "pool", 1), (1, 3, 1.0, "pool", None)]), ["run"], 7))
    assert got["AF"] is None and got["hit_discovery_rate"] == 0.0 and got["EF"] == 1.5
    assert got["best_score_final"] == 9.0 and got["simple_regret_final"] == 6.0


def test_summary_without_selection(spark):
    got = one(C.run_summary(scored(spark, [(1, 1, 9.0, "init", None), (1, 2, 8.0, "pool", None)]), ["run"], 7))
    assert got["AF"] is None and got["EF"] is None and got["hit_rate"] == 0.0 and got["n_evaluated"] == 0


def test_summary_values(spark):
    rows = [(1, i, float(y), "pool", it) for i, (y, it) in enumerate([(9, 1), (2, 2), (8, None), (1, None)])]
    got = one(C.run_summary(scored(spark, rows), ["run"], 7))
    assert got["AF"] == pytest.approx(1.0) and got["EF"] == pytest.approx(5.5 / 5.0)


def test_kappa_one_class(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2)], "a int, b int")
    assert one(M.quadratic_kappa(rows, [], "a", "b"))["qwk"] == 0.0


def test_auc_ties_and_one_class(spark):
    rows = spark.createDataFrame([("a", True, 1.0), ("a", False, 1.0), ("b", True, 1.0)], "g string, pos boolean, s double")
    got = {r["g"]: r["roc_auc"] for r in M.ranking_quality(rows, ["g"], F.col("pos"), "s").collect()}
    assert got == {"a": 0.5, "b": None}


def test_wilcoxon_all_zero_and_known(spark):
    rows = spark.createDataFrame([("z", 0.0)] * 4 + [("p", float(i)) for i in range(1, 11)], "m string, delta double")
    got = {r["m"]: r["p_value"] for r in M.signed_rank(rows, ["m"]).collect()}
    assert got["z"] == 1.0
    # of all choices of signs only one has ten positive ranks
    assert got["p"] == 1 / 1024


def test_wilcoxon_is_exact_for_few_and_approximate_with_ties(spark):
    import itertools

    rng = random.Random(5)
    for n in (1, 2, 7, 11):
        deltas = [rng.choice((-1, 1)) * (i + 1.0) for i in range(n)]
        t = sum(i + 1 for i, d in enumerate(deltas) if d > 0)
        exact = sum(sum(s) >= t for s in itertools.product(*[(0, i + 1) for i in range(n)])) / 2**n
        got = one(M.signed_rank(spark.createDataFrame([("a", d) for d in deltas], "m string, delta double"), ["m"]))
        assert got["p_value"] == pytest.approx(exact, abs=1e-12)
    tied = spark.createDataFrame([("a", d) for d in (1.0, 1.0, 2.0, -3.0, 4.0)], "m string, delta double")
    z = (11 - 7.5) / math.sqrt((5 * 6 * 11 - 6 / 2) / 24)
    assert one(M.signed_rank(tied, ["m"]))["p_value"] == pytest.approx((1 - math.erf(z / math.sqrt(2))) / 2, abs=1e-12)


def test_spearman_constant(spark):
    rows = spark.createDataFrame([(0, i, 1.0, float(i)) for i in range(5)], "g int, id long, x double, y double")
    assert one(M.spearman(rows, ["g"], "x", "y", "id"))["spearman"] is None


def test_calibration_error_row(spark):
    rows = spark.createDataFrame([("m", 1.0, 0.0, 0.0)] * 4 + [("m", 1.0, 0.0, 1.0)] * 2, "model string, y double, mu double, sigma double")
    got = one(M.calibration(rows, ["model"]))
    assert got["error"] and got["mean_z"] is None and got["n_valid"] == 2 and got["n_zero_sigma"] == 4


def test_labels(spark):
    rows = spark.createDataFrame([("ei|rf|seed=7",), ("lfbo|seed=3",), ("batch|lfbo|kb",), ("x",)], "l string")
    got = [tuple(r[0]) for r in rows.select(S.parse_label("l")).collect()]
    assert got == [(False, "ei", "rf", 7), (False, "lfbo", None, 3), (True, "lfbo", None, None), (False, "x", None, None)]


def test_zero_volume_drops_slot(spark):
    rows = spark.createDataFrame([(1, "a", 0.0, 0.5, " b ", None, 0.5)], "id int, n1 string, v1 double, f1 double, n2 string, v2 double, f2 double")
    got = V.collect_slots(rows, "id", [("n1", "v1", "f1"), ("n2", "v2", "f2")]).collect()
    assert [(r["name"], r["amount"]) for r in got] == [("B", 0.5)]


def test_profile_moments_of_nothing(spark):
    rows = spark.createDataFrame([([0.0, 0.0],)], "a array<double>")
    got = one(rows.select(*[c.alias(n) for n, c in V.moments("a", [-0.01, 0.01]).items()]))
    assert got["m0"] == 0.0 and got["f_acc"] is None and got["spread"] is None


@pytest.mark.parametrize("buckets", [1, 3])
def test_pairs_by_buckets(spark, buckets):
    names = spark.createDataFrame([(c,) for c in "dacbe"], "k string")
    pairs = sorted(map(tuple, J.unordered_pairs(names, "k", buckets=buckets).collect()))
    assert pairs == sorted([(a, b) for a in "abcde" for b in "abcde" if a < b] + [(a, "") for a in "abcde"])
    assert sorted(map(tuple, J.product(names, names.withColumnRenamed("k", "j"), buckets).collect())) == [(a, b) for a in "abcde" for b in "abcde"]


def test_duplicate_seed_is_an_error(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0), ("b", 1, 1.0)], "m string, seed int, v double")
    with pytest.raises(Exception, match="more than one row per seed: 1"):
        J.paired(rows, "m", "a", "b", "seed", ["v"]).collect()
    assert J.paired(rows.filter("v <> 1 or m = 'b'"), "m", "a", "b", "seed", ["v"]).collect() == [(1, 2.0, 1.0)]


def test_expected_improvement_without_spread(spark):
    rows = spark.createDataFrame([(5.0, 0.0), (1.0, 0.0)], "mu double, sigma double")
    assert [r[0] for r in rows.select(K.expected_improvement("mu", "sigma", 3.0, 0.0)).collect()] == [2.0, 0.0]


def region(flags, length=0.8):
    s = f = 0
    for up in flags:
        s, f = (s + 1, 0) if up else (0, f + 1)
        if s >= 3:
            length, s = min(length * 2, 1.6), 0
        if f >= 3:
            length, f = length / 2, 0
            if length < 0.1:
                length = 0.8
    return length, s, f


@pytest.mark.parametrize("chunk", [3, 7, 10_000])
def test_trust_region_by_chunks(spark, blocks, chunk):
    import random

    rng = random.Random(3)
    rows, want = [], {}
    for c in range(3):
        best, flags = float("-inf"), []
        for step in range(150):
            score = float(rng.randint(0, 40) + step // 4)
            flags.append(score > best + 1e-6)
            best = max(best, score)
            rows.append((c, step, score))
        want[c] = (*region(flags), best, 150)
    got = K.trust_region(spark.createDataFrame(rows, "c int, step long, y double"), "c", "step", "y", chunk=chunk).collect()
    assert {r["c"]: (r["length"], r["successes"], r["failures"], r["best"], r["n_updates"]) for r in got} == want


def psi(n):
    import numpy as np

    return -0.5772156649015329 + sum(1 / i for i in range(1, int(n))) if np.isscalar(n) else np.array([psi(int(i)) for i in n])


def test_digamma(spark):
    rows = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 5, 6, 7, 50, 1000)], "n double")
    for n, value in rows.select("n", N.digamma("n")).collect():
        assert value == pytest.approx(psi(n), abs=1e-8)


def test_neighbour_information_against_brute_force(spark, blocks):
    import numpy as np

    from campanile.operators.features import neighbour_information

    rng = np.random.default_rng(2)
    label = rng.integers(0, 3, 400)
    x = rng.normal(label, 1.0)
    k, own, radius, inside = 3, [], [], []
    for i in range(len(x)):
        same = np.sort(np.abs(x[label == label[i]] - x[i]))[1:]
        own.append(len(same) + 1)
        radius.append(same[k - 1])
        inside.append((np.abs(x - x[i]) < same[k - 1]).sum())
    want = psi(len(x)) + psi(k) - psi(np.array(own)).mean() - psi(np.array(inside)).mean()
    rows = spark.createDataFrame([(i, "f", float(v), int(c)) for i, (v, c) in enumerate(zip(x, label))], "id long, feature string, value double, label int")
    assert neighbour_information(rows, "id").first()["mi"] == pytest.approx(max(want, 0), abs=1e-3)


def test_tables_work_in_a_session_without_our_settings(spark, folder):
    from campanile.plans.registry import Tables

    setting = "spark.sql.adaptive.forceOptimizeSkewedJoin"
    before = spark.conf.get(setting)
    spark.conf.unset(setting)
    try:
        assert Tables(spark, folder).region.count() == 5
        assert spark.conf.get(setting) == "false"  # a query leaves the caller's settings alone
    finally:
        spark.conf.set(setting, before)


def test_checkpoints_need_no_setting(tmp_path):
    """In a process of its own: no preset folder, then only the context's."""
    import subprocess
    import sys

    code = """
from pyspark.sql import SparkSession
from campanile.session import checkpoint_dir, cut
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
{before}
assert cut(spark.range(5)).count() == 5
assert checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()
"""
    root = __file__.rsplit("/", 2)[0]
    for before in ("", "import tempfile; spark.sparkContext.setCheckpointDir(tempfile.mkdtemp())"):
        subprocess.run([sys.executable, "-c", code.format(before=before)], cwd=root, check=True, timeout=120, capture_output=True, env=os.environ | {"SPARK_CONF_DIR": str(tmp_path)})


@pytest.mark.parametrize("chunk", [3, 10_000])
def test_trust_region_with_rises_below_the_threshold(spark, blocks, chunk):
    """The best stays where it was until a score beats it by more than 1e-6, whatever the highest score is."""
    import numpy as np

    rng = np.random.default_rng(4)
    tracks = [[1.0, 1 + 0.6e-6, 1 + 1.2e-6], [2.0] * 5, [1.0, 1 + 0.9e-6, 1 + 1.8e-6, 1 + 2.7e-6, 1 + 3.6e-6, 5.0, 5 + 1e-7]]
    tracks += [list(1 + np.cumsum(rng.choice([0.0, 0.4e-6, 0.7e-6, 2e-6, -1e-6], 40))) for _ in range(6)]
    want = {}
    for c, track in enumerate(tracks):
        length, s, f, best = 0.8, 0, 0, float("-inf")
        for y in track:
            if y > best + 1e-6:
                s, f, best = s + 1, 0, y
            else:
                s, f = 0, f + 1
            if s >= 3:
                length, s = min(length * 2, 1.6), 0
            if f >= 3:
                length, f = length / 2, 0
                length = 0.8 if length < 0.1 else length
        want[c] = (length, s, f, best, len(track))
    rows = [(c, i, float(y)) for c, track in enumerate(tracks) for i, y in enumerate(track)]
    got = K.trust_region(spark.createDataFrame(rows, "c int, step long, y double"), "c", "step", "y", chunk=chunk).collect()
    assert {r.c: (r.length, r.successes, r.failures, r.best, r.n_updates) for r in got} == want
