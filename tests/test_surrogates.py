"""Calibration on rows a surrogate has not seen, look-up of leaves, saved surrogates, sweeps."""

import threading
import time

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from campanile.operators import models as M


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (240, 3))
    y = np.clip(np.round(4 + 2 * x[:, 0] - x[:, 1] + rng.normal(0, 1, 240)), 0, 9)
    df = spark.createDataFrame([(i, v.tolist(), float(t), i % 3) for i, (v, t) in enumerate(zip(x, y))], "id long, v array<double>, y double, fold int")
    return df.select("id", array_to_vector("v").alias("features"), "y", "fold").repartition(3).cache()


def test_leaves_give_what_the_trees_predict(rows):
    model = M.ForestSurrogate(trees=5, depth=4).fit(rows)
    wide = model.per_tree(rows)
    for i, tree in enumerate(model.model.trees):
        wide = tree.copy().setFeaturesCol("features").setPredictionCol(f"t{i}").transform(wide)
    for r in wide.collect():
        assert r.trees == pytest.approx([r[f"t{i}"] for i in range(5)], rel=1e-12)


def test_ranks_do_not_leak_from_the_held_out_fold(rows):
    """One held-out target far above all others: ranks of the other rows still fill 0 to 1, and the far target counts as their largest."""
    leaky = rows.withColumn("y", F.when(F.col("fold") == 0, F.col("y") + 100).otherwise(F.col("y")))
    model = M.RankSurrogate(trees=3, depth=3)
    train = leaky.filter("fold <> 0")
    span = model.ranked(train).agg(F.min("__rank"), F.max("__rank")).first()
    values = sorted(r.y for r in train.collect())
    expected = lambda v: min(1.0, max(0.0, (sum(x <= v for x in values) - 1) / (len(values) - 1)))
    top = [i for i, v in enumerate(values) if v == values[-1]]
    assert span[0] == pytest.approx((values.count(values[0]) - 1) / 2 / (len(values) - 1)) and span[1] == pytest.approx(np.mean(top) / (len(values) - 1))
    assert {r["y"] for r in model.held_out(leaky, "fold", 0).collect()} == {1.0}
    # ranks over all rows would have left the other rows below two thirds
    assert model.ranked(leaky).filter("fold <> 0").agg(F.max("__rank")).first()[0] < 0.7
    mapped = {r.id: r["__rank"] for r in model.mapped(rows.filter("fold = 0"), train).collect()}
    assert all(mapped[r.id] == pytest.approx(expected(r.y)) for r in rows.filter("fold = 0").collect())
    fitted = model.fit(rows, "fold", 3)
    ys = sorted(r.y for r in rows.collect())
    for value in (-1.0, 0.0, 4.0, 9.0, 50.0):
        assert fitted.raw_to_rank(value) == pytest.approx(min(1.0, max(0.0, (sum(y <= value for y in ys) - 1) / (len(ys) - 1))))


def test_unseen_members_calibrate_the_ensemble(rows):
    model = M.BoostedEnsemble(members=5, rounds=3, depth=3).fit(rows, "id")
    assert model.scale > 1  # members trained alike are too sure of themselves
    out = model.predict(rows).select("y", "mu", "sigma").toPandas()
    within = lambda s: float(np.mean(np.abs(out.y - out.mu) <= s))
    assert within(out.sigma) >= 0.5 > within(out.sigma / model.scale)


def test_saved_surrogates_predict_the_same(rows, tmp_path):
    told = lambda m: {r.id: (r.mu, r.sigma) for r in m.predict(rows).collect()}
    forest = M.ForestSurrogate(trees=3, depth=3, alpha=0.3).fit(rows, "fold", 3)
    forest.save(f"{tmp_path}/forest")
    ranks = M.RankSurrogate(trees=3, depth=3).fit(rows)
    ranks.save(f"{tmp_path}/ranks")
    boosted = M.BoostedEnsemble(members=2, rounds=2, depth=2).fit(rows, "id")
    boosted.save(f"{tmp_path}/boosted")
    loaded = M.RankSurrogate.load(f"{tmp_path}/ranks")
    assert told(M.ForestSurrogate.load(f"{tmp_path}/forest")) == told(forest)
    assert told(loaded) == told(ranks) and loaded.raw_to_rank(5.0) == ranks.raw_to_rank(5.0)
    assert told(M.BoostedEnsemble.load(f"{tmp_path}/boosted")) == told(boosted)


def test_sweeps_run_some_jobs_at_a_time(spark):
    running, most, lock = [0], [0], threading.Lock()

    def job(i):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        n = spark.range(1000).count() + i
        time.sleep(0.2)
        with lock:
            running[0] -= 1
        return n

    assert M.concurrently([lambda i=i: job(i) for i in range(6)], 3, spark) == [1000 + i for i in range(6)]
    assert 2 <= most[0] <= 3


def test_a_failed_setting_cancels_the_others(spark):
    """The slow jobs would take minutes."""
    slow = lambda: spark.range(0, 4, 1, 4).filter("java_method('java.lang.Thread', 'sleep', 60000L) is null").count()

    def bad():
        time.sleep(3)
        raise ZeroDivisionError

    begin = time.monotonic()
    with pytest.raises(ZeroDivisionError):
        M.concurrently([slow, bad, slow, slow], 2, spark)
    assert time.monotonic() - begin < 50


def test_sweep_rows_and_undefined_metrics(rows):
    scored = M.alpha_sweep(rows, "fold", 3, [0.0, 0.5], "id", "y", trees=2, depth=2)
    assert scored.count() == 2 * 240 and scored.filter("score is null").count() == 0
    low = M.sweep_metrics(scored, 1e9, 5).collect()  # no row is a hit
    assert len(low) == 6 and all(r.roc_auc is None and r.pr_auc is None and r.tail_rmse is None and r.hit_at_k == 0 for r in low)
