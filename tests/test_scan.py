"""Block scans against pandas, with a hot group and hot values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from campanile.functions.quantile import fit_quantiles, quantiles
from campanile.functions.scan import lagged, number_rows, plan_blocks, rank_counts, running, with_halo


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    n = 3_000
    # group 0 holds two thirds of the rows, value 7 a third of them
    return pd.DataFrame({
        "g": np.where(rng.random(n) < 0.66, 0, rng.integers(1, 20, n)), "id": rng.permutation(n),
        "v": np.where(rng.random(n) < 0.4, 7.0, np.round(rng.normal(5, 3, n), 2)), "w": rng.integers(-5, 6, n),
    })


def ordered(frame):
    return frame.sort_values(["g", "v", "id"], ignore_index=True)


def test_running(spark, blocks, frame):
    df = spark.createDataFrame(frame)
    out = running(df, ["g"], "v", "id", {"s": ("sum", "w"), "m": ("max", "w"), "n": ("count", F.lit(1))}, {"all": ("sum", "w")}).toPandas()
    want = ordered(frame)
    by = want.groupby("g")["w"]
    want = want.assign(s=by.cumsum(), m=by.cummax(), n=by.cumcount() + 1, all=by.transform("sum"))
    pd.testing.assert_frame_equal(ordered(out)[want.columns], want, check_dtype=False)


def test_ranks(spark, blocks, frame):
    out = rank_counts(spark.createDataFrame(frame), ["g"], "v", "id").toPandas()
    want = ordered(frame)
    by = want.groupby("g")["v"]
    want = want.assign(n_lt=by.rank(method="min") - 1, n_eq=want.groupby(["g", "v"])["v"].transform("count"), n_all=by.transform("count"))
    pd.testing.assert_frame_equal(ordered(out)[want.columns], want, check_dtype=False)


def test_quantiles(spark, blocks, frame):
    probs = [0.0, 0.05, 0.5, 0.77, 1.0]
    got = {(r["g"], r["prob"]): r["q"] for r in quantiles(spark.createDataFrame(frame), ["g"], "v", probs).collect()}
    for g, part in frame.groupby("g"):
        for p in probs:
            assert got[(g, p)] == pytest.approx(np.quantile(part["v"], p))


def test_quantiles_of_columns(spark, blocks, frame):
    got = fit_quantiles(spark.createDataFrame(frame), ["v", "w"], [0.5])
    assert got["v"][0.5] == pytest.approx(frame["v"].median()) and got["w"][0.5] == pytest.approx(frame["w"].median())


def test_blocks_are_bounded(spark, frame):
    spark.conf.set("spark.campanile.rowsPerBlock", "200")
    df = spark.createDataFrame(frame)
    blocks = plan_blocks(df, "v", "id")
    sizes = blocks.attach(df, F.col("v"), F.col("id")).groupBy("__scan_block").count().toPandas()["count"]
    spark.conf.unset("spark.campanile.rowsPerBlock")
    assert sizes.sum() == len(frame) and sizes.max() <= 400


@pytest.mark.parametrize("chunk", [10, 37, 1000])
def test_halo_and_lag(spark, frame, chunk):
    numbered = number_rows(spark.createDataFrame(frame), ["g"], "v", "id")
    got = lagged(numbered, ["g"], "w", "rn", "before", chunk=chunk).toPandas()
    want = ordered(frame)
    want["before"] = want.groupby("g")["w"].shift()
    pd.testing.assert_frame_equal(ordered(got)[["g", "v", "id", "before"]], want[["g", "v", "id", "before"]], check_dtype=False)
    assert with_halo(numbered, "rn", 3, chunk).filter("not is_halo").count() == len(frame)
