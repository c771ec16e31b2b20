"""Correlations by blocks of columns."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from campanile.operators import features as X


def table(spark, n, width, holes, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(1e6, 1, (n, width))
    for j in range(3, width, 4):
        x[:, j] = 1e6 - 2 * (x[:, j - 2] - 1e6) + rng.normal(0, 0.05, n)
    x[:, width // 2] = 0.1
    if holes:
        x[rng.random(x.shape) < 0.1] = np.nan
    vec = F.transform("x", lambda v: F.when(~F.isnan(v), v))
    return x, spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(3).select(vec.alias("x"))


@pytest.mark.parametrize("holes", [False, True])
@pytest.mark.parametrize("block,size", [(4, 1), (5, 1 << 28)])
def test_blocks_equal_brute_force(spark, monkeypatch, holes, block, size):
    monkeypatch.setattr(X.correlation_blocks, "__defaults__", (block,))
    monkeypatch.setattr(X, "PRODUCT_BYTES", size)
    x, df = table(spark, 60, 11, holes)
    want = pd.DataFrame(x).corr().to_numpy()
    got = {(r.i, r.j): r.r for r in X.correlations(df, "x").collect()}
    assert sorted(got) == [(i, j) for i in range(11) for j in range(i + 1, 11)]
    for (i, j), r in got.items():
        if 11 // 2 in (i, j):
            assert r is None
        else:
            assert r == pytest.approx(want[i, j], abs=1e-6)


def test_many_columns_in_bounded_parts(spark):
    """A thousand columns are four blocks; the dropped ones are those of the matrix made at once."""
    x, df = table(spark, 150, 1000, False, seed=2)
    want = np.abs(np.corrcoef(np.delete(x, 500, 1), rowvar=False))
    want = np.insert(np.insert(want, 500, 0, 0), 500, 0, 1)
    dropped = {j for j in range(1000) if (want[:j, j] > 0.95).any()}
    found = X.correlated_columns(df, "x", 0.95)
    assert {int(r.column) for r in found.collect()} == dropped and len(dropped) > 200


def test_named_columns_no_rows_and_one_column(spark):
    df = spark.createDataFrame([(1.0, 2, None), (2.0, 4, 1.0), (3.0, 6, None)], "a double, b int, c double")
    assert [(r.column, round(r.max_r, 6)) for r in X.correlated_columns(df, ["a", "b", "c"], 0.9).collect()] == [("b", 1.0)]
    assert X.correlated_columns(df.limit(0), ["a", "b"]).count() == 0
    assert X.correlations(df, ["a"]).count() == 0
