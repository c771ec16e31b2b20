"""Pipelines that learn from training rows only, and what of them can be saved."""

import statistics

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from campanile.operators import models as M
from campanile.operators.stages import InformationSelector, MedianFill, Oversample, TrainingPipeline


@pytest.fixture(scope="module")
def rows(spark):
    """Three classes of 90, 20 and 10 rows; missing places; the fold's rows are far away from the others."""
    n = [0] * 90 + [1] * 20 + [2] * 10
    data = []
    for i, c in enumerate(n):
        fold = i % 3
        far = 1000.0 if fold == 2 else 0.0
        vec = [None if i % 7 == 0 else float(i % 13) + c + far, float("nan") if i % 5 == 0 else c * 2.0 + (i % 4) / 4 + far, 1.0, float(i * 7 % 11)]
        data.append((i, vec, c, float(c), fold))
    return spark.createDataFrame(data, "id long, features array<double>, cls int, y double, fold int").repartition(3).cache()


def test_medians_are_those_of_the_rows_given(rows):
    train = rows.filter("fold <> 2")
    model = MedianFill().fit(train)
    vectors = [r.features for r in train.collect()]
    expected = [statistics.median(v[k] for v in vectors if v[k] is not None and v[k] == v[k]) for k in range(4)]
    assert model.value("medians") == expected and max(expected) < 1000
    filled = model.transform(rows).select("id", "features", vector_to_array("filled").alias("x")).collect()
    assert all(y == (x if x is not None and x == x else m) for r in filled for x, y, m in zip(r.features, r.x, expected))


def test_held_out_rows_enter_no_fitted_value(rows):
    """Fitted values do not change with what the held-out fold holds."""
    options = {"trees": 3, "depth": 2, "clusters": 2, "k_continuous": 3, "targets": {1: 40, 2: 40}, "key": "id"}
    other = rows.withColumn("features", F.when(F.col("fold") == 2, F.transform("features", lambda x: x * -50.0 + 3)).otherwise(F.col("features")))
    scored = []
    for table in (rows, other):
        model = M.assemble("rf_cl_mi", "cls", **options).fit(table.filter("fold <> 2"))
        scored.append({r.id: tuple(r.class_probability) for r in model.transform(rows).collect()})
    assert scored[0] == scored[1]


def test_only_training_rows_are_resampled(rows):
    seen = {}

    class Spy(M.OrdinalForest):
        def _fit(self, df):
            seen.update({r.cls: r["count"] for r in df.groupBy("cls").count().collect()})
            return super()._fit(df)

    stages = [MedianFill(), Oversample("filled", "cls", "id", {1: 50, 2: 7}), Spy("cls", "filled", trees=2, depth=2)]
    train = rows.filter("fold <> 2")
    sizes = {r.cls: r["count"] for r in train.groupBy("cls").count().collect()}
    model = TrainingPipeline(stages=stages).fit(train)
    assert seen == {0: sizes[0], 1: 50, 2: max(7, sizes[2])}
    out = model.transform(rows)
    assert out.count() == 120 and len(model.stages) == 2


@pytest.mark.parametrize("variant", ["rf_cl_mi", "gb_mi"])
def test_saved_pipelines_predict_the_same(rows, variant, tmp_path):
    pipe = M.assemble(variant, "cls", key="id", trees=3, depth=2, least_rows=1, clusters=2, k_continuous=3, targets={2: 30})
    pipe.write().save(f"{tmp_path}/pipe")
    again = TrainingPipeline.load(f"{tmp_path}/pipe")
    assert [type(s) for s in again.getStages()] == [type(s) for s in pipe.getStages()]
    assert again.getStages()[-1].extractParamMap().values() and again.getStages()[-1].value("depth") == 2
    model = pipe.fit(rows)
    model.write().save(f"{tmp_path}/model")
    model.write().overwrite().save(f"{tmp_path}/model")
    loaded = PipelineModel.load(f"{tmp_path}/model")
    told = lambda m: {r.id: (r.prediction, tuple(r.class_probability)) for r in m.transform(rows).collect()}
    assert told(model) == told(loaded) == told(again.fit(rows))


def test_missing_classes_and_copies_of_stages(rows, tmp_path):
    one = rows.filter("cls = 0").select("id", array_to_vector(F.array(F.lit(1.0), F.col("y"))).alias("features"), "cls")
    model = M.OrdinalForest("cls", trees=2, depth=2).fit(one)
    assert model.models == [0.0, 0.0]
    model.write().save(f"{tmp_path}/model")
    assert {r.prediction for r in M.OrdinalForestModel.load(f"{tmp_path}/model").transform(one).collect()} == {0}
    deep = M.OrdinalForest("cls", depth=2)
    assert deep.copy({deep.depth: 5}).value("depth") == 5 and deep.value("depth") == 2
    with pytest.raises(ValueError):
        InformationSelector(score_fn=lambda df: df).write()


def test_parameters_by_variant():
    tuned = {"gb_mi": {"trees": 7, "depth": 3, "least_rows": 1, "step": 0.3, "share": 0.5}}
    assert M.variant_parameters("gb_mi", tuned) == tuned["gb_mi"]
    assert M.variant_parameters("gb", tuned) == M.UNTUNED["gb"] and M.variant_parameters("rf_mi") == M.UNTUNED["rf"]
    names = lambda p: [type(s).__name__ for s in p.getStages()]
    assert names(M.assemble("gb", "cls", key="id")) == ["MedianFill", "VarianceThresholdSelector", "Oversample", "OrdinalBoost"]
    assert names(M.assemble("gb_mi", "y", regression=True, key="id")) == ["MedianFill", "VarianceThresholdSelector", "InformationSelector", "GBTRegressor"]
