"""Stages of Spark ML pipelines that learn from training rows only and can be saved."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params
from pyspark.ml.pipeline import PipelineSharedReadWrite, PipelineWriter
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantile import quantiles
from ..session import cut


class Stored(Params, MLReadable, MLWritable):
    """Settings as Params, named in `SETTINGS`; what was fitted as stages of its own, in the attributes named in `PARTS`. So a stage copies, saves and loads.

    A part is a stage, or a list of stages and numbers.
    """

    SETTINGS: tuple[str, ...] = ()
    PARTS: tuple[str, ...] = ()

    def __init_subclass__(cls, **kwargs):
        super().__init_subclass__(**kwargs)
        for name in cls.SETTINGS:
            setattr(cls, name, Param(Params._dummy(), name, name.replace("_", " ")))

    def _keep(self, **settings) -> None:
        """Set what is given; None leaves a setting as it is not given."""
        for name in self.SETTINGS:
            self._setDefault(**{name: None})
        self._set(**settings)

    def value(self, name: str):
        return self.getOrDefault(self.getParam(name))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, stage: Stored):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        parts = {name: getattr(self.stage, name) for name in self.stage.PARTS}
        number = lambda x: x if isinstance(x, float) else None
        layout = {name: [number(x) for x in part] if isinstance(part, list) else "stage" for name, part in parts.items()}
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession, extraMetadata={"parts": layout})
        for name, part in parts.items():
            for i, one in enumerate(part if isinstance(part, list) else [part]):
                if not isinstance(one, float):
                    one.write().save(f"{path}/{name}_{i}")


class _Reader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> Stored:
        told = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.cls()
        stage._resetUid(told["uid"])
        DefaultParamsReader.getAndSetParams(stage, told)
        part = lambda name, i: DefaultParamsReader.loadParamsInstance(f"{path}/{name}_{i}", self.sparkSession)
        for name, layout in told["parts"].items():
            setattr(stage, name, part(name, 0) if layout == "stage" else [part(name, i) if x is None else float(x) for i, x in enumerate(layout)])
        return stage


def as_array(df: DataFrame, column: str) -> Column:
    """A vector or array column as an array of doubles."""
    return vector_to_array(column) if isinstance(df.schema[column].dataType, VectorUDT) else F.col(column).cast("array<double>")


def literal_array(values: Sequence) -> Column:
    """Numbers as one constant, however many there are."""
    return F.from_json(F.lit(json.dumps(list(values))), "array<double>")


# ---- imputing ---------------------------------------------------------------------------


class MedianFill(Estimator, Stored):
    """Missing places (null or not a number) of a vector get the place's median over the rows it is fitted on; a place without values gets 0.

    Medians are exact. Values of a place are folded to one counted row each before they are ordered, so a frequent value costs one row.
    """

    SETTINGS = ("features", "out")

    def __init__(self, features: str = "features", out: str = "filled"):
        super().__init__()
        self._keep(features=features, out=out)

    def _fit(self, df: DataFrame) -> "MedianFillModel":
        long = df.select(F.posexplode(as_array(df, self.value("features"))).alias("place", "value"))
        width = long.agg(F.max("place")).first()[0]
        found = {r["place"]: r["q"] for r in quantiles(long.filter(~F.isnan("value")), ["place"], "value", [0.5]).collect()}
        return MedianFillModel(self.value("features"), self.value("out"), [found.get(i, 0.0) for i in range(0 if width is None else width + 1)])


class MedianFillModel(Model, Stored):
    SETTINGS = ("features", "out", "medians")

    def __init__(self, features: str = "features", out: str = "filled", medians: Sequence[float] = ()):
        super().__init__()
        self._keep(features=features, out=out, medians=list(medians))

    def _transform(self, df: DataFrame) -> DataFrame:
        fill = lambda x, m: F.when(x.isNull() | F.isnan(x), F.coalesce(m, F.lit(0.0))).otherwise(x)
        return df.withColumn(self.value("out"), array_to_vector(F.zip_with(as_array(df, self.value("features")), literal_array(self.value("medians")), fill)))


# ---- cluster columns and selection -----------------------------------------------------------


class ClusterColumns(Estimator, Stored):
    """One-hot cluster membership, fitted on the rows given, appended to the vector."""

    SETTINGS = ("features", "out", "k", "seed")

    def __init__(self, features: str = "features", out: str = "with_clusters", k: int = 8, seed: int = 42):
        super().__init__()
        self._keep(features=features, out=out, k=k, seed=seed)

    def _fit(self, df: DataFrame) -> "ClusterColumnsModel":
        model = KMeans(featuresCol=self.value("features"), predictionCol="__cluster", k=self.value("k"), seed=self.value("seed")).fit(df)
        return ClusterColumnsModel(model, self.value("features"), self.value("out"), self.value("k"))


class ClusterColumnsModel(Model, Stored):
    SETTINGS = ("features", "out", "k")
    PARTS = ("model",)

    def __init__(self, model=None, features: str = "features", out: str = "with_clusters", k: int = 8):
        super().__init__()
        self.model = model
        self._keep(features=features, out=out, k=k)

    def _transform(self, df: DataFrame) -> DataFrame:
        hot = F.transform(F.sequence(F.lit(0), F.lit(self.value("k") - 1)), lambda i: (i == F.col("__cluster")).cast("double"))
        return self.model.transform(df).withColumn(self.value("out"), array_to_vector(F.concat(vector_to_array(self.value("features")), hot))).drop("__cluster")


class InformationSelector(Estimator, Stored):
    """T5, Z3: keep the positions with most mutual information, with one budget for discrete and one for continuous ones.

    `score_fn(long) -> (feature, mi)` may replace the default scores; a selector with one cannot be saved.
    """

    SETTINGS = ("features", "label", "out", "k", "k_continuous", "discrete")

    def __init__(self, features: str = "features", label: str = "label", out: str = "selected", k: int = 100, k_continuous: int = 1000, discrete: Sequence[int] = (), score_fn=None):
        super().__init__()
        self.score_fn = score_fn
        self._keep(features=features, label=label, out=out, k=k, k_continuous=k_continuous, discrete=list(discrete))

    def write(self) -> MLWriter:
        if self.score_fn is not None:
            raise ValueError("a selector with a function of the caller's cannot be saved")
        return super().write()

    def scores(self, df: DataFrame) -> DataFrame:
        from .features import binned_information, mutual_information

        long = df.select(F.posexplode(vector_to_array(self.value("features"))).alias("feature", "value"), F.col(self.value("label")).alias("label"))
        if self.score_fn is not None:
            return self.score_fn(long)
        is_discrete = F.col("feature").isin(self.value("discrete"))
        return mutual_information(long.filter(is_discrete)).unionByName(binned_information(long.filter(~is_discrete)))

    def _fit(self, df: DataFrame) -> Model:
        # one row per position of the vector
        ranked = sorted(((r["mi"], -r["feature"]) for r in self.scores(df).collect()), reverse=True)
        positions, discrete = [-p for _, p in ranked], set(self.value("discrete"))
        kept = [p for p in positions if p in discrete][: self.value("k")] + [p for p in positions if p not in discrete][: self.value("k_continuous")]
        return VectorSlicer(inputCol=self.value("features"), outputCol=self.value("out"), indices=sorted(kept))


# ---- rows that only training sees ---------------------------------------------------------------


class Oversample(Estimator, Stored):
    """More rows of small classes, for training only. `targets` holds (class, rows); a `TrainingPipeline` calls `resample`, and nothing of it enters the fitted pipeline.

    Fitted by itself it is a stage that passes all rows as they are. Resampled rows have the label, the vector and no other column; `key` names rows and must be unique.
    """

    SETTINGS = ("features", "label", "key", "targets", "neighbours", "seed")

    def __init__(self, features: str = "features", label: str = "label", key: str = "id", targets: Mapping | Sequence[tuple] = (), neighbours: int = 5, seed: int = 42):
        super().__init__()
        pairs = targets.items() if isinstance(targets, Mapping) else targets
        self._keep(features=features, label=label, key=key, targets=[list(p) for p in pairs], neighbours=neighbours, seed=seed)

    def resample(self, df: DataFrame) -> DataFrame:
        from .models import oversample

        features, label, key = self.value("features"), self.value("label"), self.value("key")
        rows = df.select(key, as_array(df, features).alias("__vec"), label)
        made = oversample(rows, key, "__vec", label, {c: n for c, n in self.value("targets")}, self.value("neighbours"), self.value("seed"))
        return made.select(label, array_to_vector("vec").alias(features))

    def _fit(self, df: DataFrame) -> "Unchanged":
        return Unchanged()


class Unchanged(Model, Stored):
    """Rows as they are."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return df


class TrainingPipeline(Pipeline):
    """A pipeline whose stages with `resample` change the rows that later stages learn from, and are left out of what is fitted.

    Fitted on the rows outside a fold, it holds nothing of the fold's rows; rows that are scored are never resampled.
    """

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        fitted, stages = [], self.getStages()
        for i, stage in enumerate(stages):
            if hasattr(stage, "resample"):
                # the stages behind it read the new rows again and again
                dataset = cut(stage.resample(dataset))
                continue
            model = stage if isinstance(stage, Transformer) else stage.fit(dataset)
            fitted.append(model)
            if i + 1 < len(stages):
                dataset = model.transform(dataset)
        return PipelineModel(fitted)

    def write(self) -> MLWriter:
        return PipelineWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _PipelineReader(cls)


class _PipelineReader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TrainingPipeline:
        told = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        uid, stages = PipelineSharedReadWrite.load(told, self.sparkSession, path)
        return self.cls(stages=stages)._resetUid(uid)
