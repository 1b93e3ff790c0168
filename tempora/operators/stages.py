"""T6/T7 as ``pyspark.ml`` stages: the preprocessor and the library's learners inside a ``Pipeline``.

``FeatureStage`` (an Estimator) fits a ``Preprocessor`` and ``LearnerStage`` one model for
all horizons; their models are Transformers.  All four are written and read by a Pipeline's own
writer: parameters as metadata, the fitted state beside them in the formats of
``PreprocessorModel.save`` and ``sources.store``.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.operators import learners as ln
from tempora.operators.boosting import BoostedTrees, Boosting
from tempora.operators.preprocess import Preprocessor, PreprocessorModel


class _StateWriter(MLWriter):
    """Parameters as Spark's metadata, then the state that the model writes itself."""

    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance._write_state(f"{path}/state", self.sparkSession)


class _StateReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = self.cls()
        out._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        out._read_state(f"{path}/state", self.sparkSession)
        return out


class _Stateful(MLWritable, MLReadable):
    def write(self) -> MLWriter:
        return _StateWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StateReader(cls)


class _FeatureParams(Params):
    numericCols = Param(Params._dummy(), "numericCols", "numeric columns", TypeConverters.toListString)
    categoricalCols = Param(Params._dummy(), "categoricalCols", "categorical columns", TypeConverters.toListString)
    textCols = Param(Params._dummy(), "textCols", "text columns; the first is used", TypeConverters.toListString)
    maxFeatures = Param(Params._dummy(), "maxFeatures", "terms of the text vocabulary", TypeConverters.toInt)
    outputCol = Param(Params._dummy(), "outputCol", "feature vector column", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(numericCols=[], categoricalCols=[], textCols=[], maxFeatures=100, outputCol="features")


class FeatureStage(Estimator, _FeatureParams, DefaultParamsWritable, DefaultParamsReadable):
    """Median imputation and scaling, mode imputation and one-hot, TF-IDF, one vector."""

    @keyword_only
    def __init__(self, *, numericCols=None, categoricalCols=None, textCols=None, maxFeatures=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "FeatureStageModel":
        g = self.getOrDefault
        state = Preprocessor(g("numericCols"), g("categoricalCols"), g("textCols"), g("maxFeatures"), g("outputCol")).fit(dataset)
        return self._copyValues(FeatureStageModel(state))


class FeatureStageModel(Model, _FeatureParams, _Stateful):
    """Appends the feature vector; the input's columns stay."""

    def __init__(self, state: PreprocessorModel | None = None):
        super().__init__()
        self.state = state

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.state.transform(dataset)

    def _write_state(self, path: str, spark) -> None:
        self.state.save(path, spark)

    def _read_state(self, path: str, spark) -> None:
        self.state = PreprocessorModel.load(path, spark)


class _LearnerParams(Params):
    learner = Param(Params._dummy(), "learner", "bayes_ridge, huber or boosted_trees", TypeConverters.toString)
    settings = Param(Params._dummy(), "settings", "the learner's settings, as JSON", TypeConverters.toString)
    targetCols = Param(Params._dummy(), "targetCols", "one column per horizon", TypeConverters.toListString)
    featuresCol = Param(Params._dummy(), "featuresCol", "feature vector column", TypeConverters.toString)
    predictionCols = Param(Params._dummy(), "predictionCols", "one column per target", TypeConverters.toListString)

    def __init__(self):
        super().__init__()
        self._setDefault(learner="bayes_ridge", settings="{}", featuresCol="features")

    def predicted(self) -> list[str]:
        return self.getOrDefault("predictionCols") if self.isDefined("predictionCols") else [f"prediction_{t}" for t in self.getOrDefault("targetCols")]


class LearnerStage(Estimator, _LearnerParams, DefaultParamsWritable, DefaultParamsReadable):
    """M1, M2 or M5 for all targets; rows with a NULL target are left out (boosted trees: of that target)."""

    @keyword_only
    def __init__(self, *, learner=None, settings=None, targetCols=None, featuresCol=None, predictionCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "LearnerStageModel":
        kind, targets, features = (self.getOrDefault(p) for p in ("learner", "targetCols", "featuresCol"))
        settings = json.loads(self.getOrDefault("settings"))
        whole = dataset.dropna(subset=targets)
        if kind == "bayes_ridge":
            fitted = ln.fit_bayesian_ridge(whole, targets, features, **settings)
        elif kind == "huber":
            fitted = ln.fit_huber(whole.withColumn(ln.FIT, F.lit(0)), targets, ln.Huber(**settings), ln.FIT, features)[0]
        elif kind == "boosted_trees":
            fitted = ln.fit_boosters(dataset, targets, Boosting(**settings), None, features)[0]
        else:
            raise ValueError(f"unknown learner {kind!r}")
        return self._copyValues(LearnerStageModel(fitted))


class LearnerStageModel(Model, _LearnerParams, _Stateful):
    """Appends one prediction column per target."""

    def __init__(self, fitted=None):
        super().__init__()
        self.fitted = fitted

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if isinstance(self.fitted, BoostedTrees):
            return self.fitted.with_predictions(dataset, self.predicted())
        return dataset.select("*", *self.fitted.predict_cols(self.predicted()))

    def _write_state(self, path: str, spark) -> None:
        if isinstance(self.fitted, BoostedTrees):
            self.fitted.save(path, spark)
            return
        rows = [(j, float(self.fitted.intercept[j]), [float(v) for v in self.fitted.coef[:, j]]) for j in range(len(self.fitted.intercept))]
        spark.createDataFrame(rows, "target int, intercept double, coef array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    def _read_state(self, path: str, spark) -> None:
        import numpy as np
        if self.getOrDefault("learner") == "boosted_trees":
            self.fitted = BoostedTrees.load(path, spark)
            return
        rows = spark.read.parquet(path).orderBy("target").collect()      # one row per target
        self.fitted = ln.BayesianRidgeModel(np.array([r["coef"] for r in rows]).T, np.array([r["intercept"] for r in rows]),
                                            self.getOrDefault("featuresCol"))
