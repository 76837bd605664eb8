"""Features, whitening and all models of the registry as Spark ML stages, so that they go in one Pipeline that is fitted, saved and loaded as a whole.

Stages work on rows of recordings (clip_id, t, label where a model needs it, channels or a vector `features`).
"""

from __future__ import annotations

import json
from typing import Any

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.feature import StandardScalerModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import models
from .features import feature_set
from .signal import Whitening


class _Kept(Model, MLWritable, MLReadable):
    """A fitted stage: its Params, and what it keeps below its own folder."""

    def _write(self, path: str) -> None:
        raise NotImplementedError

    def _read(self, path: str) -> None:
        raise NotImplementedError

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, stage: _Kept):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.stage._write(f"{path}/kept")


class _Reader(MLReader):
    def __init__(self, kind: type[_Kept]):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> _Kept:
        told = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.kind()
        stage._resetUid(told["uid"])
        DefaultParamsReader.getAndSetParams(stage, told)
        stage._read(f"{path}/kept")
        return stage


class FramedFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds `features`, the whole feature set of the rows around each row (features.py), of channels; values that aren't numbers count as 0."""

    channels = Param(Params._dummy(), "channels", "the channels in the schema's order", TypeConverters.toListString)
    half = Param(Params._dummy(), "half", "rows on either side of a row", TypeConverters.toInt)
    dynamicOnly = Param(Params._dummy(), "dynamicOnly", "whether acceleration is dynamic already", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, channels: list[str] | None = None, half: int = 5, dynamicOnly: bool = True):
        super().__init__()
        self._setDefault(half=5, dynamicOnly=True)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        d = feature_set(dataset, self.getOrDefault(self.channels), self.getOrDefault(self.half), dynamic_only=self.getOrDefault(self.dynamicOnly))
        names = [c for c in d.columns if c not in ("clip_id", "t", "individual_id", "label")]
        value = [F.when(F.col(f"`{c}`").isNull() | F.isnan(f"`{c}`"), 0.0).otherwise(F.col(f"`{c}`").cast("double")) for c in names]
        return dataset.join(d.select("clip_id", "t", array_to_vector(F.array(*value)).alias("features")), ["clip_id", "t"])


class Whiten(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Whitens `features` in place: principal components of unit variance; components 0 lets Minka's choice decide how many."""

    components = Param(Params._dummy(), "components", "components to keep; 0: by Minka's choice", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, components: int = 0):
        super().__init__()
        self._setDefault(components=0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> Whitened:
        out = Whitened()
        out.white = Whitening(self.getOrDefault(self.components) or "mle").fit(dataset)
        return out


class Whitened(_Kept):
    white: Whitening | None = None

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.white.transform(dataset, "_white").drop("features").withColumnRenamed("_white", "features")

    def _write(self, path: str) -> None:
        from pyspark.sql import SparkSession

        models.write_about(SparkSession.active(), {"matrix": self.white.matrix.tolist()}, path)
        self.white.scaler.write().overwrite().save(f"{path}/scaler")

    def _read(self, path: str) -> None:
        from pyspark.sql import SparkSession

        self.white = Whitening()
        self.white.matrix, self.white.scaler = np.array(models.read_about(SparkSession.active(), path)["matrix"]), StandardScalerModel.load(f"{path}/scaler")


class Behaviour(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """A model of the registry by name, with its settings; fitted on rows with `features` (and `label`, 0 where unknown, if it is supervised)."""

    model = Param(Params._dummy(), "model", "name in the registry", TypeConverters.toString)
    clusters = Param(Params._dummy(), "clusters", "classes or clusters", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)
    settings = Param(Params._dummy(), "settings", "the model's settings, as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, model: str | None = None, clusters: int | None = None, seed: int = 0, settings: dict[str, Any] | str = "{}"):
        super().__init__()
        self._setDefault(seed=0, settings="{}")
        given = {k: v for k, v in self._input_kwargs.items() if v is not None}
        if isinstance(given.get("settings"), dict):
            given["settings"] = json.dumps(given["settings"])
        self._set(**given)

    def _fit(self, dataset: DataFrame) -> Fitted:
        out = Fitted()
        m = models.model(self.getOrDefault(self.model), self.getOrDefault(self.clusters), self.getOrDefault(self.seed), **json.loads(self.getOrDefault(self.settings)))
        out.fitted = m.fit(dataset.where("label <> 0") if isinstance(m, models._Supervised) else dataset)
        return out


class Fitted(_Kept):
    """Adds `pred`."""

    fitted: models.BehaviourModel | None = None

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fitted.predict(dataset)

    def _write(self, path: str) -> None:
        self.fitted.save(path)

    def _read(self, path: str) -> None:
        self.fitted = models.load(path)
