"""A classic model on framed features: balance, features of every row's window, fit on annotated rows, predict every row."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames as fr
from . import models, signal
from .features import feature_set

KEYS = ("clip_id", "t", "individual_id", "label")


class Classic:
    """A model of the registry with settings as config.with_defaults() gives them.

    channels: the schema's channels. static, dynamic: columns of each accelerometer channel's parts; with dynamic_only the channels are dynamic already.
    With the feature set `wavelet` the channels are taken as they stand (see signal.py for the transform); else normalize scales acceleration
    by each clip's field strength. Windows are cut off at a clip's ends, and hold three rows at least. Features that aren't numbers count as 0.
    downsizing_factor thins out the annotated rows of a fit that isn't balanced.
    """

    def __init__(self, name: str, channels: Sequence[str], known: Sequence[int], sr: float, settings: Mapping[str, Any], seed: int = 0, balance: bool = False, static: Mapping[str, str] | None = None, dynamic: Mapping[str, str] | None = None, dynamic_only: bool = False):
        self.name, self.sr = name, sr
        self.channels, self.known, self.settings, self.seed, self.balance = list(channels), list(known), dict(settings), seed, balance
        self.parts = {"static": static, "dynamic": dynamic, "dynamic_only": dynamic_only}
        self.half = max(math.ceil(settings.get("context_window_sec", 1) * sr), 3) // 2
        self.model = models.model(name, len(self.known), seed, **self.settings)

    def vectors(self, frames: DataFrame) -> DataFrame:
        """The key columns and the vector `features` of each row; windows see all rows of their clip, annotated or not."""
        from pyspark.ml.functions import array_to_vector

        if self.settings.get("feature_set", "nathan2012") == "wavelet":
            d = frames
            names = self.channels
        else:
            d = feature_set(self._scaled(frames), self.channels, self.half, **self.parts)
            names = [c for c in d.columns if c not in KEYS]
        value = [F.when(F.col(f"`{c}`").isNull() | F.isnan(f"`{c}`"), 0.0).otherwise(F.col(f"`{c}`").cast("double")) for c in names]
        return d.select(*(c for c in KEYS if c in d.columns), array_to_vector(F.array(*value)).alias("features"))

    def _scaled(self, frames: DataFrame) -> DataFrame:
        if not self.settings.get("normalize"):
            return frames
        split = [self.parts["static"], self.parts["dynamic"]]
        parts = {c: [p[c] for p in split] for c in self.channels if "Acc" in c} if all(split) else None
        return signal.scale_acceleration(frames, self.channels, parts)

    def fit(self, frames: DataFrame) -> Classic:
        """frames: rows of the training clips with labels, 0 where unknown. With balance, rows beyond an individual's smallest class count as unknown."""
        marked = fr.balanced_mask(frames, self.known) if self.balance else frames
        rows = fr.annotated(self.vectors(marked))
        step = int(self.settings.get("downsizing_factor", 1))
        rows = fr.every_nth_annotated(rows, step) if step > 1 and not self.balance else rows
        self.model.fit(rows)
        return self

    def predict(self, frames: DataFrame) -> DataFrame:
        """clip_id, t, pred for every row."""
        return self.model.predict(self.vectors(frames)).select("clip_id", "t", "pred")

    def save(self, path: str, spark: SparkSession | None = None) -> None:
        """Write all that load() needs below path."""
        spark = spark or SparkSession.active()
        about = {"name": self.name, "channels": self.channels, "known": self.known, "sr": self.sr, "settings": self.settings, "seed": self.seed, "balance": self.balance, **self.parts}
        models.write_about(spark, about, path)
        self.model.save(f"{path}/model", spark)

    @classmethod
    def load(cls, path: str, spark: SparkSession | None = None) -> Classic:
        """What save() wrote."""
        spark = spark or SparkSession.active()
        m = cls(**models.read_about(spark, path))
        m.model = models.load(f"{path}/model", spark)
        return m
