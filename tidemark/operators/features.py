"""Features from the past of a series and targets from its near future, by window functions.

A feature at t uses observations before t; the target at t is the mean of the ``horizon``
observations from t on, t included. Both windows share one exchange and sort by series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import one_hot
from .ordered import row_windows

#: Observations that a feature needs.
WARM_UP = 20
FEATURES = [f"f{i}" for i in range(10)]


def _series() -> Window:
    return Window.partitionBy("series_id").orderBy("t")


def _feature_columns(w: WindowSpec) -> list:
    columns = [
        F.lag("value", 1).over(w),
        F.avg("value").over(w.rowsBetween(-5, -1)),
        F.avg("value").over(w.rowsBetween(-WARM_UP, -1)),
        F.sin(F.col("t") / 8),
        F.cos(F.col("t") / 8),
        *(one_hot(F.col("series_pos"), k) for k in range(1, 6)),
    ]
    return [F.count("value").over(w.rowsBetween(-WARM_UP, -1)).alias("n_past"), *(c.alias(n) for n, c in zip(FEATURES, columns, strict=True))]


def _target_columns(w: WindowSpec, horizon: int) -> list:
    ahead = w.rowsBetween(0, horizon - 1)
    return [F.avg("value").over(ahead).alias("y"), F.count("value").over(ahead).alias("n_ahead")]


def with_features(obs: DataFrame) -> DataFrame:
    """(series_id, series_pos, t, f0..f9): last value, means of 5 and 20, the cycle's sine and cosine, series 1 to 5."""
    return obs.select("series_id", "series_pos", "t", *_feature_columns(_series())).where(F.col("n_past") == WARM_UP).drop("n_past")


def with_targets(obs: DataFrame, horizon: int) -> DataFrame:
    """(series_id, series_pos, t, y) for every t with ``horizon`` observations ahead."""
    return obs.select("series_id", "series_pos", "t", *_target_columns(_series(), horizon)).where(F.col("n_ahead") == horizon).drop("n_ahead")


def _ready(both: DataFrame, horizon: int, delay: int) -> DataFrame:
    ready = both.where((F.col("n_past") == WARM_UP) & (F.col("n_ahead") == horizon)).drop("n_past", "n_ahead")
    return ready.withColumn("released_day", F.col("t") + horizon + delay)


def label_rows(obs: DataFrame, horizon: int, delay: int) -> DataFrame:
    """Features, target and release day of every t that has both, from one sort of each series."""
    w = _series()
    return _ready(obs.select("series_id", "series_pos", "t", *_feature_columns(w), *_target_columns(w, horizon)), horizon, delay)


def long_label_rows(obs: DataFrame, horizon: int, delay: int, size: int = 100_000, at: str | None = None) -> DataFrame:
    """The same for series of any length: each is cut into blocks of ``size`` steps with the steps around them that frames reach, a task each."""
    place = [at] * (at is not None and at != "t")
    kept = ["series_id", "series_pos", "t", "value", *place]
    made = row_windows(obs.select(*kept), ["series_id"], ["t"], lambda w: [*_feature_columns(w), *_target_columns(w, horizon)], WARM_UP, horizon - 1, size, at)
    return _ready(made.drop("value", *place), horizon, delay)
