"""Scoring of whole flights with a fitted model."""

from pyspark.sql import DataFrame

from ..operators.models import inputs, predict
from ..operators.resample import flight_spans
from ..operators.windows import window_centres, window_shape
from ..settings import STEP_SEC, TARGET_FS, WIN_SEC
from .prepare import window_features


def score_flights(samples: DataFrame, stats: DataFrame, model, channels, fs=TARGET_FS, win=WIN_SEC,
                  step=STEP_SEC, tie=()) -> DataFrame:
    """Resample, align, normalise, cut, describe and predict: one row per window with its centre time.

    Channels the recordings have but the model was not trained on are dropped.
    """
    trained = set(inputs(model))
    used = [c for c in channels if f"{c}_mean" in trained]
    features = window_features(samples, used, stats, fs, win, step, tie)
    centres = window_centres(flight_spans(samples, fs), *window_shape(win, step, fs)).select("flight_id", "w", "t")
    return predict(model, features).join(centres, ["flight_id", "w"])
