"""From recordings to labelled windows and features, as one lazy plan."""

from pyspark.sql import DataFrame

from ..operators.features import wide_window_features
from ..operators.resample import flight_spans, resample
from ..operators.scaling import channel_stats, normalise, to_long
from ..operators.windows import (
    dropped_flights,
    fault_type_ids,
    sliding_windows,
    window_centres,
    window_labels,
    window_shape,
)
from ..session import stored
from ..settings import STEP_SEC, TARGET_FS, WIN_SEC
from ..sources.dataset import Dataset


def normalised_grid(samples: DataFrame, channels, stats=None, fs=TARGET_FS, tie=()) -> DataFrame:
    """(flight_id, k, n, t, channels): resampled and scaled recordings; statistics of all flights unless given.

    Without `stats` the resampled recordings are stored, and the statistics and the rows are both read from there. Of
    samples with equal times the last by `tie` counts.
    """
    grid = resample(samples, fs, channels, tie=tie)
    if stats is None:
        grid = stored(grid, "grid")
        stats = channel_stats(grid, channels)
    return normalise(grid, stats, channels)


def normalised_windows(samples: DataFrame, channels, stats=None, fs=TARGET_FS, win=WIN_SEC, step=STEP_SEC, tie=()) -> DataFrame:
    """(flight_id, w, i, channel, value): the windows as long rows."""
    return long_windows(normalised_grid(samples, channels, stats, fs, tie), channels, fs, win, step)


def long_windows(grid: DataFrame, channels, fs=TARGET_FS, win=WIN_SEC, step=STEP_SEC) -> DataFrame:
    return to_long(sliding_windows(grid, *window_shape(win, step, fs)), ["flight_id", "w", "i"], channels)


def prepare(samples: DataFrame, flight_labels: DataFrame, channels, fs=TARGET_FS, win=WIN_SEC, step=STEP_SEC, tie=()) -> Dataset:
    """The whole preparation: windows, window labels, statistics and type ids; the recordings are resampled once."""
    grid = stored(resample(samples, fs, channels, tie=tie), "grid")
    stats = channel_stats(grid, channels)
    windows = long_windows(normalise(grid, stats, channels), channels, fs, win, step)
    spans, shape = flight_spans(samples, fs), window_shape(win, step, fs)
    present = flight_labels.join(dropped_flights(spans, *shape), "flight_id", "left_anti")
    types = fault_type_ids(present)
    # The list of windows follows from the flights' spans; the windows need not be built for it.
    listed = window_centres(spans, *shape).select("flight_id", "w")
    return Dataset(windows, window_labels(listed, present, types), stats, types)


def window_features(samples: DataFrame, channels, stats=None, fs=TARGET_FS, win=WIN_SEC, step=STEP_SEC, tie=()) -> DataFrame:
    """One wide feature row per window."""
    return wide_window_features(normalised_grid(samples, channels, stats, fs, tie), channels, *window_shape(win, step, fs), fs)


def labelled_features(features: DataFrame, labels: DataFrame) -> DataFrame:
    return features.join(labels.select("flight_id", "w", "y_fault", "y_type", "y_sev"), ["flight_id", "w"])


