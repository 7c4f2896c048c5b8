"""Count-based sliding windows over resampled flights and the labels of windows."""

from pyspark.sql import DataFrame, functions as F

from ..functions.labels import binary_fault
from .joins import attach
from .ordered import explode_range
from .resample import grid_time


def window_shape(win_sec: float, step_sec: float, fs: float) -> tuple[int, int]:
    return int(win_sec * fs), int(step_sec * fs)


def window_count(n, length: int, step: int):
    """Number of windows of an n-point flight: starts stay strictly below n - length."""
    return F.when(n > length, F.ceil((n - length) / F.lit(step))).otherwise(F.lit(0)).cast("long")


def sliding_windows(grid: DataFrame, length: int, step: int) -> DataFrame:
    """Adds window number w and position i; the windows of a point follow from its index, without a shuffle."""
    k, n = F.col("k"), F.col("n")
    low = F.greatest(F.lit(0).cast("long"), F.floor((k - length) / F.lit(step)) + 1)
    high = F.least(F.floor(k / F.lit(step)), window_count(n, length, step) - 1)
    ranged = grid.withColumn("__lo", low).withColumn("__hi", high).where("__lo <= __hi")
    return (
        ranged.withColumn("w", F.explode(F.sequence("__lo", "__hi")))
        .withColumn("i", (k - F.col("w") * step).cast("int"))
        .drop("__lo", "__hi")
    )


def window_centres(spans: DataFrame, length: int, step: int, key="flight_id") -> DataFrame:
    """One row per window with the time of its middle point, from flight spans alone."""
    windows = explode_range(spans, F.lit(0), window_count(F.col("n"), length, step) - 1, "w", keys=[key])
    middle = F.col("w") * step + length // 2
    return windows.withColumn("t", grid_time(middle, F.col("n"), F.col("t0"), F.col("t1")))


def dropped_flights(spans: DataFrame, length: int, step: int) -> DataFrame:
    return spans.where(window_count(F.col("n"), length, step) == 0)


def fault_type_ids(flights: DataFrame) -> DataFrame:
    """(fault_type, type_id): ids by first file name of each type among `flights` (fault_type, file_name)."""
    firsts = flights.groupBy("fault_type").agg(F.min("file_name").alias("first_file"))
    ranked = firsts.agg(F.sort_array(F.collect_list(F.struct("first_file", "fault_type"))).alias("types"))
    return ranked.select(F.posexplode("types").alias("type_id", "type")).select("type.fault_type", "type_id")


def label_windows(windows: DataFrame, flight_labels: DataFrame) -> DataFrame:
    """Spread the labels of a flight over its windows."""
    return attach(windows, flight_labels, "flight_id", spread=["w"])


def window_labels(windows: DataFrame, flight_labels: DataFrame, type_ids: DataFrame) -> DataFrame:
    """(flight_id, w, y_fault, y_type, y_sev)."""
    coded = flight_labels.join(type_ids, "fault_type").select(
        "flight_id",
        binary_fault(F.col("healthy")).alias("y_fault"),
        F.col("type_id").alias("y_type"),
        F.col("severity").alias("y_sev"),
    )
    return label_windows(windows, coded)


def first_windows(windows: DataFrame, count: int, step_sec: float) -> DataFrame:
    """The first `count` windows of the data set with a synthetic clock."""
    head = windows.orderBy("flight_id", "w").limit(count)
    # At most `count` rows reach the index below.
    ordered = head.agg(F.sort_array(F.collect_list(F.struct("flight_id", "w"))).alias("all"))
    return ordered.select(F.posexplode("all").alias("i", "win")).select(
        "i", "win.flight_id", "win.w", (F.col("i") * F.lit(step_sec)).alias("t")
    )


def alignment_report(windows: DataFrame, labels: DataFrame, keys=("flight_id", "w")) -> DataFrame:
    """One row: window and label counts and how many of each lack a partner."""
    left = windows.select(*keys, F.lit(1).alias("has_window")).distinct()
    right = labels.select(*keys, F.lit(1).alias("has_label"))
    both = left.join(right, list(keys), "full_outer")
    return both.agg(
        F.count("has_window").alias("n_windows"),
        F.count("has_label").alias("n_labels"),
        F.count_if(F.col("has_label").isNull()).alias("windows_without_label"),
        F.count_if(F.col("has_window").isNull()).alias("labels_without_window"),
    )


def dataset_shape(windows: DataFrame) -> DataFrame:
    """One row: number of windows, points per window and channels of long window rows."""
    per_window = windows.groupBy("flight_id", "w", "channel").agg(F.count(F.lit(1)).alias("len"))
    per_window = per_window.groupBy("flight_id", "w").agg(
        F.min("len").alias("shortest"), F.max("len").alias("longest"), F.count(F.lit(1)).alias("channels")
    )
    return per_window.agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.min("shortest").alias("min_len"),
        F.max("longest").alias("max_len"),
        F.min("channels").alias("min_channels"),
        F.max("channels").alias("max_channels"),
    )


