"""Monitoring queries over scored windows."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.labels import decoded_fault_name
from ..functions.numeric import ratio, severity_level
from ..settings import TABLE_WINDOWS
from .joins import attach
from .ordered import explode_range, running_sums

FLIGHT = ("model", "flight_id")


def postprocess(scored: DataFrame, threshold=0.5) -> DataFrame:
    """From (fault_prob, fault_type, severity_continuous): label, severity level and type name."""
    return scored.withColumns(
        {
            "fault_label": (F.col("fault_prob") >= threshold).cast("int"),
            "severity_level": severity_level(F.col("severity_continuous")),
            "fault_type_name": decoded_fault_name(F.col("fault_type")),
        }
    )


def flight_kpis(predictions: DataFrame, by=FLIGHT) -> DataFrame:
    return predictions.groupBy(*by).agg(
        F.avg("fault_prob").alias("avg_fault_prob"),
        F.avg("fault_label").alias("faulty_share"),
        F.avg("severity_level").alias("avg_severity"),
        F.count(F.lit(1)).alias("n_windows"),
    )


def severity_distribution(predictions: DataFrame, by=FLIGHT) -> DataFrame:
    return predictions.groupBy(*by, "severity_level").agg(F.count(F.lit(1)).alias("n")).orderBy(*by, "severity_level")


def timeline(centres: DataFrame, predictions: DataFrame, by=FLIGHT) -> DataFrame:
    """(by, w, t, severity_level, fault_prob, fault_label): predictions put on the clock of the windows."""
    scores = predictions.select(*by, "w", "severity_level", "fault_prob", F.col("fault_label").cast("double").alias("fault_label"))
    return centres.select("flight_id", "w", "t").join(scores, ["flight_id", "w"]).select(
        *by, "w", "t", "severity_level", "fault_prob", "fault_label"
    )


def timeline_until(timeline_rows: DataFrame, step: int) -> DataFrame:
    """What the timeline shows once window `step` has been seen."""
    return timeline_rows.where(F.col("w") <= step)


def cumulative_status(predictions: DataFrame, by=FLIGHT, chunk=4096) -> DataFrame:
    """Per window: windows seen so far, share of faulty ones and mean probability up to it."""
    rows = predictions.select(*by, "w", "t", "fault_prob", F.col("fault_label").cast("long").alias("fault_label"))
    rows = rows.withColumn("one", F.lit(1).cast("long"))
    names = {"one": "seen", "fault_label": "faulty", "fault_prob": "prob_sum"}
    run = running_sums(rows, by, ["w"], F.floor(F.col("w") / chunk), names)
    return run.select(
        *by, "w", "t", "seen", "faulty",
        ratio(F.col("faulty"), F.col("seen")).alias("faulty_share"),
        (F.col("prob_sum") / F.col("seen")).alias("mean_prob"),
    )


def nearest_window(requests: DataFrame, centres: DataFrame) -> DataFrame:
    """(request columns, w, t, gap): the window whose centre is nearest to `asked`, the earliest on ties.

    Every request has its row: equal ones each their own, and one for a flight without windows has NULLs.
    Window centres are evenly spaced, so the candidate follows by arithmetic from the flight's first and last
    centre; it and its two neighbours are looked up by key.
    """
    spans = centres.groupBy("flight_id").agg(
        F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.max("w").alias("last_w")
    )
    spacing = (F.col("last_t") - F.col("first_t")) / F.when(F.col("last_w") > 0, F.col("last_w"))
    guess = F.coalesce(F.round((F.col("asked") - F.col("first_t")) / spacing), F.lit(0)).cast("long")
    around = F.array(*[F.greatest(F.lit(0), F.least(F.col("last_w"), guess + d)) for d in (-1, 0, 1)])
    kinds = requests.groupBy(*requests.columns).agg(F.count(F.lit(1)).alias("__n"))
    asked = attach(kinds, spans, "flight_id", "left", spread=requests.columns).withColumn("w", F.explode(F.array_distinct(around)))
    found = asked.select(*requests.columns, "__n", "w").join(centres.select("flight_id", "w", "t"), ["flight_id", "w"], "left")
    near = F.when(F.col("t").isNotNull(), F.struct(F.abs(F.col("t") - F.col("asked")).alias("gap"), "w", "t"))
    best = found.groupBy(*requests.columns, "__n").agg(F.min(near).alias("b"))
    return explode_range(best, F.lit(1), F.col("__n"), "__k").select(*requests.columns, "b.w", "b.t", "b.gap")


def marked_trajectory(positions: DataFrame, predictions: DataFrame, columns, by=FLIGHT) -> DataFrame:
    """Trajectory points joined to their window: normal or faulty, marker size by severity."""
    points = positions.withColumnRenamed("i", "w").select("flight_id", "w", *columns)
    joined = points.join(predictions.select(*by, "w", "fault_label", "severity_level"), ["flight_id", "w"])
    faulty = F.col("fault_label") == 1
    return joined.select(
        *by, "w", *columns,
        F.when(faulty, "fault").otherwise("normal").alias("segment"),
        F.when(faulty, F.col("severity_level") * 2 + 5).otherwise(3).alias("marker_size"),
    )


def first_predictions(predictions: DataFrame, count=TABLE_WINDOWS, by=FLIGHT) -> DataFrame:
    """The first `count` windows of every model and flight."""
    place = F.row_number().over(W.partitionBy(*by).orderBy("w"))
    head = predictions.withColumn("__place", place).where(F.col("__place") <= count)
    return head.select("model", "flight_id", "w", "fault_prob", "fault_label", "fault_type_name", "severity_level")


def overview_channels(columns, time="t", count=3) -> list[str]:
    """The first main-group channels, else the first ones of any group."""
    others = [c for c in columns if c != time]
    return [c for c in others if c.startswith("q_")][:count] or others[:count]


def signal_overview(wide: DataFrame, ids=("flight_id",), time="t") -> DataFrame:
    channels = overview_channels([c for c in wide.columns if c not in ids], time)
    return wide.select(*ids, time, *channels)


def status_text(label: Column) -> Column:
    return F.when(label == 1, "FAULT").otherwise("NORMAL")


def live_status(predictions: DataFrame, limit: int | None = None) -> DataFrame:
    """The status row of each window of a flight, or of its windows before number `limit`."""
    kind = F.when(F.col("fault_label") == 1, F.col("fault_type")).otherwise(0)
    shown = predictions if limit is None else predictions.where(F.col("w") < limit)
    return shown.select(
        "model", "flight_id", "w", "t", status_text(F.col("fault_label")).alias("status"), "severity_level",
        kind.alias("fault_group"), "fault_type_name", "fault_prob",
    )
