import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from faultframe.operators import asof, models, monitor as mon
from faultframe.operators.scaling import channel_stats
from faultframe.plans.prepare import labelled_features, window_features
from faultframe.plans.score import score_flights
from faultframe.streaming import live


def scored(spark, n=20, flight="a"):
    rows = [("m", flight, w, w * 0.5, (w % 4) / 4, int(w % 4 >= 2), w % 4, 1, "crack") for w in range(n)]
    return spark.createDataFrame(
        rows,
        "model string, flight_id string, w long, t double, fault_prob double, fault_label int, severity_level int, fault_type int, fault_type_name string",
    )


def test_kpis_and_distribution(spark, rows):
    p = scored(spark)
    k = mon.flight_kpis(p).first()
    assert (k.avg_fault_prob, k.faulty_share, k.avg_severity, k.n_windows) == (0.375, 0.5, 1.5, 20)
    assert [tuple(r)[2:] for r in mon.severity_distribution(p).collect()] == [(0, 5), (1, 5), (2, 5), (3, 5)]


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_cumulative_status(spark, chunk):
    found = mon.cumulative_status(scored(spark), chunk=chunk).toPandas().sort_values("w")
    label = (np.arange(20) % 4 >= 2).astype(int)
    assert found.seen.to_list() == list(range(1, 21))
    assert np.allclose(found.faulty_share, label.cumsum() / np.arange(1, 21))
    assert np.allclose(found.mean_prob, ((np.arange(20) % 4) / 4).cumsum() / np.arange(1, 21))


def test_timeline(spark, rows):
    centres = scored(spark).select("flight_id", "w", (F.col("t") + 100).alias("t"))
    line = mon.timeline(centres, scored(spark).drop("t"))
    assert line.count() == 20 and mon.timeline_until(line, 4).count() == 5
    assert line.where("w = 3").first().t == 101.5


def test_nearest_window(spark, rows):
    centres = spark.createDataFrame([("a", w, 1.0 + w) for w in range(5)] + [("b", 0, 2.0)], "flight_id string, w long, t double")
    asked = [(1, "a", -9.0), (2, "a", 1.5), (3, "a", 2.5), (4, "a", 3.51), (5, "a", 99.0), (6, "b", 0.0)]
    requests = spark.createDataFrame(asked, "id int, flight_id string, asked double")
    assert rows(mon.nearest_window(requests, centres), "id", "w") == [(1, 0), (2, 0), (3, 1), (4, 3), (5, 4), (6, 0)]


@pytest.mark.parametrize("chunk_rows, fan", [(50_000, 4096), (5, 3)])
def test_nearest_in_uneven_time(spark, monkeypatch, chunk_rows, fan):
    monkeypatch.setattr(asof, "CHUNK_ROWS", chunk_rows)
    monkeypatch.setattr(asof, "FAN", fan)
    rng = np.random.default_rng(3)
    times = {"a": [0.0, 1.0, 2.0, 3.0, 100.0], "b": np.round(rng.exponential(5, 200).cumsum(), 1).tolist(), "c": [7.0], "d": [2.0, 2.0, 2.0]}
    points = [(k, i, float(t)) for k, part in times.items() for i, t in enumerate(part)] + [("a", 99, None)]
    asked = [("a", 2.9), ("a", 51.5), ("a", 51.6), ("a", -5.0), ("a", 1.5), ("a", 1.5), ("d", 9.0), ("none", 1.0), ("c", None), (None, 1.0)]
    asked += [("b", float(t)) for t in np.round(rng.uniform(-50, 1200, 300), 1)]
    frame = spark.createDataFrame(points, "flight_id string, w long, t double")
    requests = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "id int, flight_id string, asked double")
    got = {r.id: (r.w, r.t) for r in asof.nearest_in_time(requests, frame).collect()}
    assert len(got) == len(asked)
    for i, (k, t) in enumerate(asked):
        own = [(abs(x - t), x, w) for key, w, x in points if key == k and x is not None and t is not None]
        assert got[i] == ((min(own)[2], min(own)[1]) if own else (None, None)), (k, t)
    same = spark.createDataFrame([("a", 1.2)] * 4, "flight_id string, asked double")
    assert [r.w for r in asof.nearest_in_time(same, frame).collect()] == [1] * 4


def test_many_requests_of_few_rows_are_read_in_linear_time(spark, monkeypatch):
    monkeypatch.setattr(asof, "CHUNK_ROWS", 50)
    points = [(0, 0.0), (1, 3.0), (2, 3.5), (3, 40.0)]
    frame = spark.createDataFrame([("a", w, t) for w, t in points], "flight_id string, w long, t double")
    requests = spark.range(600).select("id", F.lit("a").alias("flight_id"), (F.col("id") * 0.1 - 5).alias("asked"))
    found = asof.nearest_in_time(requests, frame)
    # Spark goes through a frame up to the last row once for every row.
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    assert {r.id: r.w for r in found.collect()} == {i: min((abs(t - (i * 0.1 - 5)), t, w) for w, t in points)[2] for i in range(600)}


def test_every_request_has_a_row(spark):
    centres = spark.createDataFrame([("a", w, 1.0 + w) for w in range(5)], "flight_id string, w long, t double")
    requests = spark.createDataFrame([("a", 2.2), ("a", 2.2), ("none", 1.0)], "flight_id string, asked double")
    found = sorted((r.flight_id, r.w is None, r.w or 0) for r in mon.nearest_window(requests, centres).collect())
    assert found == [("a", False, 1), ("a", False, 1), ("none", True, 0)]


def test_marked_trajectory(spark, rows):
    positions = spark.createDataFrame([("a", i, float(i)) for i in range(3)], "flight_id string, i long, x double")
    found = mon.marked_trajectory(positions, scored(spark), ["x"])
    assert rows(found, "w", "x", "segment", "marker_size") == [(0, 0.0, "normal", 3), (1, 1.0, "normal", 3), (2, 2.0, "fault", 9)]


def test_overview_channels(spark):
    assert mon.overview_channels(["t", "cmd_1", "q_1", "q_2", "q_3", "q_4"]) == ["q_1", "q_2", "q_3"]
    assert mon.overview_channels(["t", "cmd_1", "stab_1"]) == ["cmd_1", "stab_1"]


def test_status_rows(spark, rows):
    two = scored(spark, 40).unionByName(scored(spark, 40).withColumn("flight_id", F.lit("other")))
    assert [r["count"] for r in mon.first_predictions(two).groupBy("flight_id").count().collect()] == [30, 30]
    assert mon.live_status(scored(spark, 200)).count() == 200
    status = mon.live_status(scored(spark, 200), 150)
    assert status.count() == 150
    assert rows(status.where("w < 3"), "w", "status", "fault_group") == [(0, "NORMAL", 0), (1, "NORMAL", 0), (2, "FAULT", 1)]


def test_scoring_whole_flights_equals_scoring_their_features(spark, rows):
    data = [
        (f, i / 100, float(np.sin(i / (3 if f == "x" else 9))), float(i % 5), 0.5)
        for f in ("x", "y") for i in range(451)
    ]
    samples = spark.createDataFrame(data, "flight_id string, t double, q_1 double, q_2 double, other double")
    trained = ["q_1", "q_2"]
    features = window_features(samples, trained)
    labels = features.select(
        "flight_id", "w", (F.col("flight_id") == "x").cast("int").alias("y_fault"),
        (F.col("flight_id") == "x").cast("int").alias("y_type"), F.lit(1).alias("y_sev"),
    )
    model = models.fit_boosted(labelled_features(features, labels), models.feature_columns(features), trees=2, depth=2)
    # The channel the model does not know is dropped.
    found = score_flights(samples, channel_stats(samples, trained), model, [*trained, "other"])
    assert found.count() == features.count() == 16
    assert rows(found.where("w = 0"), "flight_id", "fault_label", "t") == [("x", 1, 0.5), ("y", 0, 0.5)]


START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = T.StructType([T.StructField("flight_id", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("value", T.DoubleType())])


def event_file(spark, folder, name, seconds):
    rows = [("a", START + dt.timedelta(seconds=s), float(s)) for s in seconds]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def run(spark, folder, result, out, mode="update"):
    live.run_available(result, out, mode)
    return live.stored_updates(spark, out, result.schema)


def test_streamed_windows_equal_batch(spark, tmp_path):
    for i in range(4):
        event_file(spark, tmp_path, f"in/part{i}", range(i * 30, i * 30 + 30))
    stream = live.read_stream(spark, f"{tmp_path}/in/*", SCHEMA, files_per_trigger=1)
    result = live.live_windows(stream, "20 seconds", "10 seconds", "20 seconds")
    updates = run(spark, tmp_path, result, f"{tmp_path}/out")
    assert updates.select("batch").distinct().count() >= 4
    latest = live.latest_state(updates, ["flight_id", "start", "end"])
    batch = live.live_windows(spark.read.schema(SCHEMA).parquet(f"{tmp_path}/in/*"), "20 seconds", "10 seconds", "20 seconds")
    order = ["start"]
    a, b = latest.orderBy(*order).collect(), batch.orderBy(*order).collect()
    assert len(a) == len(b) == 13
    for x, y in zip(a, b):
        assert x.start == y.start and x.n == y.n and x["mean"] == pytest.approx(y["mean"]) and x["std"] == pytest.approx(y["std"])

    closed = run(spark, tmp_path, live.live_windows(live.read_stream(spark, f"{tmp_path}/in/*", SCHEMA, files_per_trigger=1), "20 seconds", "10 seconds", "20 seconds"), f"{tmp_path}/closed", "append")
    values = {r.start: r.n for r in b}
    emitted = closed.collect()
    assert 0 < len(emitted) < len(b) and all(values[r.start] == r.n for r in emitted)


def test_late_rows_are_dropped(spark, tmp_path):
    event_file(spark, tmp_path, "in/part0", range(0, 30))
    event_file(spark, tmp_path, "in/part1", range(300, 330))
    result = live.live_windows(live.read_stream(spark, f"{tmp_path}/in/*", SCHEMA), "10 seconds", "10 seconds", "10 seconds")
    out = f"{tmp_path}/out"
    live.run_available(result, out)
    # The watermark has passed these rows' windows when the next run picks them up.
    event_file(spark, tmp_path, "in/part2", range(0, 5))
    result = live.live_windows(live.read_stream(spark, f"{tmp_path}/in/*", SCHEMA), "10 seconds", "10 seconds", "10 seconds")
    live.run_available(result, out)
    latest = live.latest_state(live.stored_updates(spark, out, result.schema), ["flight_id", "start", "end"])
    assert latest.orderBy("start").first().n == 10 and latest.agg(F.sum("n")).first()[0] == 60


def test_running_status_equals_batch(spark, rows, tmp_path):
    for i in range(3):
        scored(spark, 30).where(f"w >= {i * 10} and w < {i * 10 + 10}").coalesce(1).write.parquet(f"{tmp_path}/in/part{i}")
    schema = scored(spark, 1).schema
    status = live.running_status(live.read_stream(spark, f"{tmp_path}/in/*", schema, files_per_trigger=1))
    updates = run(spark, tmp_path, status, f"{tmp_path}/out")
    assert updates.count() >= 3
    latest = live.latest_state(updates, ["flight_id"])
    assert rows(latest) == rows(live.running_status(scored(spark, 30)))


def test_batches_can_be_scored_on_the_way(spark, tmp_path):
    event_file(spark, tmp_path, "in/part0", range(0, 30))
    result = live.live_windows(live.read_stream(spark, f"{tmp_path}/in/*", SCHEMA), "10 seconds", "10 seconds", "10 seconds")
    live.run_available(result, f"{tmp_path}/out", transform=lambda df: df.withColumn("fault_prob", F.col("mean") / 100))
    stored = spark.read.parquet(f"{tmp_path}/out/data")
    assert stored.where("fault_prob = mean / 100").count() == stored.count() == 3
