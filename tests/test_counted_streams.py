import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultframe.operators import monitor as mon
from faultframe.operators.features import ALL_FEATURES, wide_window_features
from faultframe.streaming import counted, live

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "flight_id string, ts timestamp, event_id long, a double, b double"


def at(seconds):
    return START + dt.timedelta(seconds=float(seconds))


def write(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{name}")


def test_closed_windows_equal_the_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    sizes, samples, number = {"x": 47, "y": 23, "z": 8}, {}, 0
    for flight, n in sizes.items():
        times = np.sort(rng.choice(200, n, replace=False)) if flight != "y" else np.sort(rng.integers(0, 100, n))  # y has equal times
        samples[flight] = []
        for t in times:
            samples[flight].append((flight, at(t), number, float(rng.normal()), float(rng.integers(3))))
            number += 1
    rows = [r for part in samples.values() for r in part]
    order = sorted(rows, key=lambda r: r[1])
    late = [r for i, r in enumerate(order) if i % 7 == 3]  # each comes with the file after its own
    files = [[r for r in order if r not in late and at(50 * k) <= r[1] < at(50 * k + 50)] for k in range(4)] + [[]]
    for r in late:
        files[int((r[1] - START).total_seconds() // 50) + 1].append(r)
    for k, part in enumerate(files):
        if part:
            write(spark, tmp_path, f"part{k}", part[::-1])
    for k, seconds in enumerate((1000, 1001)):  # other flights go on, so that the watermark does
        write(spark, tmp_path, f"part{k + 8}", [("other", at(seconds), 10_000 + k, 0.0, 0.0)])
    write(spark, tmp_path, "part99", [("x", at(5), 20_000, 99.0, 99.0)])  # later than the delay: dropped
    stream = live.read_stream(spark, f"{tmp_path}/in/*", spark.createDataFrame([], SCHEMA).schema, files_per_trigger=1)
    result = counted.counted_windows(stream, ["a", "b"], 10, 5, 100.0, "120 seconds")
    live.run_available(result, f"{tmp_path}/out", "append", transform=lambda df: df.withColumn("scored", F.col("a_mean") * 2))
    found = spark.read.parquet(f"{tmp_path}/out/data").toPandas().sort_values(["flight_id", "w"]).reset_index(drop=True)
    assert found.batch.nunique() > 1 and np.allclose(found.scored, 2 * found.a_mean)

    grid = [(f, i, len(part), r[3], r[4]) for f, part in samples.items() for i, r in enumerate(sorted(part, key=lambda r: (r[1], r[2])))]
    batch = wide_window_features(spark.createDataFrame(grid, "flight_id string, k long, n long, a double, b double"), ["a", "b"], 10, 5, 100.0)
    batch = batch.toPandas().sort_values(["flight_id", "w"]).reset_index(drop=True)
    assert found[["flight_id", "w"]].values.tolist() == batch[["flight_id", "w"]].values.tolist() and len(batch) == 8 + 3
    names = [f"{c}_{n}" for c in "ab" for n in ALL_FEATURES]
    assert np.allclose(found[names], batch[names])
    middle = sorted(samples["x"], key=lambda r: (r[1], r[2]))[5][1]
    assert found.ts[0].tz_localize("UTC") == middle


@pytest.mark.parametrize("length, step", [(10, 5), (4, 6), (3, 1)])
def test_windows_of_any_split_of_the_samples(length, step):
    n = 37
    whole = [w for w in range(n) if w * step < n - length]
    for cut in range(n + 1):
        first, w, met = 0, 0, []
        for final in (cut, n):
            cells, following = counted.windows_of(np.arange(first, n), first, w, length, step, final - first)
            met += (cells + first).tolist()
            drop = min(final - first, max(0, following * step - first))
            first, w = first + drop, following
        assert met == [list(range(k * step, k * step + length)) for k in whole]


class Pages(dict):
    """A map state in memory."""

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        assert len(value[0]) <= counted.PAGE
        self[key] = value

    removeKey = dict.pop


@pytest.mark.parametrize("seed", range(4))
def test_samples_that_wait_in_pages_come_out_in_order(monkeypatch, seed):
    rng, kind = np.random.default_rng(seed), np.dtype([("us", np.int64), ("tie", np.int64), ("x", np.float64, (1,))])
    monkeypatch.setattr(counted, "PAGE", 5 * kind.itemsize)
    monkeypatch.setattr(counted, "RUNS", 4)
    pages, table, given, found, passed = Pages(), b"", [], [], -1
    for limit in (10, 10, 30, 31, 80, 200):
        runs = counted.Runs(pages, kind, table)
        for _ in range(rng.integers(0, 6)):  # none, or more runs than there may be; times and ties come again
            samples = np.zeros(rng.integers(1, 40), dtype=kind)
            samples["us"], samples["tie"] = rng.integers(passed + 1, 120, len(samples)), rng.integers(0, 3, len(samples))
            samples["x"] = rng.normal(size=(len(samples), 1))
            given.append(samples)
            runs.add(samples)
        found += runs.final(limit)
        passed, table = limit, runs.stored()
        assert len(table) // 48 <= 4 and sum(len(v[0]) for v in pages.values()) >= kind.itemsize * (sum(map(len, given)) - sum(map(len, found)))
    given, found = np.concatenate(given), np.concatenate(found)
    assert not pages and not table and sorted(found.tolist()) == sorted(given.tolist())
    assert (found[["us", "tie"]] == np.sort(found[["us", "tie"]])).all()


def test_no_value_of_the_state_grows_with_a_flight(spark, tmp_path):
    n, name = 40_000, "spark.sql.streaming.stateStore.providerClass"
    rows = spark.range(n).select(
        F.lit("x").alias("flight_id"), F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("id") * 10).alias("ts"),
        F.col("id").alias("event_id"), F.sin("id").alias("a"), F.col("id").cast("double").alias("b"),
    )
    for k, part in enumerate((F.col("event_id") < 30_000, F.col("event_id") >= 30_000)):
        rows.where(part).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    before = spark.conf.get(name, None)
    stream = live.read_stream(spark, f"{tmp_path}/in/*", rows.schema, files_per_trigger=1)
    closed = counted.counted_windows(stream, ["a", "b"], 20, 10, 100.0, "100 seconds")
    live.run_available(closed, f"{tmp_path}/out", "append")
    assert spark.conf.get(name, None) == before
    state = spark.read.format("statestore").option("stateVarName", "pages").load(f"{tmp_path}/out/progress")
    pages, largest, waiting = state.agg(*[f(F.length("user_map_value.samples")) for f in (F.count, F.max, F.sum)]).first()
    assert pages >= 3 and largest <= counted.PAGE and waiting >= 20_000 * 4 * 8
    # The first file's watermark closes windows of its first 20,000 samples; the last of them stands behind the last window.
    found = spark.read.parquet(f"{tmp_path}/out/data").agg(F.count(F.lit(1)), F.max("w"), F.max("b_max")).first()
    assert tuple(found) == (1_998, 1_997, 19_989)


def test_status_expires_and_is_read_from_the_state(spark, tmp_path):
    kind = "flight_id string, w long, ts timestamp, fault_label int, severity_level int"
    parts = [
        [("a", 0, at(0), 0, 1), ("a", 1, at(10), 1, 2), ("b", 0, at(5), 1, 3)],
        [("b", 1, at(90), 0, 0), ("c", 0, at(95), 1, 1)],
        [("c", 1, at(100), 0, 2)],
    ]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    schema = spark.createDataFrame([], kind).schema
    status = counted.expiring_status(live.read_stream(spark, f"{tmp_path}/in/*", schema, files_per_trigger=1), 50_000)
    live.run_available(status, f"{tmp_path}/out")
    got = {r.flight_id: (r.seen, r.faulty_share, r.latest_severity, r.status) for r in counted.stored_status(spark, f"{tmp_path}/out").collect()}
    whole = spark.createDataFrame([r for part in parts for r in part], kind)
    expected = {r.flight_id: (r.seen, r.faulty_share, r.latest_severity, r.status) for r in live.running_status(whole).collect()}
    assert set(got) == {"b", "c"} and all(got[k] == expected[k] for k in got)
    assert mon.status_text(F.lit(1)) is not None
