import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultframe.operators import ordered, resample as rs, scaling, splits, windows as win
from faultframe.operators.joins import attach
from faultframe.operators.quantiles import exact_percentiles, percentile_columns


def wide(spark, points, flight="a"):
    return spark.createDataFrame([(flight, float(t), None if v is None else float(v)) for t, v in points], "flight_id string, t double, q_1 double")


def grid_of(df):
    return [(r.k, r.t, r.q_1) for r in df.orderBy("k").collect()]


@pytest.mark.parametrize("chunk_points", [1, 3, 50, 4096])
def test_resample_equals_numpy_over_any_chunking(spark, chunk_points):
    rng = np.random.default_rng(1)
    # Uneven times with long silences, so that several chunks are empty.
    t = np.sort(np.concatenate([rng.uniform(0, 1, 40), rng.uniform(5, 5.2, 30), rng.uniform(9, 9.5, 25)]))
    v = rng.normal(size=len(t))
    found = grid_of(rs.resample(wide(spark, zip(t, v)), 20.0, ["q_1"], chunk_points=chunk_points))
    n = int((t[-1] - t[0]) * 20.0) + 1
    expected_t = np.linspace(t[0], t[-1], n)
    assert [k for k, _, _ in found] == list(range(n))
    assert np.allclose([x for _, x, _ in found], expected_t, atol=1e-12)
    assert np.allclose([x for _, _, x in found], np.interp(expected_t, t, v), atol=1e-10)


def test_resample_bridges_many_chunk_groups(spark, monkeypatch):
    monkeypatch.setattr(rs, "FAN", 2)
    t = np.array([0.0, 0.01, 3.0, 3.5, 20.0, 20.01, 41.0])
    v = np.arange(7.0) ** 2
    found = grid_of(rs.resample(wide(spark, zip(t, v)), 10.0, ["q_1"], chunk_points=4))
    expected_t = np.linspace(0, 41, 411)
    assert len(found) == 411
    assert np.allclose([x for _, _, x in found], np.interp(expected_t, t, v), atol=1e-10)


def test_resample_shorter_than_one_period(spark):
    assert grid_of(rs.resample(wide(spark, [(2.0, 7.0), (2.001, 9.0)]), 100.0, ["q_1"])) == [(0, 2.0, 7.0)]
    assert grid_of(rs.resample(wide(spark, [(2.0, 7.0)]), 100.0, ["q_1"])) == [(0, 2.0, 7.0)]


def test_resample_on_samples_and_null_ends(spark):
    found = grid_of(rs.resample(wide(spark, [(0, 1), (1, None), (2, 3), (3, 5)]), 2.0, ["q_1"]))
    values = [v for _, _, v in found]
    # Points on a sample keep it; points of a segment with a missing end are missing.
    assert values == [1.0, None, None, None, 3.0, 4.0, 5.0]


def test_resample_keeps_the_last_of_equal_times(spark):
    df = spark.createDataFrame(
        [("a", 0.0, 1, 1.0), ("a", 1.0, 2, 5.0), ("a", 1.0, 3, 9.0), ("a", 2.0, 4, 9.0)], "flight_id string, t double, e long, q_1 double"
    )
    assert [v for _, _, v in grid_of(rs.resample(df, 1.0, ["q_1"], tie=["e"]))] == [1.0, 9.0, 9.0]


def test_statistics_and_normalisation(spark, rows):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1.0, 4.0, nan), (3.0, 4.0, 2.0), (5.0, 4.0, inf)], "a double, b double, c double")
    stats = scaling.channel_stats(df.select("a", "b"), ["a", "b"])
    assert rows(stats) == [("a", 3.0, 2.0), ("b", 4.0, 0.0)]
    fixed = spark.createDataFrame([("a", 3.0, 2.0), ("b", 4.0, 0.0), ("c", 1.0, 1.0)], "channel string, mean double, std double")
    found = scaling.normalise(df, fixed, ["a", "b", "c"])
    assert rows(found) == [(-1.0, 0.0, 0.0), (0.0, 0.0, 1.0), (1.0, 0.0, 0.0)]
    # One row: the sample deviation is undefined and the result 0.
    one = df.limit(1)
    assert rows(scaling.normalise(one, scaling.channel_stats(one, ["a"]), ["a"]), "a") == [(0.0,)]
    long = scaling.to_long(df, [], ["a", "b"])
    assert rows(scaling.channel_stats_long(long)) == rows(stats)
    assert rows(scaling.align_channels(long, stats.where("channel = 'a'"), 2).groupBy("channel").count()) == [("a", 3)]
    counts = scaling.missing_counts(scaling.to_long(df, [], ["a", "c"])).first()
    assert (counts.n_nan, counts.n_inf, counts.n_rows) == (1, 1, 6)


def test_vector_zscore_and_poisoned_columns(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, [1.0, 5.0, nan]), (2, [3.0, 5.0, 4.0]), (3, [2.0, 5.0, 6.0])], "id long, vec array<double>")
    stats = scaling.vector_stats(df)
    plain = {r.id: r.vec for r in scaling.zscore_vectors(df, stats).collect()}
    s = np.std([1, 3, 2])
    assert np.allclose(plain[1], [-1 / s, 0, 0]) and np.allclose(plain[2], [1 / s, 0, -1.0])
    poisoned = {r.id: r.vec for r in scaling.zscore_vectors(df, stats, poison_nan=True).collect()}
    assert np.allclose(poisoned[2], [1 / s, 0, 0])


def test_imputation(spark, rows):
    df = spark.createDataFrame([(1.0, None), (float("nan"), 4.0), (3.0, 8.0)], "a double, b double")
    assert rows(scaling.impute_mean(df, ["a", "b"])) == [(1.0, 6.0), (2.0, 4.0), (3.0, 8.0)]


@pytest.mark.parametrize("n, count", [(100, 0), (101, 1), (150, 1), (151, 2), (201, 3), (7, 0)])
def test_window_counts(spark, n, count):
    grid = spark.range(n).select(F.lit("a").alias("flight_id"), F.col("id").alias("k"), F.lit(n).cast("long").alias("n"), (F.col("id") / 100).alias("t"))
    cut = win.sliding_windows(grid, 100, 50)
    sizes = cut.groupBy("w").agg(F.count("*").alias("c"), F.min("i").alias("lo"), F.max("i").alias("hi"), F.min("k").alias("k0")).orderBy("w").collect()
    assert [(r.w, r.c, r.lo, r.hi, r.k0) for r in sizes] == [(w, 100, 0, 99, 50 * w) for w in range(count)]
    spans = spark.createDataFrame([("a", 0.0, (n - 1) / 100, n)], "flight_id string, t0 double, t1 double, n long")
    centres = win.window_centres(spans, 100, 50).orderBy("w").collect()
    assert [round(r.t, 9) for r in centres] == [round((50 * w + 50) / 100, 9) for w in range(count)]
    assert win.dropped_flights(spans, 100, 50).count() == (count == 0)


def test_step_longer_than_the_window(spark, rows):
    grid = spark.range(10).select(F.lit("a").alias("flight_id"), F.col("id").alias("k"), F.lit(10).cast("long").alias("n"))
    assert rows(win.sliding_windows(grid, 2, 4), "w", "i", "k") == [(0, 0, 0), (0, 1, 1), (1, 0, 4), (1, 1, 5)]


def test_first_windows_and_alignment(spark, rows):
    windows = spark.createDataFrame([("b", 0), ("a", 1), ("a", 0)], "flight_id string, w long")
    assert rows(win.first_windows(windows, 2, 0.5)) == [(0, "a", 0, 0.0), (1, "a", 1, 0.5)]
    labels = spark.createDataFrame([("a", 0), ("a", 1), ("c", 5)], "flight_id string, w long")
    found = win.alignment_report(windows, labels).first().asDict()
    assert found == {"n_windows": 3, "n_labels": 3, "windows_without_label": 1, "labels_without_window": 1}


@pytest.mark.parametrize("length, n_points", [(10, 4), (4, 10), (5, 5), (3, 1), (1, 4)])
def test_trajectory_resampling(spark, rows, length, n_points):
    values = np.arange(length) * 1.5
    df = spark.createDataFrame([("a", float(i), float(v)) for i, v in enumerate(values)], "flight_id string, t double, x double")
    sizes = spark.createDataFrame([("a", n_points)], "flight_id string, n_points long")
    found = rows(rs.resample_trajectory(df, sizes, ["x"], F.floor(F.col("t") / 2)), "i", "x")
    index = np.arange(n_points) if length >= n_points else np.linspace(0, length - 1, n_points).astype(int)
    assert [x for _, x in found] == list(values[index])


def test_ordered_primitives_do_not_depend_on_chunks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "FAN", 3)
    monkeypatch.setattr(ordered, "RUN", 7)
    rng = np.random.default_rng(2)
    data = [("hot" if i % 3 else "b", int(v), float(i % 5)) for i, v in enumerate(rng.permutation(500))]
    df = spark.createDataFrame(data, "g string, o long, v double")
    indexed = ordered.row_index(df, ["g"], ["o"], F.floor(F.col("o") / 4)).toPandas()
    for _, part in indexed.groupby("g"):
        assert (part.sort_values("o").idx.to_numpy() == np.arange(len(part))).all() and (part.n_key == len(part)).all()
    run = ordered.running_sums(df, ["g"], ["o"], F.floor(F.col("o") / 4), {"v": "total"}).toPandas().sort_values("o")
    for _, part in run.groupby("g"):
        assert np.allclose(part.total, part.v.cumsum())
    spans = spark.createDataFrame([(0, 20), (5, 4), (6, 6)], "lo long, hi long")
    found = ordered.explode_range(spans, F.col("lo"), F.col("hi"), "x")
    assert sorted(r.x for r in found.where("lo = 0").collect()) == list(range(21))
    assert found.where("lo = 5").count() == 0 and found.where("lo = 6").count() == 1


def test_salted_attach_equals_broadcast(spark, rows):
    big = spark.range(1000).select("id", F.when(F.col("id") < 700, 1).otherwise(F.col("id") % 3).alias("k"))
    small = spark.createDataFrame([(0, "x"), (1, "y")], "k long, name string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        salted = attach(big, small, "k", how, spread=["id"])
        assert rows(salted) == rows(attach(big, small, "k", how, bound=3)) == rows(big.join(small, "k", how))


@pytest.mark.parametrize("n, bound", [(1, 4), (7, 4), (1000, None), (30_000, 4), (30_000, None)])
def test_percentiles_are_exact(spark, n, bound):
    """Also beyond SMALL rows, where a sketch bounds the values: ties, a constant, an extreme outlier."""
    rng = np.random.default_rng(n)
    values = {"a": rng.normal(size=n), "b": rng.integers(0, 4, size=n).astype(float), "c": np.full(n, 2.5),
              "d": np.concatenate([rng.normal(size=n - 1) * 1e-9, [1e9]])}
    df = spark.createDataFrame(pd.DataFrame([(k, float(v)) for k, part in values.items() for v in part], columns=["k", "x"]))
    probs = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    found = {(r.k, r.p): r.x for r in exact_percentiles(df, ["k"], "x", probs, bound=bound).collect()}
    for k, part in values.items():
        for p in probs:
            assert found[k, p] == pytest.approx(np.percentile(part, 100 * p), abs=1e-12)
    assert exact_percentiles(df, [], "x", [0.5]).first().x == pytest.approx(np.median(np.concatenate(list(values.values()))))


def test_percentiles_skip_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0)], "k string, x double")
    row = percentile_columns(df, ["k"], "x", {"m": 0.5}).first()
    assert row.m == 2.0


def test_stratified_split_is_exact_and_stable(spark):
    df = spark.range(2003).select("id", F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 3).alias("y"))
    found = splits.stratified_split(df, ["id"], "y").toPandas()
    assert len(found) == 2003
    for _, part in found.groupby("y"):
        assert part.is_test.sum() == round(0.2 * len(part))
    again = splits.stratified_split(df.repartition(7), ["id"], "y").toPandas()
    assert set(found[found.is_test].id) == set(again[again.is_test].id)
    other = splits.stratified_split(df, ["id"], "y", seed=7).toPandas()
    assert set(found[found.is_test].id) != set(other[other.is_test].id)


def test_split_by_flight_never_straddles(spark):
    df = spark.range(3000).select((F.col("id") % 30).alias("flight_id"), "id").withColumn("y", F.col("flight_id") % 2)
    found = splits.stratified_split(df, ["id"], "y", group_by="flight_id").toPandas()
    per = found.groupby("flight_id").is_test.nunique()
    assert (per == 1).all() and found[found.is_test].groupby("y").flight_id.nunique().to_list() == [3, 3]


def test_subsample_and_class_weights(spark, rows):
    assert splits.subsample(spark.range(50), ["id"], 1000).count() == 50
    assert splits.subsample(spark.range(5000), ["id"], 1000).distinct().count() == 1000
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "y int")
    assert rows(splits.class_weights(df, "y")) == [(0, 6, 8 / 12), (1, 2, 2.0)]
