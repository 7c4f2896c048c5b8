import numpy as np
import pytest
from pyspark.sql import functions as F

from faultframe.operators import explore as ex


def samples(spark, channels, label=None):
    rows = [(c, None if v is None else float(v), label[i] if label is not None else 0) for c, x in channels.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "channel string, value double, y int")


def test_class_counts_and_balance(spark, rows):
    df = spark.createDataFrame([(0, 0)] * 8 + [(0, 1)] * 1 + [(1, 1)] * 1, "a int, b int")
    assert rows(ex.class_counts(df, "a")) == [(0, 9, 90.0), (1, 1, 10.0)]
    found = rows(ex.imbalance(ex.label_counts(df, ["a", "b"])))
    assert found == [("a", 2, 9.0, "high"), ("b", 2, 4.0, "high")]
    verdicts = spark.createDataFrame([(1.5,), (1.6,), (3.0,), (3.1,)], "r double")
    assert rows(verdicts.select("r", ex.balance_verdict(F.col("r")))) == [(1.5, "balanced"), (1.6, "moderate"), (3.0, "moderate"), (3.1, "high")]


def test_profile_flags_and_ranges(spark, rows):
    rng = np.random.default_rng(0)
    data = {"a": rng.normal(size=99), "b": np.where(np.arange(99) < 60, 0.0, 4.0), "c": np.full(99, 7.0)}
    profile = ex.channel_profile(samples(spark, data), 3)
    for r in profile.collect():
        x = data[r.channel]
        expected = [x.mean(), x.std(), x.min(), x.max(), np.median(x), *np.percentile(x, [25, 75]), np.ptp(x), (x == 0).mean() * 100]
        assert np.allclose([r["mean"], r["std"], r["min"], r["max"], r["median"], r["q25"], r["q75"], r["range"], r["zeros_pct"]], expected)
    assert rows(ex.quality_flags(profile)) == [("b", True, False), ("c", False, True)]
    extremes = ex.extreme_ranges(profile).first()
    assert extremes.narrowest == "c" and extremes.widest == ("a" if np.ptp(data["a"]) > 4 else "b")


def test_extreme_ranges_tie_on_the_lowest_name(spark):
    profile = spark.createDataFrame([("b", 2.0), ("a", 2.0)], "channel string, range double")
    row = ex.extreme_ranges(profile).first()
    assert (row.widest, row.narrowest) == ("a", "a")


@pytest.mark.parametrize("bound", [2, None])
def test_histogram_equals_numpy(spark, bound):
    data = {"a": [0.0, 0.1, 0.5, 1.0, 1.0, 0.99], "flat": [3.0] * 6}
    found = ex.histogram(samples(spark, data), ["channel"], "value", 5, bound=bound).toPandas()
    for name, x in data.items():
        counts, edges = np.histogram(x, 5)
        part = found[found.channel == name].sort_values("bin")
        assert part.n.to_list() == counts.tolist() and np.allclose(part.low, edges[:-1]) and np.allclose(part.high, edges[1:])


def test_histogram_without_keys_and_by_class(spark):
    df = samples(spark, {"a": [0, 1, 2, 3]}, [0, 0, 1, 1])
    assert [r.n for r in ex.histogram(df, [], "value", 2).orderBy("bin").collect()] == [2, 2]
    per_class = ex.histogram(df, ["channel"], "value", 2, bound=10, by=["y"]).orderBy("y", "bin").collect()
    assert [(r.y, r.n, r.low) for r in per_class] == [(0, 1, 0.0), (0, 1, 0.5), (1, 1, 2.0), (1, 1, 2.5)]


def test_box_stats(spark):
    x = [1.0, 2, 3, 4, 5, 100, -50]
    row = ex.box_stats(samples(spark, {"a": x}), 1).first()
    assert (row.q1, row.median, row.q3, row.whisker_low, row.whisker_high) == (1.5, 3.0, 4.5, 1.0, 5.0)
    row = ex.box_stats(samples(spark, {"a": [0.0, 1, 2, 3, 4, float("nan")]}), 1).first()
    assert (row.q1, row.median, row.q3, row.whisker_low, row.whisker_high) == (1.0, 2.0, 3.0, 0.0, 4.0)


def test_window_autocorrelation_skips_undefined(spark, rows):
    rng = np.random.default_rng(1)
    signal = rng.normal(size=20)
    data = [("f", 0, "a", i, float(v)) for i, v in enumerate(signal)] + [("f", 1, "a", i, 2.0) for i in range(20)]
    data += [("f", 0, "flat", i, 1.0) for i in range(20)]
    windows = spark.createDataFrame(data, "flight_id string, w long, channel string, i int, value double")
    found = {r.channel: r for r in ex.mean_autocorrelation(windows).collect()}
    assert found["a"].n_windows == 1
    assert found["a"].autocorr == pytest.approx(np.corrcoef(signal[:-1], signal[1:])[0, 1])
    assert (found["flat"].autocorr, found["flat"].n_windows) == (0.0, 0)
    stds = {r.channel: r.mean_std for r in ex.mean_window_std(windows).collect()}
    assert stds["a"] == pytest.approx(signal.std() / 2) and stds["flat"] == 0


def test_cross_tab_margins(spark, rows):
    df = spark.createDataFrame([(0, 1), (0, 1), (1, 2)], "a int, b int")
    assert rows(ex.cross_tab(df, "a", "b")) == [
        ("0", "1", 0, 2), ("0", "All", 1, 2), ("1", "2", 0, 1), ("1", "All", 1, 1), ("All", "1", 2, 2), ("All", "2", 2, 1),
        ("All", "All", 3, 3),
    ]


def test_separability(spark):
    label = [0, 0, 1, 1]
    df = samples(spark, {"good": [0, 1, 10, 11], "flat": [2, 2, 2, 2]}, label)
    found = ex.separability(df, "y").collect()
    assert [(r.channel, r.separability) for r in found] == [("good", 20.0), ("flat", 0.0)]
    assert [r.channel for r in ex.top_channels(ex.separability(df, "y"), 1).collect()] == ["good"]


def test_correlation_skips_missing_pairwise(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)) + 1000
    x[:, 1] = x[:, 0] * 2 + rng.normal(size=300) * 0.1
    x[:, 3] = 5.0
    x[::7, 2] = np.nan
    df = spark.createDataFrame([tuple(float(v) for v in r) for r in x], "a double, b double, c double, d double")
    found = {(r.a, r.b): r for r in ex.correlation_pairs(df.repartition(5), ["a", "b", "c", "d"]).collect()}
    assert len(found) == 10
    ok = ~np.isnan(x[:, 2])
    assert found["a", "b"].r == pytest.approx(np.corrcoef(x[:, 0], x[:, 1])[0, 1])
    assert found["a", "c"].r == pytest.approx(np.corrcoef(x[ok, 0], x[ok, 2])[0, 1])
    assert found["a", "c"].n == ok.sum() and found["a", "d"].r is None and found["b", "b"].r == pytest.approx(1.0)
    pairs = ex.correlation_pairs(df, ["a", "b", "c", "d"])
    top = ex.top_pairs(pairs, 0.8).collect()
    assert [(r.a, r.b, r.n_strong) for r in top] == [("a", "b", 1)]


def test_recommendations(spark, rows):
    imbalances = spark.createDataFrame([("y", 2, 2.5, "moderate")], "label_set string, n_classes long, imbalance double, verdict string")
    pairs = spark.createDataFrame([(i, i + 1, 9, 0.9) for i in range(11)], "a int, b int, n long, r double")
    summary = ex.value_summary(spark.createDataFrame([(-1.0,), (1.0,), (float("nan"),)], "value double"))
    row = summary.first()
    assert (row.n_points, row["mean"], row["std"]) == (2, 0.0, 1.0)
    assert rows(ex.recommendations(imbalances, pairs, summary)) == [
        ("class_balance", "use_class_weights"), ("correlation", "reduce_features"), ("normalisation", "good"),
    ]


def test_sampled_windows(spark):
    grid = spark.createDataFrame([(f"f{f}", k, float(10 * f + k), -float(k)) for f in range(4) for k in range(11)], "flight_id string, k long, a double, b double")
    labels = spark.createDataFrame([(f"f{f}", w, w % 2) for f in range(4) for w in range(4)], "flight_id string, w long, y_fault int")
    found = ex.sampled_windows(grid, labels, ["a", "b"], length=4, step=2).collect()
    assert len(found) == 5 * 4 * 2 and len({(r.flight_id, r.w) for r in found}) == 5
    for r in found:
        k = 2 * r.w + r.i
        assert r.value == (10 * int(r.flight_id[1]) + k if r.channel == "a" else -k) and r.y_fault == r.w % 2
