import numpy as np
import pytest

from faultframe.operators import features as feat
from faultframe.operators.windows import sliding_windows

FS = 100.0


def windows_of(spark, signals):
    rows = [("f", 0, name, i, float(v)) for name, x in signals.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "flight_id string, w long, channel string, i int, value double")


def by_channel(df):
    return {r.channel: r.asDict() for r in df.collect()}


def moments(x):
    d = x - x.mean()
    return (d**3).mean() / (d**2).mean() ** 1.5, (d**4).mean() / (d**2).mean() ** 2 - 3


def signals(n=100):
    rng = np.random.default_rng(0)
    t = np.arange(n) / FS
    return {
        "noise": rng.normal(size=n),
        "sine": np.sin(2 * np.pi * 10 * t),
        "flip": np.where(np.arange(n) % 2 == 0, 1.0, -1.0),
        "flat": np.full(n, 3.0),
        "two": np.cos(2 * np.pi * 10 * t) + np.cos(2 * np.pi * 30 * t),
    }


def test_time_features(spark):
    x = signals()
    found = by_channel(feat.time_features(windows_of(spark, x)))
    for name, v in x.items():
        f = found[name]
        expected = [v.mean(), v.std(), v.min(), v.max(), np.ptp(v), np.sqrt((v**2).mean())]
        assert np.allclose([f[k] for k in ("mean", "std", "min", "max", "ptp", "rms")], expected)
        if name != "flat":
            assert np.allclose([f["skew"], f["kurt"]], moments(v), atol=1e-9)
    assert found["flat"]["skew"] is None and found["flat"]["kurt"] is None


def grid_of(spark, signals, n=None, flight="f"):
    names = list(signals)
    n = n or len(next(iter(signals.values())))
    rows = [(flight, k, n, *[float(signals[c][k]) for c in names]) for k in range(n)]
    return spark.createDataFrame(rows, "flight_id string, k long, n long, " + ", ".join(f"{c} double" for c in names))


def one_window(spark, x):
    """A grid that holds exactly one window, the given signals."""
    return grid_of(spark, {c: np.append(v, 0.0) for c, v in x.items()})


@pytest.mark.parametrize("n", [100, 101])
def test_spectrum_equals_rfft(spark, n):
    x = signals(n)
    spectrum = feat.power_spectrum(one_window(spark, x), list(x), n, n, FS).toPandas()
    for name, v in x.items():
        part = spectrum[spectrum.channel == name].sort_values("bin")
        assert np.allclose(part.psd, np.abs(np.fft.rfft(v)) ** 2 / n, atol=1e-10)
        assert np.allclose(part.freq, np.fft.rfftfreq(n, 1 / FS))


def test_bands_and_peaks(spark):
    x = signals()
    found = by_channel(feat.window_features(one_window(spark, x), list(x), 100, 50, FS))
    spectrum = feat.power_spectrum(one_window(spark, x), list(x), 100, 50, FS)
    powers = by_channel(feat.band_powers(spectrum, 100, FS))
    freqs = np.fft.rfftfreq(100, 1 / FS)
    for name, v in x.items():
        psd = np.abs(np.fft.rfft(v)) ** 2 / 100
        for band, (lo, hi) in feat.bands(FS).items():
            inside = (freqs >= lo) & (freqs <= hi)
            expected = np.trapezoid(psd[inside], freqs[inside])
            assert found[name][band] == pytest.approx(expected, abs=1e-9)
            assert powers[name][band] == pytest.approx(expected, abs=1e-9)
        parts = [found[name][b] for b in ("power_low", "power_mid", "power_high")]
        assert sum(parts) == pytest.approx(found[name]["power_total"], abs=1e-9)
    assert found["sine"]["f_peak"] == 10 and found["sine"]["power_mid"] > 0.9 * found["sine"]["power_total"]
    assert found["flip"]["f_peak"] == 50 and found["flat"]["f_peak"] == 0
    assert found["flat"]["skew"] is None and found["flat"]["kurt"] is None


@pytest.mark.parametrize("per_block", [1, 3, 256])
@pytest.mark.parametrize("length, step", [(20, 10), (20, 7), (5, 12)])
def test_block_features_equal_aggregates_of_cut_windows(spark, monkeypatch, per_block, length, step):
    monkeypatch.setattr(feat, "WINDOWS_PER_BLOCK", per_block)
    rng = np.random.default_rng(4)
    grid = grid_of(spark, {"a": rng.normal(size=143), "b": rng.normal(size=143)}).unionByName(
        grid_of(spark, {"a": rng.normal(size=length), "b": rng.normal(size=length)}, flight="short")
    )
    cut = sliding_windows(grid, length, step).unpivot(["flight_id", "w", "i"], ["a", "b"], "channel", "value")
    keys = ["flight_id", "w", "channel"]
    expected = feat.time_features(cut).toPandas().sort_values(keys)
    found = feat.window_features(grid.repartition(5), ["a", "b"], length, step, FS).toPandas().sort_values(keys)
    assert found[keys].to_numpy().tolist() == expected[keys].to_numpy().tolist() and len(found)
    for name in feat.TIME_FEATURES:
        assert np.allclose(found[name].astype(float), expected[name].astype(float), atol=1e-9)
    wide = feat.wide_window_features(grid, ["a", "b"], length, step, FS).toPandas().sort_values(["flight_id", "w"])
    assert np.allclose(wide["b_rms"], found[found.channel == "b"].rms)
    assert np.allclose(wide["a_power_total"], found[found.channel == "a"].power_total)


def test_equal_peaks_take_the_lowest_frequency(spark):
    spectrum = spark.createDataFrame(
        [("f", 0, "c", b, float(b), p) for b, p in enumerate([1.0, 5.0, 2.0, 5.0])],
        "flight_id string, w long, channel string, bin int, freq double, psd double",
    )
    row = feat.spectral_peak(spectrum).first()
    assert (row.f_peak, row.psd_peak) == (1.0, 5.0)


def test_features_shuffle_once(spark):
    x = signals()
    plan = feat.window_features(one_window(spark, x), list(x), 100, 50, FS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_long_features_pivot_to_named_columns(spark):
    x = signals()
    long = feat.window_features(one_window(spark, x), list(x), 100, 50, FS)
    row = feat.wide_features(long, ["flat", "absent"]).first().asDict()
    assert len(row) == 2 + 2 * 14
    assert row["flat_mean"] == 3.0 and row["flat_skew"] == 0.0 and row["absent_rms"] == 0.0
    direct = feat.wide_window_features(one_window(spark, x), ["flat"], 100, 50, FS).first().asDict()
    assert direct["flat_mean"] == 3.0 and direct["flat_kurt"] == 0.0 and len(direct) == 16


def test_flattened_window(spark):
    windows = windows_of(spark, {"b": [1, 2], "a": [10, 20]})
    assert feat.flatten_windows(windows).first().vec == [10.0, 1.0, 20.0, 2.0]


def test_autocorrelation(spark):
    x = {k: v for k, v in signals().items()}
    found = by_channel(feat.lag1_autocorrelation(windows_of(spark, x)))
    assert found["flat"]["r"] is None
    for name in ("noise", "sine", "two"):
        assert found[name]["r"] == pytest.approx(np.corrcoef(x[name][:-1], x[name][1:])[0, 1])
