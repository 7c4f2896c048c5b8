"""Queries: time- and frequency-domain features (T and F)."""

from pyspark.sql import functions as F

from ..operators import features as feat
from ..settings import TARGET_FS
from .catalog import query, r, rounded
from .queries_prepare import CHANNELS, LENGTH, STEP, norm_grid, norm_windows

KEYS = "flight_id, w, channel"
TIME = ("mean", "std", "min", "max", "ptp", "rms", "skew", "kurt")


def _time_query(key: str, names):
    def build(spark, sf):
        return rounded(feat.time_features(norm_windows(spark, sf), names))

    query(key, f"SELECT {KEYS}, {r(*names)} FROM time_feats")(build)


_time_query("t1_mean", ["mean"])
_time_query("t2_std", ["std"])
_time_query("t3_min_max", ["min", "max"])
_time_query("t4_ptp", ["ptp"])
_time_query("t5_rms", ["rms"])
_time_query("t6_skewness", ["skew"])
_time_query("t7_kurtosis", ["kurt"])
_time_query("t8_time_features", TIME)


def spectrum(spark, sf):
    return feat.power_spectrum(norm_grid(spark, sf), CHANNELS, LENGTH, STEP, TARGET_FS)


@query("f1_power_spectrum", f"SELECT {KEYS}, bin, freq, {r('psd')} FROM spectrum")
def f1(spark, sf):
    return rounded(spectrum(spark, sf))


@query(
    "f2_bandpower",
    f"SELECT {KEYS}, {r('sum(area) AS power')} FROM trapezes WHERE f0 >= 8 AND f1 <= 12 GROUP BY {KEYS}",
)
def f2(spark, sf):
    return rounded(feat.band_power(spectrum(spark, sf), LENGTH, TARGET_FS, 8.0, 12.0))


@query("f3_band_powers", f"SELECT {KEYS}, {r('power_total', 'power_low', 'power_mid', 'power_high')} FROM powers")
def f3(spark, sf):
    return rounded(feat.band_powers(spectrum(spark, sf), LENGTH, TARGET_FS))


@query("f4_spectral_peak", f"SELECT {KEYS}, {r('f_peak', 'psd_peak')} FROM peaks")
def f4(spark, sf):
    return rounded(feat.spectral_peak(spectrum(spark, sf)))


@query(
    "f5_freq_features",
    f"""SELECT {KEYS}, {r(*feat.FREQ_FEATURES)} FROM powers JOIN peaks USING ({KEYS})""",
)
def f5(spark, sf):
    return rounded(feat.window_features(norm_grid(spark, sf), CHANNELS, LENGTH, STEP, TARGET_FS, feat.FREQ_FEATURES))


@query(
    "f6_all_features",
    f"""SELECT {KEYS}, {r(*TIME, *feat.FREQ_FEATURES)}
        FROM time_feats JOIN powers USING ({KEYS}) JOIN peaks USING ({KEYS})""",
)
def f6(spark, sf):
    return rounded(feat.window_features(norm_grid(spark, sf), CHANNELS, LENGTH, STEP, TARGET_FS))


@query(
    "f6_combined_parts",
    f"""SELECT {KEYS}, {r(*TIME, *feat.FREQ_FEATURES)}
        FROM time_feats JOIN powers USING ({KEYS}) JOIN peaks USING ({KEYS})""",
)
def f6_parts(spark, sf):
    freq = feat.window_features(norm_grid(spark, sf), CHANNELS, LENGTH, STEP, TARGET_FS, feat.FREQ_FEATURES)
    return rounded(feat.combine_features(feat.time_features(norm_windows(spark, sf)), freq))


@query("f7_window_means", f"SELECT {KEYS}, {r('avg(value) AS mean')} FROM win GROUP BY {KEYS}")
def f7(spark, sf):
    return rounded(feat.time_features(norm_windows(spark, sf), ["mean"]))


@query(
    "f8_flattened_windows",
    f"""SELECT flight_id, w, CAST((row_number() OVER (PARTITION BY flight_id, w ORDER BY i, channel)) - 1 AS INTEGER) AS pos,
               {r('value AS x')} FROM win""",
)
def f8(spark, sf):
    flat = feat.flatten_windows(norm_windows(spark, sf))
    return rounded(flat.select("flight_id", "w", F.posexplode("vec").alias("pos", "x")))
