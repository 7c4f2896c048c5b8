"""Time- and frequency-domain features per window and channel."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.numeric import ratio
from .windows import window_count

KEYS = ("flight_id", "w", "channel")

TIME_FEATURES = ("mean", "std", "min", "max", "ptp", "rms", "skew", "kurt")
FREQ_FEATURES = ("power_total", "power_low", "power_mid", "power_high", "f_peak", "psd_peak")
ALL_FEATURES = TIME_FEATURES + FREQ_FEATURES

# Consecutive windows of a flight that are described together.
WINDOWS_PER_BLOCK = 256

# Inner edges of the frequency bands in Hz.
LOW_EDGE, MID_EDGE = 5.0, 20.0


def time_aggregates(value="value"):
    """The eight statistics as aggregate columns; skewness and kurtosis are biased, NULL on a constant window."""
    x = F.col(value)
    return {
        "mean": F.avg(x),
        "std": F.stddev_pop(x),
        "min": F.min(x),
        "max": F.max(x),
        "ptp": F.max(x) - F.min(x),
        "rms": F.sqrt(F.avg(x * x)),
        "skew": F.skewness(x),
        "kurt": F.kurtosis(x),
    }


def time_features(windows: DataFrame, names=TIME_FEATURES, keys=KEYS) -> DataFrame:
    exprs = time_aggregates()
    return windows.groupBy(*keys).agg(*[exprs[n].alias(n) for n in names])


def band_weights(length: int, fs: float, fmin: float, fmax: float) -> np.ndarray:
    """Trapezoid weight of each spectrum bin for the band [fmin, fmax]."""
    freqs = np.fft.rfftfreq(length, d=1.0 / fs)
    inside = (freqs >= fmin) & (freqs <= fmax)
    pairs = (inside[1:] & inside[:-1]) * np.diff(freqs) / 2.0
    weights = np.zeros(len(freqs))
    weights[1:] += pairs
    weights[:-1] += pairs
    return weights


def bands(fs: float) -> dict[str, tuple[float, float]]:
    return {
        "power_total": (0.0, fs / 2),
        "power_low": (0.0, LOW_EDGE),
        "power_mid": (LOW_EDGE, MID_EDGE),
        "power_high": (MID_EDGE, fs / 2),
    }


def _per_block(grid: DataFrame, channels, length: int, step: int, describe, schema: str) -> DataFrame:
    """Run `describe(first window, {channel: windows x length matrix})` on blocks of consecutive windows.

    A grid point goes to the one or two blocks whose windows hold it, so the shuffle moves the grid about once,
    however much the windows overlap, and a block has a bounded number of points. The table it returns lacks only
    the flight.
    """
    channels = list(channels)
    span = WINDOWS_PER_BLOCK * step
    k = F.col("k")
    count = window_count(F.col("n"), length, step)
    low = F.greatest(F.lit(0).cast("long"), F.floor((k - (span - step + length)) / F.lit(span)) + 1)
    high = F.least(F.floor(k / F.lit(span)), F.floor((count - 1) / F.lit(WINDOWS_PER_BLOCK)))
    placed = grid.select("flight_id", "k", count.alias("windows"), low.alias("lo"), high.alias("hi"), *channels)
    placed = placed.where("lo <= hi").withColumn("block", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        flight, first = key[0], key[1].as_py() * WINDOWS_PER_BLOCK
        table = table.sort_by("k")
        here = min(WINDOWS_PER_BLOCK, table["windows"][0].as_py() - first)
        cells = np.arange(here)[:, None] * step + np.arange(length)
        found = describe(first, {c: table[c].to_numpy()[cells] for c in channels})
        flights = pa.array([flight.as_py()] * found.num_rows, pa.string())
        return found.add_column(0, "flight_id", flights)

    return placed.groupBy("flight_id", "block").applyInArrow(run, f"flight_id string, {schema}")


def _stacked(first: int, parts: dict[str, dict]) -> pa.Table:
    """Long rows (w, channel, columns) of the columns found per channel."""
    tables = []
    for channel, columns in parts.items():
        size = len(next(iter(columns.values())))
        ids = {"w": pa.array(np.arange(first, first + size)), "channel": pa.array([channel] * size, pa.string())}
        tables.append(pa.table({**ids, **columns}))
    return pa.concat_tables(tables)


def power_spectrum(grid: DataFrame, channels, length: int, step: int, fs: float) -> DataFrame:
    """(keys, bin, freq, psd): one-sided, untapered power spectrum of each window of a normalised grid."""

    def describe(first: int, blocks: dict) -> pa.Table:
        parts = {}
        for channel, block in blocks.items():
            power = _power(block)
            offsets = pa.array(np.arange(len(power) + 1, dtype=np.int32) * power.shape[1])
            parts[channel] = {"p": pa.ListArray.from_arrays(offsets, pa.array(power.ravel()))}
        return _stacked(first, parts)

    spectra = _per_block(grid, channels, length, step, describe, "w long, channel string, p array<double>")
    bins = spectra.select(*KEYS, F.posexplode("p").alias("bin", "psd"))
    return bins.select(*KEYS, "bin", (F.col("bin") * F.lit(float(fs)) / F.lit(length)).alias("freq"), "psd")


def band_power(spectrum: DataFrame, length: int, fs: float, fmin: float, fmax: float, out="power", keys=KEYS) -> DataFrame:
    """Trapezoid integral over the bins inside [fmin, fmax]; the weights depend on the bin alone."""
    weights = F.array(*[F.lit(float(w)) for w in band_weights(length, fs, fmin, fmax)])
    return spectrum.groupBy(*keys).agg(F.sum(F.col("psd") * F.get(weights, F.col("bin"))).alias(out))


def band_powers(spectrum: DataFrame, length: int, fs: float, keys=KEYS) -> DataFrame:
    """The four bands in one aggregate."""
    sums = []
    for name, (fmin, fmax) in bands(fs).items():
        weights = F.array(*[F.lit(float(w)) for w in band_weights(length, fs, fmin, fmax)])
        sums.append(F.sum(F.col("psd") * F.get(weights, F.col("bin"))).alias(name))
    return spectrum.groupBy(*keys).agg(*sums)


def spectral_peak(spectrum: DataFrame, keys=KEYS) -> DataFrame:
    """Largest bin, the lowest frequency on ties."""
    top = F.max(F.struct("psd", (-F.col("freq")).alias("nf"))).alias("top")
    return spectrum.groupBy(*keys).agg(top).select(
        *keys, (F.lit(0.0) - F.col("top.nf")).alias("f_peak"), F.col("top.psd").alias("psd_peak")
    )


def _power(block: np.ndarray) -> np.ndarray:
    return np.abs(np.fft.rfft(block, axis=1)) ** 2 / block.shape[1]


def _spectral_columns(block: np.ndarray, fs: float) -> list[pa.Array]:
    length = block.shape[1]
    power = _power(block)
    weights = np.stack([band_weights(length, fs, lo, hi) for lo, hi in bands(fs).values()], axis=1)
    peak = power.argmax(axis=1)
    found = [*(power @ weights).T, np.fft.rfftfreq(length, d=1.0 / fs)[peak], power[np.arange(len(power)), peak]]
    return [pa.array(v) for v in found]


def _time_columns(block: np.ndarray) -> list[pa.Array]:
    mean, low, high = block.mean(axis=1), block.min(axis=1), block.max(axis=1)
    off = block - mean[:, None]
    square = off * off
    var = square.mean(axis=1)
    flat = high == low
    safe = np.where(flat, 1.0, var)
    shape = [(square * off).mean(axis=1) / safe**1.5, (square * square).mean(axis=1) / safe**2 - 3.0]
    rms = np.sqrt((block * block).mean(axis=1))
    found = [mean, np.sqrt(var), low, high, high - low, rms]
    return [*[pa.array(v) for v in found], *[pa.array(v, mask=flat) for v in shape]]


def _columns(block: np.ndarray, fs: float) -> dict[str, pa.Array]:
    return dict(zip(ALL_FEATURES, [*_time_columns(block), *_spectral_columns(block, fs)]))


def window_features(grid: DataFrame, channels, length: int, step: int, fs: float, names=ALL_FEATURES) -> DataFrame:
    """(keys, names): any of the fourteen features of each window and channel of a normalised grid."""

    def describe(first: int, blocks: dict) -> pa.Table:
        found = {c: _columns(block, fs) for c, block in blocks.items()}
        return _stacked(first, {c: {n: columns[n] for n in names} for c, columns in found.items()})

    schema = "w long, channel string, " + ", ".join(f"`{n}` double" for n in names)
    return _per_block(grid, channels, length, step, describe, schema)


def window_autocorrelation(grid: DataFrame, channels, length: int, step: int) -> DataFrame:
    """(keys, r): Pearson correlation of each window of a grid with itself one step later, NULL where undefined."""

    def describe(first: int, blocks: dict) -> pa.Table:
        parts = {}
        for channel, block in blocks.items():
            x, y = block[:, :-1], block[:, 1:]
            flat = (x.max(axis=1) == x.min(axis=1)) | (y.max(axis=1) == y.min(axis=1))
            x, y = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
            size = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
            parts[channel] = {"r": pa.array((x * y).sum(axis=1) / np.where(flat, 1.0, size), mask=flat)}
        return _stacked(first, parts)

    return _per_block(grid, channels, length, step, describe, "w long, channel string, r double")


def wide_window_features(grid: DataFrame, channels, length: int, step: int, fs: float) -> DataFrame:
    """(flight_id, w, <channel>_<feature>): one row per window; undefined statistics are 0."""

    def describe(first: int, blocks: dict) -> pa.Table:
        columns = {}
        for channel, block in blocks.items():
            columns.setdefault("w", pa.array(np.arange(first, first + len(block))))
            for name, values in _columns(block, fs).items():
                columns[f"{channel}_{name}"] = values.fill_null(0.0)
        return pa.table(columns)

    schema = "w long, " + ", ".join(f"`{c}_{n}` double" for c in channels for n in ALL_FEATURES)
    return _per_block(grid, channels, length, step, describe, schema)


def combine_features(time_part: DataFrame, freq_part: DataFrame, keys=KEYS) -> DataFrame:
    return time_part.join(freq_part, list(keys))


def wide_features(features: DataFrame, channels, names=ALL_FEATURES) -> DataFrame:
    """One row per window, columns `<channel>_<feature>`; missing statistics become 0."""
    pivoted = features.groupBy("flight_id", "w").pivot("channel", list(channels)).agg(
        *[F.first(n).alias(n) for n in names]
    )
    columns = [f"{c}_{n}" if len(names) > 1 else c for c in channels for n in names]
    filled = [F.coalesce(c, F.lit(0.0)).alias(f"{ch}_{n}") for c, (ch, n) in zip(columns, _pairs(channels, names))]
    return pivoted.select("flight_id", "w", *filled)


def _pairs(channels, names):
    return [(c, n) for c in channels for n in names]


def flatten_windows(windows: DataFrame) -> DataFrame:
    """(flight_id, w, vec): all values of a window, by position and then channel."""
    values = F.sort_array(F.collect_list(F.struct("i", "channel", "value"))).getField("value")
    return windows.groupBy("flight_id", "w").agg(values.alias("vec"))


def lag1_autocorrelation(windows: DataFrame, keys=KEYS) -> DataFrame:
    """Pearson correlation of each window with itself one step later, NULL where undefined."""
    before = F.lag("value").over(W.partitionBy(*keys).orderBy("i"))
    pairs = windows.withColumn("x", before).where(F.col("x").isNotNull()).withColumnRenamed("value", "y")
    moments = pairs.groupBy(*keys).agg(
        F.covar_pop("x", "y").alias("cov"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy")
    )
    return moments.select(*keys, ratio(F.col("cov"), F.col("sx") * F.col("sy")).alias("r"))
