"""Channel statistics, normalisation, vector z-scores and imputation."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import finite_or_zero, is_infinite, missing_to_null, unit_if_zero
from .joins import attach


def to_long(wide: DataFrame, ids, channels) -> DataFrame:
    return wide.unpivot(list(ids), list(channels), "channel", "value")


def channel_stats(wide: DataFrame, channels) -> DataFrame:
    """(channel, mean, std): global mean and sample deviation of each channel column, one aggregate for all."""
    row = wide.agg(
        *[F.avg(missing_to_null(c)).alias(f"{c}__mean") for c in channels],
        *[F.stddev_samp(missing_to_null(c)).alias(f"{c}__std") for c in channels],
    )
    per_channel = [
        F.struct(F.lit(c).alias("channel"), F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__std").alias("std"))
        for c in channels
    ]
    return row.select(F.inline(F.array(*per_channel)))


def channel_stats_long(samples: DataFrame) -> DataFrame:
    """The same statistics of long (channel, value) rows."""
    value = missing_to_null("value")
    return samples.groupBy("channel").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def normalise(wide: DataFrame, stats: DataFrame, channels) -> DataFrame:
    """(x - mean) / std per channel column; a zero deviation counts as 1, what is not finite becomes 0."""
    channels = list(channels)
    picked = [
        F.max(F.when(F.col("channel") == c, F.struct("mean", unit_if_zero(F.col("std")).alias("std")))).alias(c)
        for c in channels
    ]
    one_row = stats.agg(*picked).select(F.struct(*channels).alias("s"))
    scaled = wide.withColumn("__s", one_row.scalar())

    def scale(c: str) -> Column:
        return finite_or_zero((F.col(c) - F.col(f"__s.{c}.mean")) / F.col(f"__s.{c}.std"))

    return scaled.withColumns({c: scale(c) for c in channels}).drop("__s")


def align_channels(samples: DataFrame, stats: DataFrame, n_channels: int) -> DataFrame:
    """Keep the long rows whose channel the statistics know; `n_channels` bounds the statistics' rows."""
    return attach(samples, stats.select("channel"), "channel", "left_semi", bound=n_channels)


def missing_counts(samples: DataFrame, value="value") -> DataFrame:
    """One row: how many values are NaN, infinite, and rows in all."""
    x = F.col(value)
    return samples.agg(
        F.count_if(x.isNull() | F.isnan(x)).alias("n_nan"),
        F.count_if(is_infinite(x)).alias("n_inf"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def vector_stats(vectors: DataFrame, vec="vec") -> DataFrame:
    """(pos, mean, std, n_missing) per vector position, population deviation, missing cells skipped."""
    cells = vectors.select(F.posexplode(vec).alias("pos", "x"))
    x = missing_to_null(F.col("x").cast("double"))
    return cells.groupBy("pos").agg(
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.count_if(x.isNull()).alias("n_missing")
    )


def zscore_vectors(vectors: DataFrame, stats: DataFrame, vec="vec", poison_nan=False) -> DataFrame:
    """z-score of array columns with given statistics; missing cells become 0.

    With `poison_nan` one missing training cell sends its whole position to 0, as statistics that do not skip
    NaN would.
    """
    mean, std = F.col("mean"), F.coalesce(unit_if_zero(F.col("std")), F.lit(1.0))
    if poison_nan:
        mean = F.when(F.col("n_missing") == 0, mean)
    ordered = F.sort_array(F.collect_list(F.struct("pos", mean.alias("mean"), std.alias("std"))))
    scaled = vectors.withColumn("__s", stats.agg(ordered.alias("s")).scalar())
    z = F.zip_with(vec, "__s", lambda x, s: finite_or_zero((x.cast("double") - s["mean"]) / s["std"]))
    return scaled.withColumn(vec, z).drop("__s")


def impute_mean(wide: DataFrame, columns) -> DataFrame:
    """Missing cells take the mean of their column."""
    means = wide.agg(F.struct(*[F.avg(missing_to_null(c)).alias(c) for c in columns]).alias("m"))
    filled = wide.withColumn("__m", means.scalar())
    return filled.withColumns({c: F.coalesce(missing_to_null(c), F.col(f"__m.{c}")) for c in columns}).drop("__m")
