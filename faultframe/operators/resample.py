"""Uniform resampling of flights and index resampling of trajectories."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .ordered import FAN, explode_range, row_index


def grid_size(t0: Column, t1: Column, fs: float) -> Column:
    """Number of evenly spaced points that cover [t0, t1], both ends included."""
    return (F.floor((t1 - t0) * F.lit(float(fs))) + 1).cast("long")


def grid_time(k: Column, n: Column, t0: Column, t1: Column) -> Column:
    step = (t1 - t0) / F.when(n > 1, n - 1)
    return F.when(n == 1, t0).when(k == n - 1, t1).otherwise(k * step + t0)


def flight_spans(samples: DataFrame, fs: float, key="flight_id", time="t") -> DataFrame:
    """(key, t0, t1, n): first and last sample time and the grid size of each flight."""
    spans = samples.groupBy(key).agg(F.min(time).alias("t0"), F.max(time).alias("t1"))
    return spans.withColumn("n", grid_size(F.col("t0"), F.col("t1"), fs))


def resample(samples: DataFrame, fs: float, channels, key="flight_id", time="t", tie=(), chunk_points=4096) -> DataFrame:
    """Linear interpolation of every channel on n evenly spaced points from the first to the last sample.

    `samples` is wide: key, time and one column per channel. Returns (key, k, n, t, channels). Of samples with
    equal times the last by `tie` counts. One shuffle by (key, time chunk) serves both the look-ahead and the
    chunk heads that bridge chunk borders, so a flight of any length is spread over many tasks.
    """
    channels, tie = list(channels), list(tie)
    order = ["t", *tie]
    here = F.struct("t", *channels)
    rows = (
        samples.select(key, F.col(time).alias("t"), *tie, *channels)
        .withColumn("chunk", F.floor(F.col("t") / F.lit(chunk_points / fs)))
        # A fixed number of partitions: sparse recordings are small here and grow on the grid.
        .repartition(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), key, "chunk")
    )
    if tie:
        first = [F.min_by(here, F.struct(*order)).alias("head")]
    else:
        # Plain values keep this a hash aggregate; a struct would need a sort.
        first = [F.min("t").alias("t"), *[F.min_by(c, "t").alias(c) for c in channels]]
    heads = rows.groupBy(key, "chunk").agg(*first, F.max("t").alias("last_t"))
    heads = heads.select(
        key, "chunk", (F.col("head") if tie else here).alias("head"), "last_t", F.floor(F.col("chunk") / FAN).alias("block")
    )
    blocks = heads.groupBy(key, "block").agg(
        F.min_by("head", "chunk").alias("head"), F.min("head.t").alias("first_t"), F.max("last_t").alias("last_t")
    )
    per_key = W.partitionBy(key)
    blocks = blocks.select(
        key,
        "block",
        F.lead("head").over(per_key.orderBy("block")).alias("after_block"),
        F.min("first_t").over(per_key).alias("t0"),
        F.max("last_t").over(per_key).alias("t1"),
    )
    heads = (
        heads.withColumn("after", F.lead("head").over(W.partitionBy(key, "block").orderBy("chunk")))
        .join(blocks, [key, "block"])
        .select(key, "chunk", F.coalesce("after", "after_block").alias("after"), "t0", "t1")
    )
    segments = (
        rows.withColumn("next", F.lead(here).over(W.partitionBy(key, "chunk").orderBy(*order)))
        .join(heads, [key, "chunk"])
        .withColumn("next", F.coalesce("next", "after"))
        .withColumn("n", grid_size(F.col("t0"), F.col("t1"), fs))
    )

    t, t0, t1, n, ahead = F.col("t"), F.col("t0"), F.col("t1"), F.col("n"), F.col("next.t")
    step = (t1 - t0) / F.when(n > 1, n - 1)

    def first_point(at: Column) -> Column:
        """Index of the first grid point not before `at`; the same rule bounds both ends of a segment."""
        return F.when(at == t0, F.lit(0)).when(at == t1, n - 1).otherwise(F.least(F.ceil((at - t0) / step), n - 1))

    single = F.when((t == t0) & (ahead.isNull() | (ahead > t0)), F.lit(0)).otherwise(F.lit(-1))
    low = F.when(n == 1, F.lit(0)).when(ahead.isNull(), n - 1).otherwise(first_point(t))
    high = F.when(n == 1, single).when(ahead.isNull(), n - 1).otherwise(first_point(ahead) - 1)
    points = explode_range(segments, low, high, "k").withColumn("gt", grid_time(F.col("k"), n, t0, t1))
    gap = F.try_divide(F.col("gt") - t, ahead - t)

    def value(channel: str) -> Column:
        x, y = F.col(channel), F.col(f"next.{channel}")
        return F.when(ahead.isNull() | (F.col("gt") == t), x).otherwise((y - x) * gap + x)

    return points.select(key, "k", "n", F.col("gt").alias("t"), *[value(c).alias(c) for c in channels])


def resample_trajectory(positions: DataFrame, sizes: DataFrame, columns, chunk: Column, key="flight_id", time="t") -> DataFrame:
    """Bring each flight's positions to `n_points` points: the first ones when there are enough, else repeats.

    `sizes` has (key, n_points); `chunk` cuts the time axis and must not decrease with time. Returns (key, i, columns).
    """
    indexed = row_index(positions.select(key, time, *columns), [key], [time], chunk, out="j", total="length")
    lengths = positions.groupBy(key).agg(F.count(F.lit(1)).alias("length"))
    targets = explode_range(lengths.join(sizes, key), F.lit(0), F.col("n_points") - 1, "i", keys=[key])
    i, length, n_points = F.col("i"), F.col("length"), F.col("n_points")
    stretch = (length - 1).cast("double") / F.when(n_points > 1, n_points - 1)
    j = (
        F.when(length >= n_points, i)
        .when(i == 0, F.lit(0))
        .when(i == n_points - 1, length - 1)
        .otherwise(F.floor(i * stretch))
    )
    targets = targets.select(key, "i", j.cast("long").alias("j"))
    return targets.join(indexed.select(key, "j", *columns), [key, "j"]).select(key, "i", *columns)
