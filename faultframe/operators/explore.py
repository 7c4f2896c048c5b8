"""Exploratory statistics of windows, channels and labels."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import missing_to_null, pearson, ratio, ratio_or_zero
from ..settings import TOP_CHANNELS
from .features import lag1_autocorrelation
from .joins import attach
from .quantiles import counted_values, percentile_columns
from .splits import subsample


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """(label, n, pct)."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("pct", F.col("n") * 100.0 / total)


def label_counts(df: DataFrame, labels) -> DataFrame:
    """(label_set, label, n, pct) of several label columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("label_set"), F.col(c).cast("int").alias("label")) for c in labels])
    counts = df.select(F.inline(pairs)).groupBy("label_set", "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy("label_set")))


def balance_verdict(r: Column) -> Column:
    return F.when(r > 3, "high").when(r > 1.5, "moderate").otherwise("balanced")


def imbalance(counts: DataFrame) -> DataFrame:
    """(label_set, n_classes, imbalance, verdict) of a label_counts table."""
    per_set = counts.groupBy("label_set").agg(
        F.count(F.lit(1)).alias("n_classes"), ratio(F.max("n"), F.min("n")).alias("imbalance")
    )
    return per_set.withColumn("verdict", balance_verdict(F.col("imbalance")))


def channel_profile(samples: DataFrame, n_channels: int, quartiles=True) -> DataFrame:
    """Location, spread, range, share of zeros and, if wanted, quartiles per channel; `n_channels` bounds the groups."""
    x = missing_to_null("value")
    basic = samples.groupBy("channel").agg(
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        (F.avg((x == 0).cast("int")) * 100).alias("zeros_pct"),
    )
    basic = basic.withColumn("range", F.col("max") - F.col("min"))
    if not quartiles:
        return basic
    names = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    found = percentile_columns(samples.withColumn("value", x), ["channel"], "value", names, bound=n_channels)
    return basic.join(found, "channel").select(*basic.columns[:-1], *names, "range")


def quality_flags(profile: DataFrame, zeros=50.0, spread=0.01) -> DataFrame:
    """Channels with more than `zeros` percent zeros or a deviation below `spread`."""
    flags = profile.select(
        "channel", (F.col("zeros_pct") > zeros).alias("mostly_zero"), (F.col("std") < spread).alias("low_variance")
    )
    return flags.where("mostly_zero OR low_variance")


def extreme_ranges(profile: DataFrame) -> DataFrame:
    """One row: the channels with the largest and the smallest range, the lowest name on ties."""
    widest = F.min(F.struct((-F.col("range")).alias("r"), "channel"))
    narrowest = F.min(F.struct(F.col("range").alias("r"), "channel"))
    found = profile.agg(widest.alias("a"), narrowest.alias("b"))
    return found.select(
        F.col("a.channel").alias("widest"), (-F.col("a.r")).alias("largest_range"),
        F.col("b.channel").alias("narrowest"), F.col("b.r").alias("smallest_range"),
    )


def histogram(df: DataFrame, keys, value: str, bins=50, bound=None, by=()) -> DataFrame:
    """(keys, by, bin, low, high, n): equal-width bins per key, the last one closed, empty bins included.

    Rows are counted per `by` (such as a class) inside each key, each with its own bin range.
    """
    keys = [*keys, *by]
    grouped = keys or ["__all"]
    rows = (df if keys else df.withColumn("__all", F.lit(0))).select(
        *grouped, missing_to_null(F.col(value).cast("double")).alias("x")
    ).where(F.col("x").isNotNull())
    bound = bound if keys else 1
    rows = counted_values(rows, grouped, bound)
    edges = rows.groupBy(*grouped).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    half = F.when(flat, F.lit(0.5)).otherwise(F.lit(0.0))
    edges = edges.select(*grouped, (F.col("lo") - half).alias("lo"), (F.col("hi") + half).alias("hi"))
    edges = edges.withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    bin_of = F.least(F.floor((F.col("x") - F.col("lo")) / F.col("width")), F.lit(bins - 1)).cast("int")
    placed = attach(rows, edges, grouped, bound=bound, spread=["x"])
    counts = placed.groupBy(*grouped, bin_of.alias("bin")).agg(F.sum("c").alias("n"))
    every = edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(counts, [*grouped, "bin"], "left").select(
        *keys,
        "bin",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("low"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def box_stats(samples: DataFrame, n_channels: int) -> DataFrame:
    """Quartiles and whiskers: the outermost values within 1.5 interquartile ranges of the box."""
    quartiles = percentile_columns(
        samples, ["channel"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, bound=n_channels
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    fences = quartiles.withColumn("lo", F.col("q1") - reach).withColumn("hi", F.col("q3") + reach)
    joined = attach(samples, fences, "channel", bound=n_channels)
    x = missing_to_null("value")
    return joined.groupBy("channel", "q1", "median", "q3").agg(
        F.min(F.when(x >= F.col("lo"), x)).alias("whisker_low"), F.max(F.when(x <= F.col("hi"), x)).alias("whisker_high")
    )


def mean_autocorrelation(windows: DataFrame) -> DataFrame:
    """(channel, autocorr, n_windows): lag-1 autocorrelation averaged over the windows where it is defined."""
    return averaged_autocorrelation(lag1_autocorrelation(windows))


def averaged_autocorrelation(per_window: DataFrame) -> DataFrame:
    """The same from (channel, r) of each window."""
    return per_window.groupBy("channel").agg(
        F.coalesce(F.avg("r"), F.lit(0.0)).alias("autocorr"), F.count("r").alias("n_windows")
    )


def mean_window_std(windows: DataFrame) -> DataFrame:
    per_window = windows.groupBy("flight_id", "w", "channel").agg(F.stddev_pop(missing_to_null("value")).alias("std"))
    return per_window.groupBy("channel").agg(F.avg("std").alias("mean_std"))


def cross_tab(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, level, n) with margins `All`: level 0 a cell, 1 a row total, 2 a column total, 3 the grand total."""
    pairs = df.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
    cells = pairs.cube("a", "b").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"))
    over_a, over_b = F.col("level") >= 2, F.col("level") % 2 == 1
    return cells.withColumns(
        {"a": F.when(over_a, "All").otherwise(F.col("a")), "b": F.when(over_b, "All").otherwise(F.col("b"))}
    )


def separability(samples: DataFrame, label: str) -> DataFrame:
    """Range of the class means over the mean class deviation per channel, best first."""
    per_class = samples.groupBy("channel", label).agg(
        F.avg(missing_to_null("value")).alias("m"), F.stddev_pop(missing_to_null("value")).alias("s")
    )
    per_channel = per_class.groupBy("channel").agg(
        (F.max("m") - F.min("m")).alias("mean_range"), F.avg("s").alias("avg_std")
    )
    scored = per_channel.withColumn("separability", ratio_or_zero(F.col("mean_range"), F.col("avg_std")))
    return scored.orderBy(F.desc("separability"), "channel")


def top_channels(scored: DataFrame, count=TOP_CHANNELS) -> DataFrame:
    return scored.orderBy(F.desc("separability"), "channel").limit(count)


def correlation_pairs(wide: DataFrame, columns) -> DataFrame:
    """(a, b, n, r) for a <= b by position, missing values skipped pairwise.

    Each task folds its rows into one matrix of sums (rows of centred columns), so the shuffle carries one
    partial per task and column pair instead of one row per window and pair.
    """
    columns = list(columns)
    means = wide.agg(F.struct(*[F.avg(missing_to_null(c)).alias(c) for c in columns]).alias("m"))
    centred = wide.withColumn("__m", means.scalar())
    centred = centred.select(F.array(*[F.col(c) - F.col(f"__m.{c}") for c in columns]).alias("x"))
    return _pairs_of_vectors(centred, len(columns), F.array(*[F.lit(c) for c in columns]))


def vector_correlation_pairs(vectors: DataFrame, width: int, vec="vec") -> DataFrame:
    """The same for the positions of an array column; pairs are numbered by position."""
    cells = vectors.select(F.posexplode(vec).alias("pos", "x"))
    means = cells.groupBy("pos").agg(F.avg(missing_to_null("x")).alias("m"))
    means = means.agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("m"))
    centred = vectors.withColumn("__m", means.scalar())
    centred = centred.select(F.zip_with(vec, "__m", lambda x, m: x - m["m"]).alias("x"))
    return _pairs_of_vectors(centred, width, None)


def _pairs_of_vectors(centred: DataFrame, width: int, names) -> DataFrame:
    upper = np.triu_indices(width)

    def fold(batches):
        sums = np.zeros((6, width, width))
        for batch in batches:
            if len(batch):
                x = np.stack([np.asarray(v, dtype=float) for v in batch["x"]])
                ok = np.isfinite(x).astype(float)
                x = np.where(ok > 0, x, 0.0)
                square = x * x
                sums += [ok.T @ ok, x.T @ ok, ok.T @ x, square.T @ ok, ok.T @ square, x.T @ x]
        fields = {"ia": upper[0], "ib": upper[1]}
        fields.update({c: sums[i][upper] for i, c in enumerate(("n", "sx", "sy", "sxx", "syy", "sxy"))})
        yield pd.DataFrame(fields)

    schema = "ia int, ib int, n double, sx double, sy double, sxx double, syy double, sxy double"
    partials = centred.mapInPandas(fold, schema)
    totals = partials.groupBy("ia", "ib").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    r = pearson(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])

    def name(c):
        return F.col(c) if names is None else F.get(names, F.col(c))

    return totals.select(name("ia").alias("a"), name("ib").alias("b"), F.col("n").cast("long").alias("n"), r.alias("r"))


def strong_pairs(pairs: DataFrame, threshold=0.8) -> DataFrame:
    return pairs.where((F.col("a") != F.col("b")) & (F.abs("r") > threshold))


def top_pairs(pairs: DataFrame, threshold=0.8, count=20) -> DataFrame:
    """The strongest pairs with the number of all pairs above the threshold."""
    strong = strong_pairs(pairs, threshold)
    total = strong.agg(F.count(F.lit(1))).scalar()
    return strong.orderBy(F.desc(F.abs("r")), "a", "b").limit(count).withColumn("n_strong", total)


def value_summary(samples: DataFrame, value="value") -> DataFrame:
    x = missing_to_null(value)
    return samples.agg(
        F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"),
        F.count(x).alias("n_points"),
    )


def recommendations(imbalances: DataFrame, pairs: DataFrame, summary: DataFrame) -> DataFrame:
    """(rule, verdict) from the worst imbalance, the number of strong pairs and the value summary."""
    worst = imbalances.agg(F.max("imbalance")).scalar()
    strong = strong_pairs(pairs).agg(F.count(F.lit(1))).scalar()
    facts = summary.select("mean", "std", worst.alias("worst"), strong.alias("strong"))
    off_scale = (F.abs("mean") > 0.1) | (F.col("std") < 0.5) | (F.col("std") > 2)
    rules = F.array(
        F.struct(
            F.lit("class_balance").alias("rule"),
            F.when(F.col("worst") > 2, "use_class_weights").otherwise("acceptable").alias("verdict"),
        ),
        F.struct(
            F.lit("correlation").alias("rule"),
            F.when(F.col("strong") > 10, "reduce_features").otherwise("manageable").alias("verdict"),
        ),
        F.struct(
            F.lit("normalisation").alias("rule"),
            F.when(off_scale, "verify_normalisation").otherwise("good").alias("verdict"),
        ),
    )
    return facts.select(F.inline(rules))


def sampled_windows(grid: DataFrame, labels: DataFrame, channels, length: int, step: int, count=5, seed=42) -> DataFrame:
    """(flight_id, w, i, channel, value, y_fault): the values of a few random windows on all given channels.

    Windows are drawn from their list (`labels`); only their points, at most count * length, are looked up in the grid.
    """
    chosen = subsample(labels.select("flight_id", "w", "y_fault"), ["flight_id", "w"], count, seed)
    points = chosen.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    points = points.withColumn("k", (F.col("w") * step + F.col("i")).cast("long"))
    found = attach(grid.select("flight_id", "k", *channels), points, ["flight_id", "k"], bound=count * length)
    return found.drop("k").unpivot(["flight_id", "w", "i", "y_fault"], list(channels), "channel", "value")
