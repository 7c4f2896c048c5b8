"""Exact percentiles of groups of any size.

The built-in exact percentile keeps every distinct value of a group in one buffer. Here a sketch with a guaranteed rank error
(`percentile_approx`) bounds each wanted value from both sides in a first pass; the second pass counts what lies below the
bounds and ranks only the values between them, a share of about 12 / ACCURACY of a group for each percentile. How the values
are spread does not matter, as the bounds follow ranks. Groups of up to SMALL rows are ranked as a whole.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.numeric import missing_to_null
from ..settings import BROADCAST_ROWS
from .joins import attach, attach_counted

# The sketch's rank error is 1 / ACCURACY of a group; bounds are taken SLACK away, which also covers the step from shares
# to whole ranks in groups of more than SMALL rows.
ACCURACY, SMALL = 10_000, 10_000
SLACK = 5 / ACCURACY


def counted_values(rows: DataFrame, keys, bound) -> DataFrame:
    """(keys, x, c): one row per value with its count where the group rows cannot be broadcast, else c = 1.

    A value that fills a group is then a single row before the join that attaches the group's range.
    """
    if bound is not None and bound <= BROADCAST_ROWS:
        return rows.withColumn("c", F.lit(1).cast("long"))
    return rows.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("c"))


def exact_percentiles(df: DataFrame, keys, value, probs, bound=None) -> DataFrame:
    """(keys, p, n, x): linearly interpolated percentiles of `value` per group; NULL and NaN are skipped.

    `bound` limits the number of groups (see `attach`); without it the rows are counted and read once more.
    """
    keys, probs = list(keys), [float(p) for p in probs]
    rows = df.select(*keys, missing_to_null(F.col(value).cast("double")).alias("x")).where(F.col("x").isNotNull())

    shares = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-SLACK, SLACK)})
    near = F.percentile_approx("x", shares, ACCURACY)
    sketch = rows.groupBy(*keys).agg(F.count("x").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), near.alias("near"))
    whole = F.col("n") <= SMALL

    def bounds(p: float):
        low, high = (shares.index(min(1.0, max(0.0, p + d))) for d in (-SLACK, SLACK))
        low = F.when(whole | (p - SLACK <= 0), F.col("least")).otherwise(F.get("near", F.lit(low)))
        high = F.when(whole | (p + SLACK >= 1), F.col("most")).otherwise(F.get("near", F.lit(high)))
        return F.struct(F.lit(p).alias("p"), low.alias("low"), high.alias("high"))

    sketch = sketch.select(*keys, "n", F.array(*[bounds(p) for p in sorted(set(probs))]).alias("bounds"))
    if not keys:
        found = sketch.select(F.struct("n", "bounds")).scalar()  # one row
        placed = rows.withColumn("s", found).select("x", F.col("s.n").alias("n"), F.inline("s.bounds"))
    elif bound is None:
        placed = attach_counted(rows, sketch, keys, rows.count()).select(*keys, "x", "n", F.inline("bounds"))
    else:
        placed = attach(rows, sketch, keys, bound=bound, spread=["x"]).select(*keys, "x", "n", F.inline("bounds"))

    # Values below the bounds are one row of a group and percentile, those above are not needed.
    inside = F.when(F.col("x") >= F.col("low"), F.col("x"))
    counts = placed.where("x <= high").groupBy(*keys, "p", "n", inside.alias("x")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(W.partitionBy(*keys, "p").orderBy(F.asc_nulls_first("x")).rowsBetween(W.unboundedPreceding, 0))
    counts = counts.withColumn("upto", upto).withColumn("place", F.col("p") * (F.col("n") - 1))

    def at(rank):
        return F.max(F.when((F.col("upto") - F.col("c") <= rank) & (rank < F.col("upto")), F.col("x")))

    ends = counts.groupBy(*keys, "p", "n", "place").agg(at(F.floor("place")).alias("x0"), at(F.ceil("place")).alias("x1"))
    x = F.col("x0") + (F.col("x1") - F.col("x0")) * (F.col("place") - F.floor("place"))
    return ends.select(*keys, "p", "n", x.alias("x"))


def percentile_columns(df: DataFrame, keys, value, names: dict[str, float], bound=None) -> DataFrame:
    """One row per group with a column per named percentile."""
    found = exact_percentiles(df, keys, value, names.values(), bound)
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("p") == p, F.col("x"))).alias(n) for n, p in names.items()])
