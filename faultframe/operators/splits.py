"""Reproducible sampling, stratified splits and class weights."""

from pyspark.sql import DataFrame, functions as F

from ..functions.labels import hash_bucket, hash_key
from .joins import attach
from .ordered import row_index


def subsample(df: DataFrame, ids, count: int, seed=42) -> DataFrame:
    """min(count, N) rows without replacement: those with the lowest hash of their identity.

    Counts per hash bucket (65,536 at most) tell up to which bucket rows can be among them; only those are sorted, so
    the one task that takes the first `count` gets little more than that, however many tasks there are.
    """
    order = hash_key(seed, *ids)
    sizes = df.groupBy(hash_bucket(order).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).orderBy("bucket").collect()
    last, seen = 1 << 16, 0
    for row in sizes:
        seen += row.n
        if seen >= count:
            last = row.bucket
            break
    return df.where(hash_bucket(order) <= last).orderBy(order, *ids).limit(count)


def stratified_split(df: DataFrame, ids, label: str, fraction=0.2, seed=42, group_by=None) -> DataFrame:
    """Adds `is_test`: exactly round(fraction * n) rows of each label, in hash order.

    With `group_by` whole groups (such as flights) are drawn, each counted once under its label, so that
    overlapping windows never straddle the split. The input is read twice (chunk sizes, rows): draw from the list
    of ids and labels and join the result, rather than from computed features.
    """
    if group_by is not None:
        groups = df.groupBy(group_by).agg(F.min(label).alias("__label"))
        drawn = stratified_split(groups, [group_by], "__label", fraction, seed).select(group_by, "is_test")
        return attach(df, drawn, group_by, spread=ids)
    hashed = df.withColumn("__hash", hash_key(seed, *ids))
    ranked = row_index(hashed, [label], ["__hash", *ids], hash_bucket(F.col("__hash")), out="__rank", total="__n")
    is_test = F.col("__rank") < F.round(F.col("__n") * F.lit(fraction))
    return ranked.withColumn("is_test", is_test).drop("__hash", "__rank", "__n")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): balanced weights n_rows / (n_classes * n_label)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes")).alias("t"))
    weighed = counts.withColumn("__t", totals.scalar())
    return weighed.select(label, "n", (F.col("__t.rows") / (F.col("__t.classes") * F.col("n"))).alias("weight"))
