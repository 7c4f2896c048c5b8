"""Rendezvous hashing of stable record keys over weighted shards.

Each shard scores a key by -weight / ln(u), where u is a uniform hash of (key, shard); the highest score wins. A further
shard can only win keys for itself, so nothing moves between the old ones. DataFrame functions only.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.ordered import chunk_offsets, explode_range

SHARDS = 8
# Rows that one task numbers at a time; a parameter of the shuffle, not of the result.
RUN_ROWS = 100_000


def unit(*parts) -> Column:
    """A uniform hash in (0, 1)."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def shard_of(key: str, shards=SHARDS, weights=None) -> Column:
    """The shard of a key; shards of weight 0 get nothing. A NULL key is a key like any other."""
    everyone = F.sequence(F.lit(0), F.lit(shards - 1))
    if weights is None or len(set(weights)) == 1:  # then the highest score is that of the highest hash
        return F.array_max(F.transform(everyone, lambda s: F.struct(unit(F.col(key), s).alias("score"), s.alias("shard"))))["shard"]
    weight = lambda s: F.element_at(F.array(*[F.lit(float(w)) for w in weights]), s + 1)
    score = lambda s: -weight(s) / F.log(unit(F.col(key), s))
    return F.array_max(
        F.transform(F.filter(everyone, lambda s: weight(s) > 0), lambda s: F.struct(score(s).alias("score"), s.alias("shard")))
    )["shard"]


def assigned(docs: DataFrame, key="doc_id", shards=SHARDS, weights=None, grown_weight=1.0) -> DataFrame:
    """`docs` with `shard`, and `grown_shard`: the shard if there were one more."""
    docs = docs.drop("shard", "grown_shard")
    more = None if weights is None and grown_weight == 1.0 else [*(weights or [1.0] * shards), grown_weight]
    return docs.withColumns({"shard": shard_of(key, shards, weights), "grown_shard": shard_of(key, shards + 1, more)})


def with_slots(rows: DataFrame, key="doc_id") -> DataFrame:
    """`rows` (narrow, with `shard`) with `slot`, gapless from 0 in each shard, in the order of a hash of the row.

    A shard holds a large share of all rows, so rows are numbered in runs of the hash and the runs are added up. Equal
    rows are counted before they are shuffled and become rows again at the end, however many there are.
    """
    columns = rows.columns
    kinds = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    n = rows.select(F.count(F.lit(1))).first()[0]
    runs = max(1, n // RUN_ROWS)
    kinds = kinds.withColumn("h", F.xxhash64(*columns))
    kinds = kinds.withColumn("run", F.floor(F.shiftrightunsigned("h", 11).cast("double") / float(1 << 53) * runs))
    sizes = kinds.groupBy("shard", "run").agg(F.sum("n").alias("n"))
    order = W.partitionBy("shard", "run").orderBy("h", *columns).rowsBetween(W.unboundedPreceding, -1)
    kinds = kinds.withColumn("inside", F.coalesce(F.sum("n").over(order), F.lit(0)))
    offsets = chunk_offsets(sizes, ["shard"], "run", ["n"]).select("shard", "run", "before_n")
    kinds = kinds.join(offsets, ["shard", "run"]).withColumn("slot", F.col("inside") + F.col("before_n"))
    single = kinds.where("n = 1").select(*columns, "slot")
    repeated = explode_range(kinds.where("n > 1").drop("inside"), F.col("slot"), F.col("slot") + F.col("n") - 1, "slot", ["shard", "h"])
    return single.unionByName(repeated.select(*columns, "slot"))
