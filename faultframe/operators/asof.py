"""The nearest row in time for unevenly spaced times, over keys of any size."""

from pyspark.sql import DataFrame, Window as W, functions as F

from .joins import attach_counted
from .ordered import FAN, explode_range

# Rows and requests of a key that one task puts in order at a time, where its times are evenly spread; a parameter of the shuffle only.
CHUNK_ROWS = 50_000


def _carried(heads: DataFrame, key: str) -> DataFrame:
    """(key, chunk, before, after): the last row of the earlier chunks and the first of the later ones, in two levels."""
    heads = heads.withColumn("block", F.floor(F.col("chunk") / FAN))
    blocks = heads.groupBy(key, "block").agg(F.max("last").alias("last"), F.min("first").alias("first"))
    earlier = W.partitionBy(key).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    # What follows is read from the end: a frame up to the last row would be gone through again for every row.
    later = W.partitionBy(key).orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(key, "block", F.max("last").over(earlier).alias("far_before"), F.min("first").over(later).alias("far_after"))
    inside = W.partitionBy(key, "block")
    return (
        heads.select(
            key, "block", "chunk",
            F.max("last").over(inside.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)).alias("before"),
            F.min("first").over(inside.orderBy(F.desc("chunk")).rowsBetween(W.unboundedPreceding, -1)).alias("after"),
        )
        .join(blocks, [key, "block"])
        .select(key, "chunk", F.coalesce("before", "far_before").alias("before"), F.coalesce("after", "far_after").alias("after"))
    )


def nearest_in_time(requests: DataFrame, rows: DataFrame, key="flight_id", asked="asked", time="t", name="w") -> DataFrame:
    """(request columns, name, time, gap): the row of the same key whose time is nearest to `asked`.

    Times need not be evenly spaced. On ties the earlier row comes, of rows with equal times that of the lowest `name`.
    Every request has its row; one without a time, or of a key without rows, has NULLs. Requests and rows are merged in
    chunks of time, and what lies nearest beyond a chunk's borders is carried over on both sides, so no task holds a key.
    """
    columns = requests.columns
    points = rows.where(F.col(time).isNotNull()).groupBy(F.col(key).alias("__key"), F.col(time).cast("double").alias("__t"))
    points = points.agg(F.min(name).alias("__name"))
    # Equal requests are one row until the end.
    kinds = requests.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    kinds = kinds.withColumns({"__key": F.col(key), "__t": F.col(asked).cast("double")})
    # Chunks follow the requests too, which may be many more than the rows; keys without rows have none.
    finite = F.when(F.abs("__t") < float("inf"), F.col("__t"))
    facts = [F.count(F.lit(1)).alias("n"), F.min(finite).alias("low"), F.max(finite).alias("high")]
    sizes = points.groupBy("__key").agg(F.lit(True).alias("has"), *facts).unionByName(kinds.groupBy("__key").agg(F.lit(False).alias("has"), *facts))
    sizes = sizes.groupBy("__key").agg(F.max("has").alias("has"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).where("has")
    most = F.ceil(F.col("n") / CHUNK_ROWS)
    width = (F.col("high") - F.col("low")) / most
    low = F.coalesce("low", F.lit(0.0))
    sizes = sizes.select("__key", "n", low.alias("low"), F.when(width > 0, width).otherwise(1.0).alias("width"), most.alias("most"))

    def chunked(df: DataFrame, how: str) -> DataFrame:
        counts = df.groupBy("__key").agg(F.count(F.lit(1)).alias("many")).join(sizes, "__key")
        placed = attach_counted(df, counts, "__key", df.count(), how, count="many").drop("many", "n")
        place = F.floor((F.col("__t") - F.col("low")) / F.col("width"))
        chunk = F.when(place.isNotNull(), F.greatest(F.lit(0), F.least(F.col("most") - 1, place)))
        return placed.withColumn("chunk", chunk).drop("low", "width", "most")

    points = chunked(points, "inner").select("__key", "chunk", "__t", F.struct(F.col("__t").alias("t"), F.col("__name").alias("name")).alias("point"))
    asking = chunked(kinds, "left")
    known = asking.where(F.col("chunk").isNotNull())
    both = points.withColumn("request", F.lit(None).cast(known.select(F.struct(*columns, "__n")).schema[0].dataType)).unionByName(
        known.select("__key", "chunk", "__t", F.lit(None).cast(points.schema["point"].dataType).alias("point"), F.struct(*columns, "__n").alias("request"))
    )
    heads = both.groupBy("__key", "chunk").agg(F.max("point").alias("last"), F.min("point").alias("first"))
    part, latest = W.partitionBy("__key", "chunk"), F.last("point", ignorenulls=True)
    upto, onward = (part.orderBy(t).rangeBetween(W.unboundedPreceding, 0) for t in (F.asc("__t"), F.desc("__t")))
    found = both.withColumns({"upto": latest.over(upto), "from": latest.over(onward)}).where("request is not null")
    found = found.join(_carried(heads, "__key"), ["__key", "chunk"])
    below, above, t = F.coalesce("upto", "before"), F.coalesce("from", "after"), F.col("__t")
    near = F.when(above.isNull() | (t - below["t"] <= above["t"] - t), below).otherwise(above)
    found = found.select("request.*", near.alias("near"))
    none = asking.where(F.col("chunk").isNull()).select(*columns, "__n", F.lit(None).cast(points.schema["point"].dataType).alias("near"))
    gap = F.abs(F.col("near.t") - F.col(asked).cast("double"))
    every = explode_range(found.unionByName(none), F.lit(1), F.col("__n"), "__k")
    return every.select(*columns, F.col("near.name").alias(name), F.col("near.t").alias(time), gap.alias("gap"))
