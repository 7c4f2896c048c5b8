"""Ordered computations over keys of any size.

A key may hold a large share of all rows, so no window here covers a whole key. Rows are cut into chunks of
consecutive order values; windows run inside a chunk, and chunk totals are combined in two small levels.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Chunks combined by one task before the second level takes over.
FAN = 4096
# Longest array an exploding expression may build.
RUN = 65536


def explode_range(df: DataFrame, low: Column, high: Column, out: str, keys=None) -> DataFrame:
    """One row per integer in [low, high]; the arrays behind it never exceed RUN elements.

    With `keys` (for few rows with long ranges) the runs of one range are spread over all tasks first.
    """
    df = df.withColumn("__low", low.cast("long")).withColumn("__high", high.cast("long"))
    df = df.where("__low <= __high")
    df = df.withColumn("__run", F.explode(F.sequence(F.floor(F.col("__low") / RUN), F.floor(F.col("__high") / RUN))))
    if keys is not None:
        # A fixed number of partitions: the run rows are small, what they expand to is not.
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartition(tasks, *keys, "__run")
    first = F.greatest(F.col("__low"), F.col("__run") * RUN)
    last = F.least(F.col("__high"), F.col("__run") * RUN + (RUN - 1))
    return df.withColumn(out, F.explode(F.sequence(first, last))).drop("__low", "__high", "__run")


def chunk_offsets(totals: DataFrame, keys, chunk: str, columns) -> DataFrame:
    """For each chunk: `before_<c>`, the sum over earlier chunks of its key, and `all_<c>`, over the whole key."""
    keys = list(keys)
    totals = totals.withColumn("__group", F.floor(F.col(chunk) / FAN))
    groups = totals.groupBy(*keys, "__group").agg(*[F.sum(c).alias(c) for c in columns])
    earlier = W.partitionBy(*keys).orderBy("__group").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    groups = groups.select(
        *keys,
        "__group",
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__top_{c}") for c in columns],
        *[F.sum(c).over(whole).alias(f"all_{c}") for c in columns],
    )
    inside = W.partitionBy(*keys, "__group").orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    return (
        totals.withColumns({f"__in_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns})
        .join(groups, [*keys, "__group"])
        .select(
            *keys,
            chunk,
            *[(F.col(f"__in_{c}") + F.col(f"__top_{c}")).alias(f"before_{c}") for c in columns],
            *[f"all_{c}" for c in columns],
        )
    )


def row_index(df: DataFrame, keys, order, chunk: Column, out="idx", total="n_key") -> DataFrame:
    """Exact 0-based position of each row inside its key, and the size of the key.

    `chunk` must never decrease along `order`.
    """
    keys = list(keys)
    rows = df.withColumn("__chunk", chunk.cast("long"))
    sizes = rows.groupBy(*keys, "__chunk").agg(F.count(F.lit(1)).alias("n"))
    inside = W.partitionBy(*keys, "__chunk").orderBy(*order)
    return (
        rows.withColumn("__pos", F.row_number().over(inside) - 1)
        .join(chunk_offsets(sizes, keys, "__chunk", ["n"]), [*keys, "__chunk"])
        .withColumn(out, (F.col("__pos") + F.col("before_n")).cast("long"))
        .withColumnRenamed("all_n", total)
        .drop("__chunk", "__pos", "before_n")
    )


def running_sums(df: DataFrame, keys, order, chunk: Column, columns: dict[str, str]) -> DataFrame:
    """Inclusive running sums inside each key: `columns` maps an input column to its output name."""
    keys = list(keys)
    rows = df.withColumn("__chunk", chunk.cast("long"))
    totals = rows.groupBy(*keys, "__chunk").agg(*[F.sum(c).alias(c) for c in columns])
    inside = W.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({f"__run_{c}": F.sum(c).over(inside) for c in columns})
    rows = rows.join(chunk_offsets(totals, keys, "__chunk", list(columns)), [*keys, "__chunk"])
    rows = rows.withColumns({name: F.col(f"__run_{c}") + F.col(f"before_{c}") for c, name in columns.items()})
    return rows.drop("__chunk", *[f"{p}{c}" for c in columns for p in ("__run_", "before_", "all_")])
