"""Recordings: assembling channel groups, loading folders of flights, file inventories."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.labels import file_labels
from ..functions.numeric import missing_to_null
from ..operators.joins import attach


def _channels(group: DataFrame, key: str) -> list[str]:
    return [c for c in group.columns if c not in (key, "sample", "t")]


def _long(group: DataFrame, key: str) -> DataFrame:
    channels = _channels(group, key)
    doubles = group.select(key, "sample", "t", *[F.col(c).cast("double").alias(c) for c in channels])
    rows = doubles.unpivot([key, "sample", "t"], channels, "channel", "value")
    return rows.withColumn("value", missing_to_null("value"))


def group_sizes(main: DataFrame, group: DataFrame, key="flight_id") -> DataFrame:
    """(key, n, n_main, kept): an optional group counts only where it is as long as the time vector."""
    n_main = main.groupBy(key).agg(F.count(F.lit(1)).alias("n_main"))
    sizes = group.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(n_main, key, "left")
    return sizes.withColumn("kept", F.coalesce(F.col("n") == F.col("n_main"), F.lit(False)))


def assemble_flight(main: DataFrame, groups=(), key="flight_id", check=True) -> DataFrame:
    """(key, sample, t, channel, value) of a main group (key, sample, t, ...) and optional ones (key, sample, ...).

    Flights that appear only in an optional group have no clock and are an error. An optional group of another
    length than the main group is left out for that flight.
    """
    parts = [_long(main, key)]
    clock = main.select(key, "sample", "t")
    for group in groups:
        sizes = group_sizes(main, group, key)
        if check:
            orphan = sizes.where(F.col("n_main").isNull()).select(key).first()
            if orphan is not None:
                raise ValueError(f"main channel group missing for flight {orphan[0]}")
        fitting = sizes.where("kept").select(key)
        kept = attach(group, fitting, key, "left_semi", spread=["sample"])
        parts.append(_long(kept.join(clock, [key, "sample"]), key))
    return reduce(DataFrame.unionByName, parts)


def load_all(spark: SparkSession, root: str, pattern="*.parquet", name_from="file", schema=None) -> DataFrame:
    """Every recording under `root` with its file name and the labels in it.

    `name_from` tells where the flight's name is: in the file name or in that of its folder, for recordings that
    were split into several files.
    """
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    rows = (reader.schema(schema) if schema is not None else reader).parquet(root)
    path = F.split(F.col("_metadata.file_path"), "/")
    name = F.element_at(path, -1 if name_from == "file" else -2)
    named = rows.select(F.url_decode(name).alias("file_name"), "*")
    return named.select("*", *[v.alias(k) for k, v in file_labels(F.col("file_name")).items()])


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """(file_name, extension, bytes, mb), largest first; only listings are read, no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        name.alias("file_name"),
        F.regexp_extract(name, r"(\.[^.]*)$", 1).alias("extension"),
        F.col("length").alias("bytes"),
        (F.col("length") / (1024.0 * 1024.0)).alias("mb"),
    ).orderBy(F.desc("bytes"), "file_name")


def inventory_totals(inventory: DataFrame) -> DataFrame:
    return inventory.agg(F.count(F.lit(1)).alias("n_files"), F.sum("mb").alias("total_mb"))
