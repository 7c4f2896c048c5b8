"""The processed data set on disk: windows, window labels, channel statistics and the type dictionary."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

# Windows of one flight that share a file.
WINDOWS_PER_FILE = 256


@dataclass
class Dataset:
    windows: DataFrame
    labels: DataFrame
    stats: DataFrame
    types: DataFrame


def write_dataset(data: Dataset, path: str) -> None:
    """Windows and labels are partitioned by flight; a long flight is spread over several tasks and files."""
    for name in ("windows", "labels"):
        table = getattr(data, name).repartition("flight_id", F.floor(F.col("w") / WINDOWS_PER_FILE))
        table.write.mode("overwrite").partitionBy("flight_id").parquet(f"{path}/{name}")
    data.stats.write.mode("overwrite").parquet(f"{path}/stats")
    data.types.write.mode("overwrite").json(f"{path}/types")


def read_dataset(spark: SparkSession, path: str) -> Dataset:
    """`path` may be any URI the cluster can read (file:, hdfs:, s3a: ...)."""
    return Dataset(
        spark.read.parquet(f"{path}/windows"),
        spark.read.parquet(f"{path}/labels"),
        spark.read.parquet(f"{path}/stats"),
        spark.read.schema("fault_type string, type_id int").json(f"{path}/types"),
    )
