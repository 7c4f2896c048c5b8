"""Live monitoring: event-time windows and running flight status as streaming queries."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.features import time_aggregates
from ..operators.monitor import status_text

LIVE_FEATURES = ("mean", "std", "min", "max", "ptp", "rms")
# State of many values to a key is kept on disk, with so much memory of an executor for its pages.
STORE = "spark.sql.streaming.stateStore"
PAGED = {
    f"{STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{STORE}.rocksdb.boundedMemoryUsage": "true",
    f"{STORE}.rocksdb.maxMemoryUsageMB": "256",
}


def read_stream(spark: SparkSession, folder: str, schema, pattern="*.parquet", files_per_trigger=None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def event_time(ts: Column) -> Column:
    """Watermarks need a zoned timestamp."""
    return ts.cast("timestamp")


def live_windows(stream: DataFrame, win: str, step: str, delay: str, value="value", key="flight_id") -> DataFrame:
    """(key, start, end, n, features) per sliding event-time window; rows later than `delay` are dropped."""
    exprs = time_aggregates(value)
    timed = stream.withWatermark("ts", delay)
    grouped = timed.groupBy(key, F.window("ts", win, step).alias("span"))
    found = grouped.agg(F.count(F.lit(1)).alias("n"), *[exprs[n].alias(n) for n in LIVE_FEATURES])
    return found.select(key, F.col("span.start").alias("start"), F.col("span.end").alias("end"), "n", *LIVE_FEATURES)


def running_status(scored: DataFrame, by=("flight_id",)) -> DataFrame:
    """(by, seen, faulty_share, latest_severity, status) over all windows that have arrived.

    State is one row per flight and never expires, as a flight's totals must not.
    """
    latest = F.max(F.struct("w", "severity_level", "fault_label")).alias("last")
    totals = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("seen"), F.avg("fault_label").alias("faulty_share"), latest
    )
    return totals.select(
        *by, "seen", "faulty_share", F.col("last.severity_level").alias("latest_severity"),
        status_text(F.col("last.fault_label")).alias("status"),
    )


def run_available(result: DataFrame, folder: str, mode="update", transform=None) -> None:
    """Process everything available and store each batch under its number, so that a retried batch replaces itself.

    `transform` (for example a fitted model's transform) is applied to each batch.
    """

    def store(batch: DataFrame, number: int) -> None:
        ready = transform(batch) if transform else batch
        ready.write.mode("overwrite").parquet(f"{folder}/data/batch={number}")

    conf = result.sparkSession.conf
    wanted = PAGED if "TransformWithState" in result._jdf.queryExecution().analyzed().toString() else {}
    before = {k: conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            conf.set(k, v)
        query = (
            result.writeStream.outputMode(mode)
            .option("checkpointLocation", f"{folder}/progress")
            .trigger(availableNow=True)
            .foreachBatch(store)
            .start()
        )
    finally:  # a query keeps the settings that it began with
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    query.awaitTermination()


def stored_updates(spark: SparkSession, folder: str, schema) -> DataFrame:
    """All stored rows with their batch number."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(full).parquet(f"{folder}/data")


def latest_state(updates: DataFrame, keys) -> DataFrame:
    """The last update of every key."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("s")).select(*keys, "s.*")
