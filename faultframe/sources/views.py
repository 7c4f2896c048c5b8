"""The driver tables seen as sensor recordings.

Events of one type and one user residue form a flight; see FIXTURES.md for the definitions.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.labels import binary_fault, decoded_fault_name, file_labels
from ..functions.numeric import severity_level
from ..operators.resample import flight_spans
from ..operators.windows import window_centres, window_shape
from ..settings import STEP_SEC, TARGET_FS, WIN_SEC

CHANNELS = ("q_1", "q_2", "q_3")
# One device second lasts this many seconds of event time.
SECONDS_PER_DEVICE_SECOND = 90_000
EVENT_CODES = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}
# Model name and the share of its windows, in sixteenths, whose prediction is perturbed.
PREDICTION_MODELS = {"boost": 1, "forest": 2, "neighbours": 4}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_code():
    code = None
    for name, value in EVENT_CODES.items():
        test = F.col("event_type") == name
        code = F.when(test, F.lit(value)) if code is None else code.when(test, F.lit(value))
    return code


def flight_key(events: DataFrame) -> DataFrame:
    sv = (F.col("user_id") % 4).cast("int")
    return events.withColumns(
        {"sv": sv, "code": event_code(), "flight_id": F.concat_ws("_", "event_type", sv.cast("string"))}
    )


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(flight_id, event_id, t, q_1, q_2, q_3): wide recordings in device seconds."""
    events = flight_key(table(spark, sf_dir, "events"))
    micros = F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")), F.col("ts"))
    return events.select(
        "flight_id",
        "event_id",
        (micros / F.lit(1e6) / F.lit(float(SECONDS_PER_DEVICE_SECOND))).alias("t"),
        F.col("value").alias("q_1"),
        F.get_json_object("props", "$.k").cast("double").alias("q_2"),
        F.col("user_id").cast("double").alias("q_3"),
    )


def flight_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(flight_id, file_name), one row per flight."""
    flights = flight_key(table(spark, sf_dir, "events")).select("flight_id", "code", "sv").distinct()
    code, sv = F.col("code"), F.col("sv")
    name = F.concat(
        F.lit("D"), (code % 3 + 1).cast("string"), F.lit("_F"), code.cast("string"), F.lit("_SV"), sv.cast("string"),
        F.lit("_SP"), (sv % 2 + 1).cast("string"), F.lit("_t"), (code + 1).cast("string"), F.lit(".mat"),
    )
    return flights.select("flight_id", name.alias("file_name"))


def flight_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = flight_files(spark, sf_dir)
    return files.select("flight_id", "file_name", *[v.alias(k) for k, v in file_labels(F.col("file_name")).items()])


def flight_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(flight_id, y_fault, y_type, y_sev) with the fault code of the file name as type."""
    labels = flight_labels(spark, sf_dir)
    code = F.regexp_extract("file_name", r"_F(\d+)_", 1).cast("int")
    return labels.select(
        "flight_id", binary_fault(F.col("healthy")).alias("y_fault"), code.alias("y_type"), F.col("severity").alias("y_sev")
    )


def windows(spark: SparkSession, sf_dir: str, fs=TARGET_FS) -> DataFrame:
    """(flight_id, w, t, y_fault, y_type, y_sev): every window of every flight, labelled before it is expanded."""
    spans = flight_spans(raw(spark, sf_dir), fs).join(flight_truth(spark, sf_dir), "flight_id")
    length, step = window_shape(WIN_SEC, STEP_SEC, fs)
    return window_centres(spans, length, step).select("flight_id", "w", "t", "y_fault", "y_type", "y_sev")


def predictions(spark: SparkSession, sf_dir: str, fs=TARGET_FS) -> DataFrame:
    """Predictions of several models: the truth, perturbed where the hash of (model, flight, window) says so."""
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(c).alias("cut")) for m, c in PREDICTION_MODELS.items()])
    rows = windows(spark, sf_dir, fs).withColumn("m", F.explode(models)).select("m.model", "m.cut", "*")
    digest = F.md5(F.concat_ws("|", "model", "flight_id", F.col("w").cast("string")))
    rows = rows.withColumn("h", digest)

    def digits(start, length):
        return F.conv(F.substring("h", start, length), 16, 10).cast("int")

    wrong = digits(1, 1) < F.col("cut")
    high = (F.col("y_fault") == 1) != wrong
    prob = digits(3, 2) / F.lit(512.0) + F.when(high, F.lit(0.5)).otherwise(F.lit(0.0))
    continuous = F.col("y_sev") + (digits(2, 1) - 8) / F.lit(8.0) + F.when(wrong, F.lit(1.0)).otherwise(F.lit(0.0))
    kind = F.when(wrong, (F.col("y_type") + 1) % 5).otherwise(F.col("y_type"))
    rows = rows.withColumns({"fault_prob": prob, "severity_continuous": continuous, "fault_type": kind})
    return rows.select(
        "model", "flight_id", "w", "t", "y_fault", "y_type", "y_sev", "fault_prob",
        (F.col("fault_prob") >= 0.5).cast("int").alias("fault_label"),
        "fault_type",
        "severity_continuous",
        severity_level(F.col("severity_continuous")).alias("severity_level"),
        decoded_fault_name(F.col("fault_type")).alias("fault_type_name"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, vec, label) with DOUBLE cells."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, epoch, train_loss, val_loss): order priorities as runs, order months as epochs."""
    orders = table(spark, sf_dir, "orders")
    epoch = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("int")
    by_month = orders.groupBy(epoch.alias("epoch")).agg((F.avg("o_totalprice") / 1000).alias("train_loss"))
    by_run = orders.groupBy(F.col("o_orderpriority").alias("run"), epoch.alias("epoch")).agg(
        (F.avg("o_totalprice") / 1000).alias("val_loss")
    )
    return by_run.join(by_month, "epoch").select("run", "epoch", "train_loss", "val_loss")


def line_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(class, channel, value): numeric line-item columns as long channel values."""
    items = table(spark, sf_dir, "lineitem")
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return items.select(F.col("l_returnflag").alias("class"), *columns).unpivot(["class"], columns, "channel", "value")
