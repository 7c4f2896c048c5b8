"""Registered monitoring queries on tables of any number of files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from faultframe.plans import queries_monitor
from faultframe.sources import views
from faultframe.streaming import live


@pytest.fixture
def many_partitions(spark):
    keys = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def events(spark, folder, n, hours):
    """`n` events in turn of twenty flights, evenly over `hours` from the first of 2024 on."""
    start, kinds = dt.datetime(2024, 1, 1), list(views.EVENT_CODES)
    rows = [(i, start + dt.timedelta(hours=hours * i / n), i % 4, kinds[i % 5], float(i * 7 % 23), f'{{"k": {i % 5}}}') for i in range(n)]
    kind = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_no_row_is_late_however_many_files_a_part_has(spark, tmp_path, many_partitions):
    sf = events(spark, tmp_path, 1000, 25 * 30)
    found = {tuple(r) for r in queries_monitor.g11_expiring(spark, sf).collect()}
    whole = live.running_status(views.predictions(spark, sf).where("model <> 'forest'"), ["model", "flight_id"])
    expected = {tuple(r) for r in whole.select("model", "flight_id", "seen", F.round("faulty_share", 6), "latest_severity", "status").collect()}
    assert found == expected and len(expected) == 40
