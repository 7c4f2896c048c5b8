"""Queries: flight monitoring, batch and streaming (G)."""

import math

from pyspark.sql import functions as F

from ..operators import asof, monitor as mon
from ..operators.models import predict
from ..operators.resample import resample_trajectory
from ..operators.windows import window_centres
from ..session import stored
from ..settings import TABLE_WINDOWS, TARGET_FS
from ..sources import views
from ..streaming import counted, live
from .catalog import query, r, rounded
from .queries_models import boosted, consistent
from .queries_prepare import CHANNELS, LENGTH, STEP, fresh_folder, spans, time_chunk


@query(
    "g1_flight_kpis",
    f"""SELECT model, flight_id, {r('avg(fault_prob) AS avg_fault_prob', 'avg(fault_label) AS faulty_share',
                                    'avg(severity_level) AS avg_severity')}, count(*) AS n_windows
        FROM pred GROUP BY model, flight_id""",
)
def g1(spark, sf):
    return rounded(mon.flight_kpis(views.predictions(spark, sf)))


@query(
    "g2_severity_distribution",
    "SELECT model, flight_id, severity_level, count(*) AS n FROM pred GROUP BY ALL",
)
def g2(spark, sf):
    return mon.severity_distribution(views.predictions(spark, sf))


def timeline(spark, sf):
    centres = window_centres(spans(spark, sf), LENGTH, STEP)
    return mon.timeline(centres, views.predictions(spark, sf).drop("t"))


@query(
    "g3_timeline",
    f"""SELECT model, flight_id, w, {r('t', 'fault_prob', 'CAST(fault_label AS DOUBLE) AS fault_label')}, severity_level FROM pred""",
)
def g3(spark, sf):
    return rounded(timeline(spark, sf))


@query(
    "g4_cumulative_status",
    f"""SELECT model, flight_id, w, {r('t')}, count(*) OVER o AS seen, CAST(sum(fault_label) OVER o AS BIGINT) AS faulty,
               {r('avg(fault_label) OVER o AS faulty_share', 'avg(fault_prob) OVER o AS mean_prob')}
        FROM pred WINDOW o AS (PARTITION BY model, flight_id ORDER BY w ROWS UNBOUNDED PRECEDING)""",
)
def g4(spark, sf):
    return rounded(mon.cumulative_status(views.predictions(spark, sf)))


@query(
    "g4_timeline_until",
    f"""SELECT model, flight_id, w, {r('t', 'fault_prob', 'CAST(fault_label AS DOUBLE) AS fault_label')}, severity_level
        FROM pred WHERE w <= 20""",
)
def g4_until(spark, sf):
    return rounded(mon.timeline_until(timeline(spark, sf), 20))


@query(
    "g5_nearest_window",
    f"""SELECT event_id, flight_id, {r('asked')}, w, {r('t', 'gap')}
        FROM (SELECT x.event_id, x.flight_id, x.t AS asked, c.w, c.t, abs(c.t - x.t) AS gap,
                     row_number() OVER (PARTITION BY x.event_id ORDER BY abs(c.t - x.t), c.w) AS r
              FROM raw x JOIN centres c USING (flight_id)) WHERE r = 1""",
)
def g5(spark, sf):
    requests = views.raw(spark, sf).select("event_id", "flight_id", F.col("t").alias("asked"))
    centres = window_centres(spans(spark, sf), LENGTH, STEP)
    return rounded(mon.nearest_window(requests, centres))


# Events of odd number ask for the nearest event of even number of their flight: times without any even spacing.
@query(
    "g5_nearest_event",
    f"""SELECT event_id, flight_id, {r('asked')}, w, {r('t', 'gap')}
        FROM (SELECT x.event_id, x.flight_id, x.t AS asked, c.event_id AS w, c.t, abs(c.t - x.t) AS gap,
                     row_number() OVER (PARTITION BY x.event_id ORDER BY abs(c.t - x.t), c.t, c.event_id) AS r
              FROM raw x JOIN raw c ON x.flight_id = c.flight_id AND x.event_id % 2 = 1 AND c.event_id % 2 = 0) WHERE r = 1""",
)
def g5_events(spark, sf):
    events = views.raw(spark, sf)
    requests = events.where("event_id % 2 = 1").select("event_id", "flight_id", F.col("t").alias("asked"))
    points = events.where("event_id % 2 = 0").select("flight_id", F.col("event_id").alias("w"), "t")
    return rounded(asof.nearest_in_time(requests, points))


@query(
    "g6_marked_trajectory",
    f"""WITH p AS (SELECT flight_id, q_1, q_2, q_3, row_number() OVER (PARTITION BY flight_id ORDER BY t, event_id) - 1 AS j,
                          count(*) OVER (PARTITION BY flight_id) AS len FROM raw),
             l AS (SELECT DISTINCT flight_id, len FROM p),
             s AS (SELECT flight_id, count(*) AS n FROM window_list GROUP BY flight_id),
             i AS (SELECT s.flight_id, s.n, l.len, unnest(range(n)) AS w FROM s JOIN l USING (flight_id)),
             x AS (SELECT i.flight_id, i.w, q_1, q_2, q_3 FROM i JOIN p ON p.flight_id = i.flight_id
                   AND p.j = CASE WHEN i.len >= n THEN i.w WHEN i.w = 0 THEN 0 WHEN i.w = n - 1 THEN i.len - 1
                                  ELSE CAST(floor(i.w * (CAST(i.len - 1 AS DOUBLE) / (n - 1))) AS BIGINT) END)
        SELECT model, flight_id, w, {r('q_1', 'q_2', 'q_3')}, CASE WHEN fault_label = 1 THEN 'fault' ELSE 'normal' END AS segment,
               CASE WHEN fault_label = 1 THEN 5 + 2 * severity_level ELSE 3 END AS marker_size
        FROM x JOIN pred USING (flight_id, w)""",
)
def g6(spark, sf):
    centres = window_centres(spans(spark, sf), LENGTH, STEP)
    sizes = centres.groupBy("flight_id").agg(F.count(F.lit(1)).alias("n_points"))
    columns = ["q_1", "q_2", "q_3"]
    positions = resample_trajectory(views.raw(spark, sf), sizes, columns, time_chunk())
    return rounded(mon.marked_trajectory(positions, views.predictions(spark, sf), columns))


@query(
    "g7_first_predictions",
    f"""SELECT model, flight_id, w, {r('fault_prob')}, fault_label, fault_type_name, severity_level
        FROM pred QUALIFY row_number() OVER (PARTITION BY model, flight_id ORDER BY w) <= {TABLE_WINDOWS}""",
)
def g7(spark, sf):
    return rounded(mon.first_predictions(views.predictions(spark, sf)))


@query("g8_signal_overview", f"SELECT flight_id, {r('t', 'q_1', 'q_2', 'q_3')} FROM raw")
def g8(spark, sf):
    wide = views.raw(spark, sf).drop("event_id").withColumn("stab_1", F.col("q_1") - F.col("q_2"))
    return rounded(mon.signal_overview(wide))


@query(
    "g10_live_status",
    f"""SELECT model, flight_id, w, {r('t')}, CASE WHEN fault_label = 1 THEN 'FAULT' ELSE 'NORMAL' END AS status, severity_level,
               CASE WHEN fault_label = 1 THEN fault_type ELSE 0 END AS fault_group, fault_type_name, {r('fault_prob')}
        FROM pred""",
)
def g10_status(spark, sf):
    return rounded(mon.live_status(views.predictions(spark, sf)))


@query(
    "g10_live_windows",
    f"""WITH e AS (SELECT event_type || '_' || CAST(user_id % 4 AS VARCHAR) AS flight_id, value, epoch_us(ts) AS us FROM events),
             s AS (SELECT *, (us // 45000000000 - j) * 45000 AS start_s
                   FROM e CROSS JOIN (SELECT unnest(range(2)) AS j))
        SELECT flight_id, CAST(start_s AS BIGINT) AS start_s, count(*) AS n,
               {r('avg(value) AS mean', 'stddev_pop(value) AS std', 'min(value) AS min', 'max(value) AS max',
                  'max(value) - min(value) AS ptp', 'sqrt(avg(value * value)) AS rms')}
        FROM s GROUP BY flight_id, start_s""",
)
def g10_windows(spark, sf):
    schema = views.table(spark, sf, "events").schema
    folder = fresh_folder(spark)
    # As a glob the path may be one file or a folder of files.
    stream = live.read_stream(spark, f"{sf}/events.parquet*", schema)
    events = views.flight_key(stream).select("flight_id", live.event_time(F.col("ts")).alias("ts"), "value")
    found = live.live_windows(events, "90000 seconds", "45000 seconds", "90000 seconds")
    live.run_available(found, folder)
    latest = live.latest_state(live.stored_updates(spark, folder, found.schema), ["flight_id", "start", "end"])
    start = F.unix_seconds("start").alias("start_s")
    return rounded(latest.select("flight_id", start, "n", *live.LIVE_FEATURES))


@query(
    "g11_running_status",
    f"""SELECT model, flight_id, count(*) AS seen, {r('avg(fault_label) AS faulty_share')},
               arg_max(severity_level, w) AS latest_severity,
               CASE WHEN arg_max(fault_label, w) = 1 THEN 'FAULT' ELSE 'NORMAL' END AS status
        FROM pred GROUP BY model, flight_id""",
)
def g11(spark, sf):
    folder = fresh_folder(spark)
    scored = views.predictions(spark, sf)
    scored.write.parquet(f"{folder}/input")
    stream = live.read_stream(spark, f"{folder}/input", scored.schema, files_per_trigger=4)
    by = ["model", "flight_id"]
    status = live.running_status(stream, by)
    live.run_available(status, f"{folder}/status")
    return rounded(live.latest_state(live.stored_updates(spark, f"{folder}/status", status.schema), by))


def written_in_turn(rows, folder, part, parts: int) -> str:
    """Rows as folders of files, one after the other; `part` numbers the folder of a row."""
    for k in range(parts):
        rows.where(part == k).write.parquet(f"{folder}/in/part{k}")
    return f"{folder}/in/*"


def signals(spark, sf):
    """(flight_id, event_id, ts, q_1, q_2, q_3): the recordings with their clock time, each channel scaled as a whole."""
    events = views.flight_key(views.table(spark, sf, "events")).select(
        "flight_id", "event_id", live.event_time(F.col("ts")).alias("ts"), F.col("value").alias("q_1"),
        F.get_json_object("props", "$.k").cast("double").alias("q_2"), F.col("user_id").cast("double").alias("q_3"),
    )
    facts = events.agg(*[f(c).alias(f"{n}_{c}") for c in CHANNELS for n, f in (("mean", F.avg), ("std", F.stddev_pop))]).first()
    return events.withColumns({c: (F.col(c) - facts[f"mean_{c}"]) / facts[f"std_{c}"] for c in CHANNELS})


# Windows of 20 samples every 10, closed by a stream whose files bring each tenth sample late, and scored on the way.
@query(
    "g10_counted_stream",
    f"""WITH z AS (SELECT flight_id, row_number() OVER (PARTITION BY flight_id ORDER BY t, event_id) - 1 AS k,
                          count(*) OVER (PARTITION BY flight_id) AS n, (q_1 - avg(q_1) OVER ()) / stddev_pop(q_1) OVER () AS x,
                          (q_3 - avg(q_3) OVER ()) / stddev_pop(q_3) OVER () AS y FROM raw),
             l AS (SELECT flight_id, unnest(range(CAST(ceil((n - 20) / CAST(10 AS DOUBLE)) AS BIGINT))) AS w
                   FROM (SELECT DISTINCT flight_id, n FROM z) WHERE n > 20)
        SELECT z.flight_id, w, {r('avg(x) AS q_1_mean', 'stddev_pop(x) AS q_1_std', 'max(x) - min(x) AS q_1_ptp',
                                  'sqrt(avg(y * y)) AS q_3_rms')}, 1 AS consistent
        FROM z JOIN l ON z.flight_id = l.flight_id AND k >= w * 10 AND k < w * 10 + 20 GROUP BY z.flight_id, w""",
)
def g10_counted(spark, sf):
    folder, rows = fresh_folder(spark), signals(spark, sf)
    times = rows.agg(F.min("ts"), F.max("ts"), (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).alias("us")).first()
    quarter = F.least(F.lit(3), F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(times[0]))) * 4 / times.us))
    part = quarter + (F.col("event_id") % 10 == 0).cast("int")
    # Two rows of another flight, long after, close what is left.
    every = written_in_turn(rows, folder, part, 5)
    for k in (1, 2):
        later = F.lit(times[1]) + F.make_dt_interval(F.lit(365 + k))
        end = rows.limit(1).select(F.lit("~").alias("flight_id"), F.lit(-k).cast("long").alias("event_id"), later.alias("ts"), *CHANNELS)
        end.write.parquet(f"{folder}/in/part{k + 4}")
    stream = live.read_stream(spark, every, rows.schema, files_per_trigger=4)
    closed = counted.counted_windows(stream, CHANNELS, 20, 10, TARGET_FS, f"{times.us // 2 // 10**6} seconds")
    model, shown = boosted(spark, sf)[0], ["flight_id", "w", "q_1_mean", "q_1_std", "q_1_ptp", "q_3_rms"]
    # The state has few flights and so few tasks; the windows that it closes are scored by all.
    scores = lambda batch: consistent(predict(model, batch.repartition("flight_id", "w"), shown))
    live.run_available(closed, f"{folder}/out", "append", transform=lambda batch: scores(batch).select(*shown, "consistent"))
    return rounded(spark.read.parquet(f"{folder}/out/data").drop("batch"))


# One model falls silent half-way; its flights expire and are gone from the state, which is read as a table.
@query(
    "g11_expiring_status",
    f"""SELECT model, flight_id, count(*) AS seen, {r('avg(fault_label) AS faulty_share')},
               arg_max(severity_level, w) AS latest_severity,
               CASE WHEN arg_max(fault_label, w) = 1 THEN 'FAULT' ELSE 'NORMAL' END AS status
        FROM pred WHERE model <> 'forest' GROUP BY model, flight_id""",
)
def g11_expiring(spark, sf):
    folder, by = fresh_folder(spark), ["model", "flight_id"]
    clock = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("t") * views.SECONDS_PER_DEVICE_SECOND)
    scored = stored(views.predictions(spark, sf).select(*by, "w", clock.alias("ts"), "fault_label", "severity_level", "t"), "scored")
    heard = scored.where("model <> 'forest' or t < 9")
    low, span = heard.agg(F.min("t"), F.max("t") - F.min("t")).first()
    third = F.least(F.lit(2), F.floor((F.col("t") - low) * 3 / span)) if span else F.lit(0)
    # The files of a part come in any order, however many they are, so a row is as late as two parts are long.
    delay = math.ceil((span or 0) * 2 / 3 * views.SECONDS_PER_DEVICE_SECOND) + 1
    # Two rows of another model, beyond the delay, bring the watermark past the last row.
    after = scored.orderBy(F.desc("t")).limit(1)
    last = [F.col("ts") + F.make_dt_interval(hours=F.lit(k), secs=F.lit(delay)) for k in (1, 2)]
    every = written_in_turn(heard, folder, third, 3)
    for k, ts in enumerate(last):
        rows = after.select(F.lit("~").alias("model"), "flight_id", "w", ts.alias("ts"), "fault_label", "severity_level", "t")
        rows.write.parquet(f"{folder}/in/part{k + 3}")
    stream = live.read_stream(spark, every, scored.schema, files_per_trigger=4)
    status = counted.expiring_status(stream, 10 * views.SECONDS_PER_DEVICE_SECOND * 1000, by, delay=f"{delay} seconds")
    live.run_available(status, folder)
    return rounded(counted.stored_status(spark, folder, by).where("model <> '~'"))
