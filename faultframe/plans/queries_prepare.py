"""Queries: sources, ingest, preprocessing (S and P)."""

import uuid

from pyspark.sql import functions as F

from ..functions.labels import binary_fault, decoded_fault_name, drone_id, fault_name
from ..operators import scaling, splits, windows as win
from ..operators.models import feature_columns
from ..operators.ordered import row_index
from ..operators.resample import flight_spans, resample, resample_trajectory
from ..session import shared_folder
from ..settings import DEMO_WINDOWS, STEP_SEC, TARGET_FS, WIN_SEC
from ..sources import dataset, flights, views
from .catalog import query, r, rounded
from .prepare import normalised_grid, normalised_windows, prepare, window_features

CHANNELS = views.CHANNELS
LENGTH, STEP = win.window_shape(WIN_SEC, STEP_SEC, TARGET_FS)


def time_chunk():
    """Cuts a flight's time axis for ordered computations."""
    return F.floor(F.col("t") / 16)


def fresh_folder(spark) -> str:
    return f"{shared_folder(spark)}/faultframe-{uuid.uuid4().hex}"


def grid(spark, sf):
    return resample(views.raw(spark, sf), TARGET_FS, CHANNELS, tie=["event_id"])


def norm_windows(spark, sf):
    return normalised_windows(views.raw(spark, sf), CHANNELS)


def norm_grid(spark, sf):
    return normalised_grid(views.raw(spark, sf), CHANNELS)


def spans(spark, sf):
    return flight_spans(views.raw(spark, sf), TARGET_FS)


def recording_groups(spark, sf):
    """Main, command and stabiliser groups: one command group is a sample short, one stabiliser group is absent."""
    indexed = row_index(views.raw(spark, sf), ["flight_id"], ["t", "event_id"], time_chunk(), out="sample")
    main = indexed.select("flight_id", "sample", "t", *CHANNELS)
    short = F.col("flight_id").endswith("_3") & (F.col("sample") == F.col("n_key") - 1)
    cmd = indexed.where(~short).select("flight_id", "sample", (F.col("q_1") * 2).alias("cmd_1"), F.col("q_2").alias("cmd_2"))
    stab = indexed.where(~F.col("flight_id").startswith("view")).select(
        "flight_id", "sample", (F.col("q_1") - F.col("q_2")).alias("stab_1")
    )
    return main, [cmd, stab]


@query(
    "s1_assemble_flight",
    f"""SELECT flight_id, sample, {r('t', 'value')}, channel FROM (
        WITH m AS (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY t, event_id) - 1 AS sample FROM raw)
        SELECT flight_id, sample, t, 'q_1' AS channel, q_1 AS value FROM m UNION ALL
        SELECT flight_id, sample, t, 'q_2', q_2 FROM m UNION ALL SELECT flight_id, sample, t, 'q_3', q_3 FROM m UNION ALL
        SELECT flight_id, sample, t, 'cmd_1', q_1 * 2 FROM m WHERE flight_id NOT LIKE '%\\_3' ESCAPE '\\' UNION ALL
        SELECT flight_id, sample, t, 'cmd_2', q_2 FROM m WHERE flight_id NOT LIKE '%\\_3' ESCAPE '\\' UNION ALL
        SELECT flight_id, sample, t, 'stab_1', q_1 - q_2 FROM m WHERE flight_id NOT LIKE 'view%')""",
)
def s1(spark, sf):
    main, groups = recording_groups(spark, sf)
    return rounded(flights.assemble_flight(main, groups))


@query(
    "s2_load_all",
    """SELECT file_name, CAST(healthy AS INTEGER) AS healthy, fault_type, severity, trajectory, drone_id, speed_case,
              count(*) AS n_samples
       FROM raw JOIN flight_labels USING (flight_id) GROUP BY ALL""",
)
def s2(spark, sf):
    folder = fresh_folder(spark)
    recordings = views.raw(spark, sf).join(views.flight_files(spark, sf), "flight_id")
    recordings.write.partitionBy("file_name").parquet(folder)
    # Spark names the folder file_name=<name>; the pattern is searched anywhere in it.
    loaded = flights.load_all(spark, folder, name_from="folder")
    names = ["healthy", "fault_type", "severity", "trajectory", "drone_id", "speed_case"]
    counted = loaded.groupBy("file_name", *names).agg(F.count(F.lit(1)).alias("n_samples"))
    return counted.withColumn("file_name", F.regexp_replace("file_name", "^file_name=", ""))


@query(
    "s3_parse_filename",
    "SELECT flight_id, file_name, healthy, fault_type, severity, trajectory, drone_id, speed_case FROM flight_labels",
)
def s3(spark, sf):
    return views.flight_labels(spark, sf)


@query(
    "s4_infer_drone_id",
    """SELECT url, CASE WHEN contains(url, 'D1') THEN 'D1' WHEN contains(url, 'D2') THEN 'D2'
                        WHEN contains(url, 'D3') THEN 'D3' ELSE 'Unknown' END AS drone_id
       FROM (SELECT DISTINCT 'D' || (page_id % 5) || '_' || url AS url FROM pages)""",
)
def s4(spark, sf):
    pages = views.table(spark, sf, "pages")
    name = F.concat(F.lit("D"), (F.col("page_id") % 5).cast("string"), F.lit("_"), F.col("url"))
    return pages.select(name.alias("url")).distinct().select("url", drone_id(F.col("url")).alias("drone_id"))


@query(
    "s5_fault_names",
    """SELECT code, CASE code WHEN '0' THEN 'none' WHEN '1' THEN 'crack' WHEN '2' THEN 'edge_cut'
                              WHEN '3' THEN 'surface_cut' ELSE 'other' END AS ingest_name,
              CASE WHEN try_cast(code AS INTEGER) IS NULL THEN 'Invalid (' || code || ')'
                   ELSE CASE code WHEN '0' THEN 'none' WHEN '1' THEN 'crack' WHEN '2' THEN 'edge_cut'
                                  WHEN '3' THEN 'surface_cut' ELSE 'Unknown (' || code || ')' END END AS decoded_name
       FROM (SELECT DISTINCT CASE WHEN l_linenumber > 5 THEN l_returnflag ELSE CAST(l_linenumber - 1 AS VARCHAR) END AS code
             FROM lineitem)""",
)
def s5(spark, sf):
    code = F.when(F.col("l_linenumber") > 5, F.col("l_returnflag")).otherwise((F.col("l_linenumber") - 1).cast("string"))
    codes = views.table(spark, sf, "lineitem").select(code.alias("code")).distinct()
    known = F.coalesce(F.col("code").try_cast("int"), F.lit(-1))
    return codes.select("code", fault_name(known).alias("ingest_name"), decoded_fault_name(F.col("code")).alias("decoded_name"))


@query(
    "s6_window_labels",
    f"""SELECT c.flight_id, c.w, {r('c.t AS t')}, healthy, fault_type, severity, trajectory, drone_id, speed_case
        FROM centres c JOIN flight_labels USING (flight_id)""",
)
def s6(spark, sf):
    centres = win.window_centres(spans(spark, sf), LENGTH, STEP).select("flight_id", "w", "t")
    return rounded(win.label_windows(centres, views.flight_labels(spark, sf).drop("file_name")))


@query(
    "s7_dataset_round_trip",
    f"""SELECT flight_id, w, y_fault, y_type, y_sev, count(*) AS n_values, {r('sum(value) AS total', digits=4)}
        FROM (SELECT flight_id, w, value, y_fault, y_sev, CAST(type_id AS INTEGER) AS y_type
              FROM win JOIN truth USING (flight_id) JOIN flight_labels USING (flight_id)
              JOIN (SELECT fault_type, row_number() OVER (ORDER BY min(file_name)) - 1 AS type_id
                    FROM flight_labels GROUP BY fault_type) USING (fault_type))
        GROUP BY flight_id, w, y_fault, y_type, y_sev""",
)
def s7(spark, sf):
    folder = fresh_folder(spark)
    dataset.write_dataset(prepare(views.raw(spark, sf), views.flight_labels(spark, sf), CHANNELS), folder)
    stored = dataset.read_dataset(spark, folder)
    sums = stored.windows.groupBy("flight_id", "w").agg(F.count("value").alias("n_values"), F.sum("value").alias("total"))
    return rounded(sums.join(stored.labels, ["flight_id", "w"]), 4)


@query(
    "s8_read_by_uri",
    f"SELECT channel, {r('mean', 'std')} FROM stats",
)
def s8(spark, sf):
    folder = fresh_folder(spark)
    scaling.channel_stats(grid(spark, sf), CHANNELS).write.parquet(f"{folder}/stats")
    uri = folder if "://" in folder or folder.startswith("file:") else f"file:{folder}"
    return rounded(spark.read.parquet(f"{uri}/stats"))


@query("s9_file_inventory")
def s9(spark, sf):
    return flights.file_inventory(spark, sf)


@query(
    "s10_head_windows",
    f"""SELECT CAST(row_number() OVER (ORDER BY flight_id, w) - 1 AS INTEGER) AS i, flight_id, w,
               (row_number() OVER (ORDER BY flight_id, w) - 1) * CAST(0.5 AS DOUBLE) AS t
        FROM window_list ORDER BY flight_id, w LIMIT {DEMO_WINDOWS}""",
)
def s10(spark, sf):
    listed = win.window_centres(spans(spark, sf), LENGTH, STEP)
    return win.first_windows(listed, DEMO_WINDOWS, STEP_SEC)


@query(
    "s12_shape_and_alignment",
    """SELECT count(*) AS n_windows, CAST(min(n) AS BIGINT) AS min_len, CAST(max(n) AS BIGINT) AS max_len,
              CAST(3 AS BIGINT) AS min_channels, CAST(3 AS BIGINT) AS max_channels, count(*) AS n_labels,
              CAST(0 AS BIGINT) AS windows_without_label, CAST(0 AS BIGINT) AS labels_without_window
       FROM (SELECT flight_id, w, count(*) AS n FROM win WHERE channel = 'q_1' GROUP BY flight_id, w)
       JOIN truth USING (flight_id)""",
)
def s12(spark, sf):
    windows = norm_windows(spark, sf)
    labels = views.windows(spark, sf).select("flight_id", "w", "y_fault")
    shape = win.dataset_shape(windows)
    report = win.alignment_report(windows, labels).drop("n_windows")
    counts = report.select(F.struct("*").alias("c")).scalar()
    return shape.withColumn("c", counts).select("*", "c.*").drop("c")


@query("p1_resample", f"SELECT flight_id, k, n, {r('t', 'q_1', 'q_2', 'q_3')} FROM grid")
def p1(spark, sf):
    return rounded(grid(spark, sf))


@query("p2_channel_stats", f"SELECT channel, {r('mean', 'std')} FROM stats")
def p2(spark, sf):
    return rounded(scaling.channel_stats(grid(spark, sf), CHANNELS))


@query(
    "p2_channel_stats_long",
    f"SELECT channel, {r('avg(value) AS mean', 'stddev_samp(value) AS std', digits=4)} FROM items GROUP BY channel",
)
def p2_long(spark, sf):
    return rounded(scaling.channel_stats_long(views.line_samples(spark, sf)), 4)


@query(
    "p3_normalise",
    f"SELECT flight_id, k, {r('t')}, channel, {r('value')} FROM norm",
)
def p3(spark, sf):
    points = grid(spark, sf)
    scaled = scaling.normalise(points, scaling.channel_stats(points, CHANNELS), CHANNELS)
    return rounded(scaling.to_long(scaled, ["flight_id", "k", "t"], CHANNELS))


@query(
    "p4_align_channels",
    f"SELECT flight_id, k, channel, {r('value')} FROM grid_long WHERE channel IN (SELECT channel FROM stats WHERE std > 30)",
)
def p4(spark, sf):
    points = grid(spark, sf)
    known = scaling.channel_stats(points, CHANNELS).where(F.col("std") > 30)
    samples = scaling.to_long(points, ["flight_id", "k"], CHANNELS)
    return rounded(scaling.align_channels(samples, known, len(CHANNELS)))


@query("p5_sliding_windows", f"SELECT flight_id, w, i, channel, {r('value')} FROM win")
def p5(spark, sf):
    return rounded(norm_windows(spark, sf))


@query("p6_window_centres", f"SELECT flight_id, w, {r('t')} FROM win WHERE i = 50 AND channel = 'q_1'")
def p6(spark, sf):
    return rounded(win.window_centres(spans(spark, sf), LENGTH, STEP).select("flight_id", "w", "t"))


@query(
    "p7_dropped_flights",
    f"""SELECT user_id, {r('max(t) - min(t) AS duration')}, count(*) AS n_samples
        FROM (SELECT user_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / CAST(1000000 AS DOUBLE)
                     / CAST(90000 AS DOUBLE) AS t FROM events)
        GROUP BY user_id
        HAVING CAST(floor((max(t) - min(t)) * 100) AS BIGINT) + 1 <= 2800""",
)
def p7(spark, sf):
    raw = views.raw(spark, sf).withColumn("user_id", F.col("q_3").cast("long"))
    users = flight_spans(raw, TARGET_FS, key="user_id")
    gone = win.dropped_flights(users, 2800, STEP)
    sizes = raw.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_samples"))
    return rounded(gone.join(sizes, "user_id").select("user_id", (F.col("t1") - F.col("t0")).alias("duration"), "n_samples"))


@query(
    "p8_concatenated_dataset",
    """SELECT y_fault, y_type, y_sev, count(*) AS n_windows FROM centres JOIN truth USING (flight_id) GROUP BY ALL""",
)
def p8(spark, sf):
    parts = views.windows(spark, sf)
    healthy, faulty = parts.where("y_fault = 0"), parts.where("y_fault = 1")
    return healthy.unionByName(faulty).groupBy("y_fault", "y_type", "y_sev").agg(F.count(F.lit(1)).alias("n_windows"))


@query(
    "p9_fault_type_ids",
    """SELECT fault_type, CAST(row_number() OVER (ORDER BY min(file_name)) - 1 AS INTEGER) AS type_id
       FROM flight_labels GROUP BY fault_type""",
)
def p9(spark, sf):
    gone = win.dropped_flights(spans(spark, sf), LENGTH, STEP)
    return win.fault_type_ids(views.flight_labels(spark, sf).join(gone, "flight_id", "left_anti"))


@query(
    "p10_binary_labels",
    "SELECT flight_id, w, y_fault FROM centres JOIN truth USING (flight_id)",
)
def p10(spark, sf):
    centres = win.window_centres(spans(spark, sf), LENGTH, STEP).select("flight_id", "w")
    labels = views.flight_labels(spark, sf).select("flight_id", binary_fault(F.col("healthy")).alias("y_fault"))
    return win.label_windows(centres, labels)


@query(
    "p11_missing_counts",
    """SELECT count(*) FILTER (isnan(x) OR x IS NULL) AS n_nan, count(*) FILTER (isinf(x)) AS n_inf, count(*) AS n_rows
       FROM (SELECT CASE WHEN l_discount = 0 THEN CAST('nan' AS DOUBLE)
                         WHEN l_tax = 0 THEN CAST('infinity' AS DOUBLE) ELSE l_extendedprice END AS x FROM lineitem)""",
)
def p11(spark, sf):
    x = F.when(F.col("l_discount") == 0, F.lit(float("nan"))).when(F.col("l_tax") == 0, F.lit(float("inf")))
    rows = views.table(spark, sf, "lineitem").select(x.otherwise(F.col("l_extendedprice")).alias("value"))
    return scaling.missing_counts(rows)


@query(
    "p12_vector_zscore",
    f"""SELECT vec_id, CAST(c.pos AS INTEGER) AS pos,
               {r('(x - mean) / CASE WHEN std = 0 THEN 1 ELSE std END AS z')}
        FROM cells c JOIN (SELECT pos, avg(x) AS mean, stddev_pop(x) AS std FROM cells GROUP BY pos) USING (pos)""",
)
def p12(spark, sf):
    vectors = views.vectors(spark, sf)
    scaled = scaling.zscore_vectors(vectors, scaling.vector_stats(vectors))
    return rounded(scaled.select("vec_id", F.posexplode("vec").alias("pos", "z")))


@query(
    "p13_mean_imputation",
    f"""SELECT l_orderkey, l_linenumber, {r('coalesce(d, avg(d) OVER ()) AS discount', 'coalesce(x, avg(x) OVER ()) AS tax')}
        FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN l_discount END AS d,
                     CASE WHEN l_tax > 0 THEN l_tax END AS x FROM lineitem)""",
)
def p13(spark, sf):
    nan = F.lit(float("nan"))
    items = views.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_discount") > 0, F.col("l_discount")).otherwise(nan).alias("discount"),
        F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("tax"),
    )
    return rounded(scaling.impute_mean(items, ["discount", "tax"]))


@query(
    "p14_selected_features",
    f"""SELECT flight_id, w, {r("max(rms) FILTER (channel = 'q_2') AS q_2_rms", "max(mean) FILTER (channel = 'q_1') AS q_1_mean",
                                "max(f_peak) FILTER (channel = 'q_3') AS q_3_f_peak", digits=5)}
        FROM time_feats JOIN peaks USING (flight_id, w, channel) GROUP BY flight_id, w""",
)
def p14(spark, sf):
    features = window_features(views.raw(spark, sf), CHANNELS)
    wanted = ["q_2_rms", "q_1_mean", "q_3_f_peak"]
    assert set(wanted) <= set(feature_columns(features))
    return rounded(features.select("flight_id", "w", *wanted), 5)


@query(
    "p15_random_subsample",
    """SELECT doc_id, lang, n_chars FROM documents ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 300""",
)
def p15(spark, sf):
    documents = views.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return splits.subsample(documents, ["doc_id"], 300)


@query(
    "p16_resample_trajectory",
    f"""WITH p AS (SELECT flight_id, q_1, q_2, row_number() OVER (PARTITION BY flight_id ORDER BY t, event_id) - 1 AS j,
                          count(*) OVER (PARTITION BY flight_id) AS len FROM raw),
             s AS (SELECT flight_id, n, unnest(range(n)) AS i FROM spans),
             l AS (SELECT DISTINCT flight_id, len FROM p)
        SELECT s.flight_id, s.i, {r('q_1', 'q_2')} FROM s JOIN l USING (flight_id) JOIN p ON p.flight_id = s.flight_id
          AND p.j = CASE WHEN l.len >= n THEN i WHEN i = 0 THEN 0 WHEN i = n - 1 THEN l.len - 1
                         ELSE CAST(floor(i * (CAST(l.len - 1 AS DOUBLE) / (n - 1))) AS BIGINT) END""",
)
def p16(spark, sf):
    sizes = spans(spark, sf).select("flight_id", F.col("n").alias("n_points"))
    return rounded(resample_trajectory(views.raw(spark, sf), sizes, ["q_1", "q_2"], time_chunk()))
