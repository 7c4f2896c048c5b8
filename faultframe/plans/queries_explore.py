"""Queries: exploratory statistics (X)."""

from pyspark.sql import functions as F

from ..operators import explore as ex
from ..operators.features import time_features, window_autocorrelation
from ..operators.windows import label_windows
from ..session import durable
from ..settings import TOP_CHANNELS
from ..sources import views
from .catalog import query, r, rounded
from .queries_prepare import CHANNELS, LENGTH, STEP, norm_grid, norm_windows

ITEM_CHANNELS = 4
VERDICT = "CASE WHEN imbalance > 3 THEN 'high' WHEN imbalance > 1.5 THEN 'moderate' ELSE 'balanced' END AS verdict"
LABELS = ("y_fault", "y_type", "y_sev")
# A threshold that some embedding positions reach.
EMBEDDING_R = 0.05


def document_labels(spark, sf):
    documents = views.table(spark, sf, "documents").select("doc_id", "lang", "source")
    return views.table(spark, sf, "labels").join(documents, "doc_id")


def labelled_samples(spark, sf):
    """Normalised window values with the fault label of their window."""
    return label_windows(norm_windows(spark, sf), views.flight_truth(spark, sf))


def width(vectors) -> int:
    return vectors.select(F.size("vec")).first()[0]


def embedding_pairs(spark, sf):
    vectors = views.vectors(spark, sf)
    return ex.vector_correlation_pairs(vectors, width(vectors))


def window_means(spark, sf):
    means = time_features(norm_windows(spark, sf), ["mean"])
    return means.groupBy("flight_id", "w").pivot("channel", list(CHANNELS)).agg(F.first("mean"))


@query(
    "x1_class_counts",
    f"""SELECT lang AS label, count(*) AS n, {r('count(*) * 100.0 / sum(count(*)) OVER () AS pct')}
        FROM joined_labels GROUP BY lang""",
)
def x1(spark, sf):
    return rounded(ex.class_counts(document_labels(spark, sf), "lang"))


@query(
    "x1_window_label_counts",
    f"""SELECT label_set, CAST(label AS INTEGER) AS label, count(*) AS n,
               {r('count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY label_set) AS pct')}
        FROM label_sets GROUP BY label_set, label""",
)
def x1_windows(spark, sf):
    return rounded(ex.label_counts(views.windows(spark, sf), LABELS))


@query(
    "x2_imbalance",
    f"""SELECT label_set, n_classes, {r('imbalance')}, {VERDICT}
        FROM (SELECT label_set, count(*) AS n_classes, max(n) / CAST(min(n) AS DOUBLE) AS imbalance
              FROM (SELECT 'quality' AS label_set, quality AS label, count(*) AS n FROM labels GROUP BY quality UNION ALL
                    SELECT 'toxic', toxic, count(*) FROM labels GROUP BY toxic) GROUP BY label_set)""",
)
def x2(spark, sf):
    return rounded(ex.imbalance(ex.label_counts(views.table(spark, sf, "labels"), ["quality", "toxic"])))


PROFILE = ("mean", "std", "min", "max", "zeros_pct", "q25", "median", "q75", "range")


def item_profile(spark, sf, quartiles=True):
    return ex.channel_profile(views.line_samples(spark, sf), ITEM_CHANNELS, quartiles)


@query("x3_channel_profile", f"SELECT channel, {r(*PROFILE, digits=4)} FROM profile")
def x3(spark, sf):
    return rounded(item_profile(spark, sf), 4)


@query(
    "x4_quality_flags",
    """SELECT channel, zeros_pct > 5 AS mostly_zero, std < 0.03 AS low_variance
       FROM profile WHERE zeros_pct > 5 OR std < 0.03""",
)
def x4(spark, sf):
    return ex.quality_flags(item_profile(spark, sf, quartiles=False), zeros=5.0, spread=0.03)


@query(
    "x5_extreme_ranges",
    f"""SELECT arg_min(channel, (-range, channel)) AS widest, {r('max(range) AS largest_range', digits=4)},
               arg_min(channel, (range, channel)) AS narrowest, {r('min(range) AS smallest_range', digits=4)} FROM profile""",
)
def x5(spark, sf):
    return rounded(ex.extreme_ranges(item_profile(spark, sf, quartiles=False)), 4)


def _histogram_sql(keys: str, bins: int) -> str:
    on = f"USING ({keys})"
    return f"""WITH e AS (SELECT {keys}, min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / {bins} AS width
                        FROM items GROUP BY {keys}),
                    c AS (SELECT {keys}, CAST(least(floor((value - lo) / width), {bins - 1}) AS INTEGER) AS bin, count(*) AS n
                        FROM items JOIN e {on} GROUP BY ALL)
               SELECT {', '.join('b.' + k.strip() for k in keys.split(','))}, CAST(b.bin AS INTEGER) AS bin,
                      {r('b.lo + b.bin * width AS low', 'b.lo + (b.bin + 1) * width AS high', digits=4)}, coalesce(n, 0) AS n
               FROM (SELECT *, unnest(range({bins})) AS bin FROM e) b LEFT JOIN c USING ({keys}, bin)"""


@query("x6_histogram", _histogram_sql("channel", 50))
def x6(spark, sf):
    return rounded(ex.histogram(views.line_samples(spark, sf), ["channel"], "value", 50, bound=ITEM_CHANNELS), 4)


@query("x6_class_histogram", _histogram_sql("channel, class", 30))
def x6_class(spark, sf):
    rows = views.line_samples(spark, sf)
    return rounded(ex.histogram(rows, ["channel"], "value", 30, by=["class"]), 4)


@query(
    "x7_box_stats",
    f"""WITH q AS (SELECT channel, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                          quantile_cont(value, 0.75) AS q3 FROM items GROUP BY channel)
        SELECT channel, {r('q1', 'median', 'q3', 'min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)) AS whisker_low',
                           'max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)) AS whisker_high', digits=4)}
        FROM items JOIN q USING (channel) GROUP BY channel, q1, median, q3""",
)
def x7(spark, sf):
    return rounded(ex.box_stats(views.line_samples(spark, sf), ITEM_CHANNELS), 4)


@query(
    "x8_lag1_autocorrelation",
    f"""SELECT channel, {r('avg(c) AS autocorr')}, count(c) AS n_windows
        FROM (SELECT flight_id, w, channel, CASE WHEN isfinite(corr(x, y)) THEN corr(x, y) END AS c
              FROM (SELECT flight_id, w, channel, value AS y,
                           lag(value) OVER (PARTITION BY flight_id, w, channel ORDER BY i) AS x FROM win)
              WHERE x IS NOT NULL GROUP BY flight_id, w, channel)
        GROUP BY channel""",
)
def x8(spark, sf):
    return rounded(ex.averaged_autocorrelation(window_autocorrelation(norm_grid(spark, sf), CHANNELS, LENGTH, STEP)))


@query("x9_window_std", f"SELECT channel, {r('avg(std) AS mean_std')} FROM time_feats GROUP BY channel")
def x9(spark, sf):
    return rounded(ex.mean_window_std(norm_windows(spark, sf)))


@query(
    "x10_cross_tabs",
    " UNION ALL ".join(
        f"""SELECT '{a}/{b}' AS pair, CASE WHEN grouping({a}) = 1 THEN 'All' ELSE CAST({a} AS VARCHAR) END AS a,
                   CASE WHEN grouping({b}) = 1 THEN 'All' ELSE CAST({b} AS VARCHAR) END AS b,
                   CAST(grouping({a}) * 2 + grouping({b}) AS INTEGER) AS level, count(*) AS n
            FROM truth JOIN centres USING (flight_id) GROUP BY CUBE ({a}, {b})"""
        for a, b in (("y_fault", "y_sev"), ("y_fault", "y_type"), ("y_sev", "y_type"))
    ),
)
def x10(spark, sf):
    rows = views.windows(spark, sf)
    tables = [
        ex.cross_tab(rows, a, b).select(F.lit(f"{a}/{b}").alias("pair"), "*")
        for a, b in (("y_fault", "y_sev"), ("y_fault", "y_type"), ("y_sev", "y_type"))
    ]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


SEPARABILITY = """SELECT channel, mean_range, avg_std, CASE WHEN avg_std > 0 THEN mean_range / avg_std ELSE 0 END AS separability
    FROM (SELECT channel, max(m) - min(m) AS mean_range, avg(s) AS avg_std
          FROM (SELECT channel, y_fault, avg(value) AS m, stddev_pop(value) AS s
                FROM win JOIN truth USING (flight_id) GROUP BY channel, y_fault) GROUP BY channel)"""


@query("x11_separability", f"SELECT channel, {r('mean_range', 'avg_std', 'separability')} FROM ({SEPARABILITY})")
def x11(spark, sf):
    return rounded(ex.separability(labelled_samples(spark, sf), "y_fault"))


@query(
    "x12_top_channels",
    f"""SELECT channel, {r('separability')} FROM ({SEPARABILITY}) ORDER BY separability DESC, channel LIMIT {TOP_CHANNELS}""",
)
def x12(spark, sf):
    scored = ex.separability(labelled_samples(spark, sf), "y_fault")
    return rounded(ex.top_channels(scored).select("channel", "separability"))


@query(
    "x13_correlation_matrix",
    f"""SELECT CAST(a.pos AS INTEGER) AS a, CAST(b.pos AS INTEGER) AS b, count(*) AS n, {r('corr(a.x, b.x) AS r')}
        FROM cells a JOIN cells b ON a.vec_id = b.vec_id AND a.pos <= b.pos GROUP BY a.pos, b.pos""",
)
def x13(spark, sf):
    return rounded(embedding_pairs(spark, sf))


@query(
    "x13_window_mean_correlation",
    f"""SELECT a.channel AS a, b.channel AS b, count(*) AS n, {r('corr(a.mean, b.mean) AS r')}
        FROM time_feats a JOIN time_feats b ON a.flight_id = b.flight_id AND a.w = b.w AND a.channel <= b.channel
        GROUP BY a.channel, b.channel""",
)
def x13_windows(spark, sf):
    return rounded(ex.correlation_pairs(window_means(spark, sf), CHANNELS))


@query(
    "x14_strong_pairs",
    f"""SELECT a, b, n, {r('r')}, count(*) OVER () AS n_strong
        FROM (SELECT CAST(a.pos AS INTEGER) AS a, CAST(b.pos AS INTEGER) AS b, count(*) AS n, corr(a.x, b.x) AS r
              FROM cells a JOIN cells b ON a.vec_id = b.vec_id AND a.pos < b.pos GROUP BY a.pos, b.pos)
        WHERE abs(r) > {EMBEDDING_R} ORDER BY abs(r) DESC, a, b LIMIT 20""",
)
def x14(spark, sf):
    pairs = durable(embedding_pairs(spark, sf))
    return rounded(ex.top_pairs(pairs, EMBEDDING_R))


@query(
    "x15_value_summary",
    f"""SELECT {r('min(value) AS min', 'max(value) AS max', 'avg(value) AS mean', 'stddev_pop(value) AS std', digits=4)},
               count(value) AS n_points FROM items""",
)
def x15(spark, sf):
    return rounded(ex.value_summary(views.line_samples(spark, sf)), 4)


@query(
    "x16_recommendations",
    """WITH b AS (SELECT max(f) AS worst FROM (SELECT max(n) / CAST(min(n) AS DOUBLE) AS f
                  FROM (SELECT label_set, label, count(*) AS n FROM label_sets GROUP BY ALL) GROUP BY label_set)),
            c AS (SELECT count(*) AS strong FROM (SELECT corr(a.x, b.x) AS r FROM cells a JOIN cells b
                  ON a.vec_id = b.vec_id AND a.pos < b.pos GROUP BY a.pos, b.pos) WHERE abs(r) > 0.8),
            s AS (SELECT avg(value) AS m, stddev_pop(value) AS d FROM win)
       SELECT 'class_balance' AS rule, CASE WHEN worst > 2 THEN 'use_class_weights' ELSE 'acceptable' END AS verdict FROM b
       UNION ALL SELECT 'correlation', CASE WHEN strong > 10 THEN 'reduce_features' ELSE 'manageable' END FROM c
       UNION ALL SELECT 'normalisation', CASE WHEN abs(m) > 0.1 OR d < 0.5 OR d > 2 THEN 'verify_normalisation' ELSE 'good' END
       FROM s""",
)
def x16(spark, sf):
    imbalances = ex.imbalance(ex.label_counts(views.windows(spark, sf), LABELS))
    return ex.recommendations(imbalances, embedding_pairs(spark, sf), ex.value_summary(norm_windows(spark, sf)))


@query(
    "x17_sampled_windows",
    f"""WITH few AS (SELECT flight_id, w, y_fault FROM centres JOIN truth USING (flight_id)
                     ORDER BY md5('42|' || flight_id || '|' || CAST(w AS VARCHAR)), flight_id, w LIMIT 5)
        SELECT flight_id, w, i, channel, {r('value')}, y_fault FROM win JOIN few USING (flight_id, w)""",
)
def x17(spark, sf):
    labels = views.windows(spark, sf)
    return rounded(ex.sampled_windows(norm_grid(spark, sf), labels, CHANNELS, LENGTH, STEP))
