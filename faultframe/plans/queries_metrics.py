"""Queries: label codes and evaluation (D and E)."""

from pyspark.sql import functions as F

from ..functions.labels import decode_combined, encode_combined
from ..operators import evaluate as ev
from ..sources import views
from .catalog import query, r, rounded

TRUTH_CODE = "y_fault * 100 + y_type * 10 + y_sev"
PRED_CODE = "fault_label * 100 + fault_type * 10 + severity_level"

# Per-label F1 of a (model, truth, pred) relation.
F1 = """SELECT model, label, 2.0 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM (
          SELECT l.model, l.label, count(*) FILTER (truth = label AND pred = label) AS tp,
                 count(*) FILTER (truth <> label AND pred = label) AS fp,
                 count(*) FILTER (truth = label AND pred <> label) AS fn
          FROM (SELECT model, truth AS label FROM {rel} UNION SELECT model, pred FROM {rel}) l
          JOIN {rel} p ON p.model = l.model GROUP BY l.model, l.label)"""


def coded(spark, sf):
    """Predictions with the combined true and predicted codes."""
    rows = views.predictions(spark, sf)
    return rows.withColumns(
        {
            "truth_code": encode_combined(F.col("y_fault"), F.col("y_type"), F.col("y_sev")),
            "pred_code": encode_combined(F.col("fault_label"), F.col("fault_type"), F.col("severity_level")),
        }
    )


@query("d1_encode_labels", f"SELECT model, flight_id, w, CAST({TRUTH_CODE} AS INTEGER) AS truth_code, CAST({PRED_CODE} AS INTEGER) AS pred_code FROM pred")
def d1(spark, sf):
    return coded(spark, sf).select("model", "flight_id", "w", "truth_code", "pred_code")


@query(
    "d2_decode_labels",
    "SELECT model, flight_id, w, fault_label AS fault, fault_type AS type, severity_level AS sev FROM pred",
)
def d2(spark, sf):
    rows = coded(spark, sf)
    return rows.select("model", "flight_id", "w", *[c.alias(n) for n, c in decode_combined(F.col("pred_code")).items()])


@query(
    "d3_distinct_codes",
    f"""SELECT DISTINCT CAST({TRUTH_CODE} AS INTEGER) AS code, y_fault AS fault, y_type AS type, y_sev AS sev FROM pred""",
)
def d3(spark, sf):
    return ev.distinct_codes(coded(spark, sf), "truth_code")


@query(
    "e1_accuracy",
    f"SELECT model, {r('avg(CAST(y_type = fault_type AS INTEGER)) AS accuracy')}, count(*) AS n FROM pred GROUP BY model",
)
def e1(spark, sf):
    return rounded(ev.accuracy(views.predictions(spark, sf), "y_type", "fault_type"))


@query(
    "e2_binary_f1",
    f"""SELECT model, n, tp, fp, fn, {r('(n - fp - fn) / CAST(n AS DOUBLE) AS accuracy',
               'coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1')}
        FROM (SELECT model, count(*) AS n, count(*) FILTER (fault_prob >= 0.5 AND y_fault = 1) AS tp,
                     count(*) FILTER (fault_prob >= 0.5 AND y_fault = 0) AS fp,
                     count(*) FILTER (fault_prob < 0.5 AND y_fault = 1) AS fn FROM pred GROUP BY model)""",
)
def e2(spark, sf):
    return rounded(ev.binary_scores(views.predictions(spark, sf), "y_fault", "fault_prob"))


@query(
    "e2_binary_f1_labels",
    f"""SELECT lang, n, tp, fp, fn, {r('(n - fp - fn) / CAST(n AS DOUBLE) AS accuracy',
               'coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1')}
        FROM (SELECT lang, count(*) AS n, count(*) FILTER (quality >= 1 AND toxic = 1) AS tp,
                     count(*) FILTER (quality >= 1 AND toxic = 0) AS fp,
                     count(*) FILTER (quality < 1 AND toxic = 1) AS fn FROM joined_labels GROUP BY lang)""",
)
def e2_labels(spark, sf):
    rows = views.table(spark, sf, "labels").join(views.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return rounded(ev.binary_scores(rows, "toxic", "quality", 1.0, by=["lang"]))


@query(
    "e3_macro_f1",
    f"""WITH rel AS (SELECT model, y_type AS truth, fault_type AS pred FROM pred)
        SELECT model, {r('avg(coalesce(f1, 0)) AS f1_macro')}, count(*) AS n_labels
        FROM ({F1.format(rel='rel')}) GROUP BY model""",
)
def e3(spark, sf):
    return rounded(ev.macro_f1(views.predictions(spark, sf), "y_type", "fault_type"))


@query(
    "e4_confusion_matrix",
    f"""WITH c AS (SELECT model, CAST({TRUTH_CODE} AS INTEGER) AS truth, CAST({PRED_CODE} AS INTEGER) AS pred FROM pred),
             l AS (SELECT model, truth AS label FROM c UNION SELECT model, pred FROM c)
        SELECT a.model, a.label AS truth, b.label AS pred, count(c.model) AS n
        FROM l a JOIN l b ON a.model = b.model LEFT JOIN c ON c.model = a.model AND c.truth = a.label AND c.pred = b.label
        GROUP BY ALL""",
)
def e4(spark, sf):
    return ev.confusion_matrix(coded(spark, sf), "truth_code", "pred_code")


@query(
    "e5_restricted_confusion",
    f"""WITH c AS (SELECT model, CAST({TRUTH_CODE} AS INTEGER) AS truth, CAST({PRED_CODE} AS INTEGER) AS pred FROM pred),
             k AS (SELECT truth AS label FROM c UNION SELECT 999),
             l AS (SELECT DISTINCT model, label FROM c, k)
        SELECT a.model, a.label AS truth, b.label AS pred, count(c.model) AS n
        FROM l a JOIN l b ON a.model = b.model LEFT JOIN c ON c.model = a.model AND c.truth = a.label AND c.pred = b.label
        GROUP BY ALL""",
)
def e5(spark, sf):
    rows = coded(spark, sf)
    listed = rows.select(F.col("truth_code").alias("label")).union(rows.select(F.lit(999))).distinct()  # 999 never occurs
    return ev.restricted_confusion(rows, "truth_code", "pred_code", listed)


@query(
    "e6_severity_mae",
    f"SELECT model, {r('avg(abs(y_sev - severity_continuous)) AS mae')} FROM pred GROUP BY model",
)
def e6(spark, sf):
    errors = ev.severity_errors(views.predictions(spark, sf), "y_sev", "severity_continuous")
    return rounded(errors.select("model", "mae"))


@query(
    "e7_level_mae",
    f"""SELECT model, {r('avg(abs(y_sev - severity_continuous)) AS mae', 'avg(abs(y_sev - severity_level)) AS mae_levels')}
        FROM pred GROUP BY model""",
)
def e7(spark, sf):
    return rounded(ev.severity_errors(views.predictions(spark, sf), "y_sev", "severity_continuous"))


def _all_metrics_sql(columns: str) -> str:
    heads = {
        "fault": ("y_fault", "fault_label"),
        "type": ("y_type", "fault_type"),
        "sev": ("y_sev", "severity_level"),
        "comb": (TRUTH_CODE, PRED_CODE),
    }
    rels = ", ".join(f"r_{h} AS (SELECT model, {t} AS truth, {p} AS pred FROM pred)" for h, (t, p) in heads.items())
    accs = ", ".join(f"avg(CAST({t} = {p} AS INTEGER)) AS {h}_acc" for h, (t, p) in heads.items())
    parts = " ".join(
        f"JOIN (SELECT model, avg(coalesce(f1, 0)) AS {h}_f1_macro, max(f1) FILTER (label = 1) AS {h}_one "
        f"FROM ({F1.format(rel=f'r_{h}')}) GROUP BY model) USING (model)"
        for h in heads
    )
    return f"""WITH {rels}, a AS (SELECT model, {accs}, avg(abs(y_sev - severity_level)) AS sev_mae FROM pred GROUP BY model),
               m AS (SELECT *, coalesce(fault_one, 0) AS fault_f1 FROM a {parts})
               SELECT model, {columns} FROM m"""


ALL = ("fault_acc", "fault_f1", "type_acc", "type_f1_macro", "sev_mae", "sev_acc", "sev_f1_macro", "comb_acc", "comb_f1_macro")


@query("e8_all_metrics", _all_metrics_sql(r(*ALL)))
def e8(spark, sf):
    return rounded(ev.all_metrics(views.predictions(spark, sf)))


@query("e9_model_comparison", _all_metrics_sql(r(*[c for c in ALL if c != "sev_f1_macro"])))
def e9(spark, sf):
    return rounded(ev.compare_models(views.predictions(spark, sf)))
