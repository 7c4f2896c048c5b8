"""Evaluation metrics. All of them derive from small tables of counts, never from a second pass over the rows."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labels import decode_combined, encode_combined
from ..functions.numeric import ratio, ratio_or_zero, severity_level

MODEL = ("model",)


def confusion_counts(df: DataFrame, truth, pred, by=MODEL) -> DataFrame:
    """(by, truth, pred, n) of the pairs that occur."""
    return df.groupBy(*by, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, truth, pred, by=MODEL) -> DataFrame:
    """The counts over every pair of the union of labels, zeros included."""
    counts = confusion_counts(df, truth, pred, by)
    labels = counts.groupBy(*by).agg(
        F.array_sort(F.array_union(F.collect_set("truth"), F.collect_set("pred"))).alias("labels")
    )
    cells = labels.withColumn("truth", F.explode("labels")).withColumn("pred", F.explode("labels")).drop("labels")
    return cells.join(counts, [*by, "truth", "pred"], "left").select(
        *by, "truth", "pred", F.coalesce("n", F.lit(0)).alias("n")
    )


def restricted_confusion(df: DataFrame, truth, pred, labels: DataFrame, by=MODEL) -> DataFrame:
    """Confusion over every pair of a given list (a one-column frame `label`); rows with either side outside are dropped."""
    counts = confusion_counts(df, truth, pred, by)
    listed = labels.agg(F.array_sort(F.collect_set("label")).alias("labels")).scalar()
    cells = counts.select(*by).distinct().withColumn("truth", F.explode(listed)).withColumn("pred", F.explode(listed))
    return cells.join(counts, [*by, "truth", "pred"], "left").select(
        *by, "truth", "pred", F.coalesce("n", F.lit(0)).alias("n")
    )


def label_scores(counts: DataFrame, by=MODEL) -> DataFrame:
    """(by, label, tp, fp, fn, f1) from confusion counts, over the union of true and predicted labels."""
    hit = F.col("truth") == F.col("pred")
    sides = F.array(
        F.struct(
            F.col("truth").alias("label"),
            F.when(hit, F.col("n")).otherwise(0).alias("tp"),
            F.lit(0).cast("long").alias("fp"),
            F.when(hit, 0).otherwise(F.col("n")).alias("fn"),
        ),
        F.struct(
            F.col("pred").alias("label"),
            F.lit(0).cast("long").alias("tp"),
            F.when(hit, 0).otherwise(F.col("n")).alias("fp"),
            F.lit(0).cast("long").alias("fn"),
        ),
    )
    sums = counts.select(*by, F.explode(sides).alias("s")).groupBy(*by, F.col("s.label").alias("label"))
    scores = sums.agg(*[F.sum(f"s.{c}").alias(c) for c in ("tp", "fp", "fn")])
    return scores.withColumn("f1", f1_score(F.col("tp"), F.col("fp"), F.col("fn")))


def f1_score(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio_or_zero(2 * tp, 2 * tp + fp + fn)


def accuracy(df: DataFrame, truth, pred, by=MODEL) -> DataFrame:
    hits = F.avg((F.col(truth) == F.col(pred)).cast("int"))
    return df.groupBy(*by).agg(hits.alias("accuracy"), F.count(F.lit(1)).alias("n"))


def binary_scores(df: DataFrame, truth, prob, threshold=0.5, by=MODEL) -> DataFrame:
    """Accuracy and F1 of class 1 when probabilities at or above the threshold count as 1."""
    said = F.col(prob) >= F.lit(threshold)
    real = F.col(truth) == 1
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(said & real).alias("tp"),
        F.count_if(said & ~real).alias("fp"),
        F.count_if(~said & real).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        *by, "n", "tp", "fp", "fn", ratio(F.col("n") - fp - fn, F.col("n")).alias("accuracy"), f1_score(tp, fp, fn).alias("f1")
    )


def macro_f1(df: DataFrame, truth, pred, by=MODEL) -> DataFrame:
    scores = label_scores(confusion_counts(df, truth, pred, by), by)
    return scores.groupBy(*by).agg(F.avg("f1").alias("f1_macro"), F.count(F.lit(1)).alias("n_labels"))


def severity_errors(df: DataFrame, truth, continuous, by=MODEL) -> DataFrame:
    """Mean absolute error of the continuous severity and of its rounded, clipped level."""
    x = F.col(continuous)
    return df.groupBy(*by).agg(
        F.avg(F.abs(F.col(truth) - x)).alias("mae"), F.avg(F.abs(F.col(truth) - severity_level(x))).alias("mae_levels")
    )


def all_metrics(df: DataFrame, by=MODEL) -> DataFrame:
    """The metrics of every model in one row each, from one table of joint label counts."""
    columns = ["y_fault", "fault_label", "y_type", "fault_type", "y_sev", "severity_level"]
    joint = df.groupBy(*by, *columns).agg(F.count(F.lit(1)).alias("n"))
    truth = encode_combined(F.col("y_fault"), F.col("y_type"), F.col("y_sev"))
    pred = encode_combined(F.col("fault_label"), F.col("fault_type"), F.col("severity_level"))
    heads = F.array(
        *[
            F.struct(F.lit(h).alias("head"), t.cast("int").alias("truth"), p.cast("int").alias("pred"))
            for h, t, p in (
                ("fault", F.col("y_fault"), F.col("fault_label")),
                ("type", F.col("y_type"), F.col("fault_type")),
                ("sev", F.col("y_sev"), F.col("severity_level")),
                ("comb", truth, pred),
            )
        ]
    )
    keyed = [*by, "head"]
    counts = joint.select(*by, "n", F.explode(heads).alias("h")).groupBy(
        *by, F.col("h.head").alias("head"), F.col("h.truth").alias("truth"), F.col("h.pred").alias("pred")
    ).agg(F.sum("n").alias("n"))
    scores = label_scores(counts, keyed).groupBy(*keyed).agg(
        F.avg("f1").alias("macro"), F.max(F.when(F.col("label") == 1, F.col("f1"))).alias("positive")
    )
    totals = counts.groupBy(*keyed).agg(
        ratio(F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)), F.sum("n")).alias("acc"),
        ratio(F.sum(F.abs(F.col("truth") - F.col("pred")) * F.col("n")), F.sum("n")).alias("mae"),
    )
    per_head = totals.join(scores, keyed)

    def pick(head: str, column: str) -> Column:
        return F.max(F.when(F.col("head") == head, F.col(column)))

    return per_head.groupBy(*by).agg(
        pick("fault", "acc").alias("fault_acc"),
        F.coalesce(pick("fault", "positive"), F.lit(0.0)).alias("fault_f1"),
        pick("type", "acc").alias("type_acc"),
        pick("type", "macro").alias("type_f1_macro"),
        pick("sev", "mae").alias("sev_mae"),
        pick("sev", "acc").alias("sev_acc"),
        pick("sev", "macro").alias("sev_f1_macro"),
        pick("comb", "acc").alias("comb_acc"),
        pick("comb", "macro").alias("comb_f1_macro"),
    )


def compare_models(df: DataFrame) -> DataFrame:
    """The comparison table: one row per model, the main metrics only."""
    return all_metrics(df).select(
        "model", "fault_acc", "fault_f1", "type_acc", "type_f1_macro", "sev_mae", "sev_acc", "comb_acc", "comb_f1_macro"
    )


def distinct_codes(df: DataFrame, code: str) -> DataFrame:
    """Every combined code that occurs, decoded."""
    codes = df.select(F.col(code).alias("code")).distinct()
    return codes.select("code", *[c.alias(n) for n, c in decode_combined(F.col("code")).items()])


def head_losses(df: DataFrame, heads: dict[str, tuple[str, str, float]], by=MODEL) -> DataFrame:
    """Weighted sum of cross-entropies: `heads` maps a name to (label column, probability array column, weight)."""
    losses = {
        h: F.avg(-F.ln(F.greatest(F.get(F.col(p), F.col(y)), F.lit(1e-15)))).alias(f"loss_{h}")
        for h, (y, p, _) in heads.items()
    }
    total = sum((F.col(f"loss_{h}") * F.lit(w) for h, (_, _, w) in heads.items()), F.lit(0.0))
    return df.groupBy(*by).agg(*losses.values()).withColumn("loss", total)
