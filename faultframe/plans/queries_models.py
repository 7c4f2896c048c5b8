"""Queries: splits, models, inference (M)."""

from pyspark.sql import functions as F

from ..functions.labels import encode_combined
from ..functions.numeric import severity_level
from ..operators import isolation, knn, models, monitor, network, scaling, splits
from ..operators.evaluate import compare_models, head_losses
from ..session import durable
from ..settings import BOOST_TREES, LOSS_WEIGHTS
from ..sources import views
from .catalog import query, r, rounded
from .prepare import window_features
from .queries_prepare import CHANNELS, fresh_folder, grid
from .score import score_flights

def split_vectors(spark, sf):
    """Embeddings as (id, vec, code, is_test), stratified by label."""
    rows = splits.stratified_split(views.vectors(spark, sf), ["vec_id"], "label")
    label = F.col("label")
    code = encode_combined(F.when(label > 0, 1).otherwise(0), label % 4, F.floor(label / 4))
    return rows.select(F.col("vec_id").alias("id"), "vec", code.alias("code"), "label", "is_test")


def knn_parts(spark, sf):
    rows = durable(split_vectors(spark, sf))
    queries = rows.where("is_test").select(F.col("id").alias("qid"), "vec", F.col("code").alias("truth"))
    return knn.fit(rows.where("NOT is_test").select("id", "vec", "code")), queries


def split_features(spark, sf):
    """Training and test rows; the split is drawn from the cheap window list and joined to the features by key."""
    drawn = splits.stratified_split(views.windows(spark, sf).drop("t"), ["flight_id", "w"], "y_fault")
    rows = durable(window_features(views.raw(spark, sf), CHANNELS).join(drawn, ["flight_id", "w"]))
    return rows.where("NOT is_test").drop("is_test"), rows.where("is_test").drop("is_test")


@query(
    "m1_stratified_split",
    """SELECT vec_id, label, CAST(is_test AS INTEGER) AS is_test FROM vector_split""",
)
def m1(spark, sf):
    rows = splits.stratified_split(views.vectors(spark, sf), ["vec_id"], "label")
    return rows.select("vec_id", "label", F.col("is_test").cast("int").alias("is_test"))


@query(
    "m1_split_by_flight",
    """SELECT flight_id, w, y_fault, CAST(row_number <= round(0.2 * n) AS INTEGER) AS is_test
       FROM (SELECT flight_id, y_fault,
                    row_number() OVER (PARTITION BY y_fault ORDER BY md5('42|' || flight_id), flight_id) AS row_number,
                    count(*) OVER (PARTITION BY y_fault) AS n FROM truth)
       JOIN centres USING (flight_id)""",
)
def m1_flight(spark, sf):
    windows = views.windows(spark, sf).select("flight_id", "w", "y_fault")
    rows = splits.stratified_split(windows, ["flight_id", "w"], "y_fault", group_by="flight_id")
    return rows.withColumn("is_test", F.col("is_test").cast("int"))


# Epochs of the registered network.
EPOCHS = 30

# The fitted model of (application, tables): trained once, read by every query that scores with it.
FITTED = {}


def boosted(spark, sf):
    """The boosted model of full size, its training rows and its test rows."""
    key = spark.sparkContext.applicationId, sf
    if key not in FITTED:
        train, test = split_features(spark, sf)
        FITTED[key] = models.fit_boosted(train, models.feature_columns(train)), train, test
    return FITTED[key]


def consistent(scored):
    """Adds `consistent`: 1 where probability, label, type and level of a prediction are possible and agree."""
    sound = (
        F.col("fault_prob").between(0, 1)
        & (F.col("fault_label") == (F.col("fault_prob") >= 0.5).cast("int"))
        & F.col("fault_type").between(0, 4)
        & (F.col("severity_level") == severity_level(F.col("severity_continuous")))
        & F.col("severity_level").between(0, 3)
    )
    return scored.withColumn("consistent", F.coalesce(sound.cast("int"), F.lit(0)))


def judged(model, train, test):
    """Test windows with their truth, whether each prediction is consistent, and whether the training rows are learned.

    The synthetic events carry no signal about their flight, so on the test rows nothing has to beat the majority class. On
    the training rows a model of full size has to be right where the majority class is wrong, for two rows in three at least.
    """
    keep = ["flight_id", "w", *models.LABELS]
    return consistent(models.predict(model, test, keep)).select(*keep, "consistent", learned(model, train).alias("learned"))


def learned(model, train):
    """1 if two thirds of the training rows that the most frequent type would miss have their type, and of fault labels too."""
    scored = models.predict(model, train, ["flight_id", "w", *models.LABELS])
    healthy, kind = F.mode("y_fault"), F.mode("y_type")
    usual = scored.agg(F.struct(healthy.alias("fault"), kind.alias("kind")).alias("u")).scalar()
    scored = scored.withColumn("u", usual)
    hit = lambda truth, guess, u: F.avg(F.when(F.col(truth) != F.col(f"u.{u}"), (F.col(truth) == F.col(guess)).cast("int")))
    return scored.agg((F.least(hit("y_fault", "fault_label", "fault"), hit("y_type", "fault_type", "kind")) >= 2 / 3).cast("int")).scalar()


JUDGED = "SELECT flight_id, w, y_fault, y_type, y_sev, 1 AS consistent, 1 AS learned FROM window_split WHERE is_test"


@query("m2_boosted_trees", JUDGED)
def m2(spark, sf):
    return judged(*boosted(spark, sf))


# Of the windows that were trained on and are not of the most frequent type, two thirds at least have their type.
@query(
    "m3_batch_predict",
    """SELECT flight_id, w, 1 AS consistent, 1 AS learned, CAST(is_test AS INTEGER) AS is_test FROM window_split""",
)
def m3(spark, sf):
    model, train, test = boosted(spark, sf)
    both = test.withColumn("is_test", F.lit(1)).unionByName(train.withColumn("is_test", F.lit(0)))
    scored = models.predict(model, both, ["flight_id", "w", "is_test"])
    return consistent(scored).select("flight_id", "w", "consistent", learned(model, train).alias("learned"), "is_test")


@query(
    "m4_postprocess",
    f"""SELECT model, flight_id, w, {r('fault_prob', 'severity_continuous')}, fault_type, fault_label, severity_level,
               fault_type_name FROM pred""",
)
def m4(spark, sf):
    scored = views.predictions(spark, sf).select(
        "model", "flight_id", "w", "fault_prob", "severity_continuous", "fault_type"
    )
    return rounded(monitor.postprocess(scored))


@query("m5_random_forest", JUDGED)
def m5(spark, sf):
    train, test = split_features(spark, sf)
    model = models.fit_forest(train, models.feature_columns(train))
    return judged(model, train, test)


@query(
    "m5_class_weights",
    f"""SELECT quality, n, {r('sum(n) OVER () / CAST(count(*) OVER () * n AS DOUBLE) AS weight')}
        FROM (SELECT quality, count(*) AS n FROM labels GROUP BY quality)""",
)
def m5_weights(spark, sf):
    return rounded(splits.class_weights(views.table(spark, sf, "labels"), "quality"))


def isolated(spark, sf):
    rows = durable(
        views.vectors(spark, sf).select("vec_id", "vec", F.when(F.col("label") < 5, 0).otherwise(1).alias("y_fault"))
    )
    forest = isolation.fit(rows.where("y_fault = 0"), ["vec_id"])
    return forest, rows


@query(
    "m6_isolation_forest",
    """SELECT CAST(tree AS INTEGER) AS tree, CAST(least(256, n) AS INTEGER) AS sample, 1 AS is_tree
       FROM (SELECT unnest(range(200)) AS tree), (SELECT count(*) AS n FROM embeddings WHERE label < 5)""",
)
def m6(spark, sf):
    forest, _ = isolated(spark, sf)
    leaf, inner = F.col("feature") < 0, F.col("feature") >= 0
    children = F.collect_set(F.when(inner, F.col("left"))), F.collect_set(F.when(inner, F.col("right")))
    whole = (F.count_if(leaf) == F.count_if(inner) + 1) & (F.size(F.array_union(*children)) == F.count(F.lit(1)) - 1)
    return forest.groupBy("tree", "sample").agg((whole & (F.min(F.when(leaf, F.col("path"))) > 0)).cast("int").alias("is_tree"))


@query(
    "m7_anomaly_scores",
    """SELECT vec_id, CASE WHEN label < 5 THEN 0 ELSE 1 END AS y_fault, 1 AS in_range, 1 AS flag_agrees,
              (SELECT count(*) - CAST(ceil(0.95 * (count(*) - 1)) AS BIGINT) FROM embeddings WHERE label < 5) AS healthy_flagged
       FROM embeddings""",
)
def m7(spark, sf):
    forest, rows = isolated(spark, sf)
    found = durable(isolation.flag_anomalies(durable(isolation.score(forest, rows).drop("vec"))))
    flagged = found.agg(F.count_if((F.col("y_fault") == 0) & (F.col("flag") == 1))).scalar()
    agrees = (F.col("flag") == (F.col("score") >= F.col("threshold")).cast("int")).cast("int")
    in_range = ((F.col("score") > 0) & (F.col("score") < 1)).cast("int")
    return found.select("vec_id", "y_fault", in_range.alias("in_range"), agrees.alias("flag_agrees"), flagged.alias("healthy_flagged"))


@query(
    "m8_healthy_threshold",
    f"""WITH t AS (SELECT quantile_cont(l_extendedprice, 0.95) AS threshold FROM lineitem WHERE l_returnflag <> 'R')
        SELECT l_linestatus, {r('threshold', digits=4)}, CAST(l_extendedprice >= threshold AS INTEGER) AS flag, count(*) AS n
        FROM lineitem, t GROUP BY ALL""",
)
def m8(spark, sf):
    items = views.table(spark, sf, "lineitem").select(
        "l_linestatus",
        F.col("l_extendedprice").alias("score"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y_fault"),
    )
    flagged = isolation.flag_anomalies(items)
    return rounded(flagged.groupBy("l_linestatus", "threshold", "flag").agg(F.count(F.lit(1)).alias("n")), 4)


@query(
    "m9_knn_fit",
    f"""SELECT vec_id AS id, code, CAST(pos - 1 AS INTEGER) AS pos, {r('z')}
        FROM (SELECT vec_id, code, unnest(vec) AS z, generate_subscripts(vec, 1) AS pos FROM scaled WHERE NOT is_test)""",
)
def m9(spark, sf):
    model, _ = knn_parts(spark, sf)
    return rounded(model.train.select("id", "code", F.posexplode("vec").alias("pos", "z")))


@query(
    "m10_knn_neighbours",
    f"SELECT qid, CAST(rank AS INTEGER) AS rank, id, code, {r('distance')} FROM near",
)
def m10(spark, sf):
    model, queries = knn_parts(spark, sf)
    return rounded(knn.neighbours(model, queries))


@query("m11_knn_vote", "SELECT qid, code, votes FROM voted")
def m11(spark, sf):
    model, queries = knn_parts(spark, sf)
    return knn.majority_vote(knn.neighbours(model, queries))


@query(
    "m12_knn_triplet",
    """SELECT qid, code, CAST(code // 100 AS INTEGER) AS fault, CAST((code // 10) % 10 AS INTEGER) AS type,
              CAST(code % 10 AS INTEGER) AS sev FROM voted""",
)
def m12(spark, sf):
    model, queries = knn_parts(spark, sf)
    return knn.predict(model, queries)


NETWORKS = {}


def trained_network(spark, sf):
    """The network of its best epoch, its history, and the rows it was trained and validated on."""
    key = spark.sparkContext.applicationId, sf
    if key not in NETWORKS:
        train, test = split_features(spark, sf)
        folder = fresh_folder(spark)
        model = network.created(train, models.feature_columns(train))
        log = network.train_on("network", model, train, test, folder, EPOCHS)
        NETWORKS[key] = network.Network.load(spark, f"{folder}/weights"), log, train, test
    return NETWORKS[key]


def head_rows(model, rows):
    """Rows with the probabilities of the three heads and labels as positions in them."""
    position = F.array_position(F.array(*[F.lit(k) for k in model.kinds]), F.col("y_type").cast("int")) - 1
    return model.transform(rows).withColumn("y_type", position.cast("int"))


def priors(rows, classes: int, label: str):
    """Cross-entropy of always giving the shares of the classes."""
    shares = [F.avg((F.col(label) == c).cast("int")) for c in range(classes)]
    return sum((F.when(p > 0, -p * F.ln(p)).otherwise(0.0) for p in shares), F.lit(0.0))


# The last epoch's network: the class shares alone are worse on the training rows, and the loss falls.
@query(
    "m13_three_head_network",
    """SELECT flight_id, w, y_fault, y_type, y_sev, 1 AS distributions, 1 AS beats_prior, 1 AS loss_falls
       FROM window_split WHERE is_test""",
)
def m13(spark, sf):
    model, log, train, test = trained_network(spark, sf)

    def proper(head: str, size: int):
        p = F.col(f"prob_{head}")
        total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
        return (F.size(p) == size) & (F.array_min(p) >= 0) & (F.abs(total - 1) < 1e-6)

    sound = proper("fault", 2) & proper("type", len(model.kinds)) & proper("sev", 4)
    coded = head_rows(model, train).withColumn("model", F.lit("network"))
    reached = head_losses(coded, {h: (f"y_{h}", f"prob_{h}", w) for h, w in LOSS_WEIGHTS.items()}).select("loss").scalar()
    sizes = {"fault": 2, "type": len(model.kinds), "sev": 4}
    prior = coded.agg(sum((priors(coded, n, f"y_{h}") * LOSS_WEIGHTS[h] for h, n in sizes.items()), F.lit(0.0))).scalar()
    falls = log.agg((F.max_by("train_loss", "epoch") < F.min_by("train_loss", "epoch")).cast("int")).scalar()
    return model.transform(test).select(
        "flight_id", "w", *models.LABELS, sound.cast("int").alias("distributions"), (reached < prior).cast("int").alias("beats_prior"),
        falls.alias("loss_falls"),
    )


# The loss of the network's own probabilities, worked out here and during training.
@query(
    "m14_network_loss",
    """SELECT 'network' AS model, count(*) AS n, 1 AS weighted, 1 AS as_in_training FROM window_split WHERE is_test""",
)
def m14_network(spark, sf):
    model, log, _, test = trained_network(spark, sf)
    rows = head_rows(model, test).withColumn("model", F.lit("network"))
    found = head_losses(rows, {h: (f"y_{h}", f"prob_{h}", w) for h, w in LOSS_WEIGHTS.items()})
    total = sum((F.col(f"loss_{h}") * w for h, w in LOSS_WEIGHTS.items()), F.lit(0.0))
    told = log.agg(F.max_by("val_loss", "epoch")).scalar()
    return found.select(
        "model", rows.agg(F.count(F.lit(1))).scalar().alias("n"), (F.abs(F.col("loss") - total) < 1e-9).cast("int").alias("weighted"),
        (F.abs(F.col("loss") - told) < 1e-6).cast("int").alias("as_in_training"),
    )


@query(
    "m14_multitask_loss",
    f"""SELECT model, {r('lf AS loss_fault', 'lt AS loss_type', 'ls AS loss_sev', '2 * lf + lt + ls AS loss')}
        FROM (SELECT model, avg(-ln(greatest(CASE WHEN y_fault = 1 THEN fault_prob ELSE 1 - fault_prob END, 1e-15))) AS lf,
                     avg(-ln(CASE WHEN y_type = fault_type THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END)) AS lt,
                     avg(-ln(CASE WHEN y_sev = severity_level THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END)) AS ls
              FROM pred GROUP BY model)""",
)
def m14(spark, sf):
    rows = views.predictions(spark, sf)

    def peaked(column: str, classes: int, top: float):
        return F.array(*[F.when(F.col(column) == c, F.lit(top)).otherwise(F.lit(0.1)) for c in range(classes)])

    rows = rows.withColumns(
        {
            "prob_fault": F.array(1 - F.col("fault_prob"), F.col("fault_prob")),
            "prob_type": peaked("fault_type", 5, 0.6),
            "prob_sev": peaked("severity_level", 4, 0.7),
        }
    )
    labels = {"fault": "y_fault", "type": "y_type", "sev": "y_sev"}
    return rounded(head_losses(rows, {h: (labels[h], f"prob_{h}", w) for h, w in LOSS_WEIGHTS.items()}))


@query(
    "m15_best_run",
    f"""SELECT run, epoch, {r('val_loss')}, CAST(row_number() OVER (ORDER BY val_loss, run) = 1 AS INTEGER) AS is_best
        FROM (SELECT run, min(val_loss) AS val_loss, arg_min(epoch, (val_loss, epoch)) AS epoch FROM run_log GROUP BY run)""",
)
def m15(spark, sf):
    return rounded(models.best_epochs(views.run_log(spark, sf)))


SETTINGS = {
    "narrow": {"hidden": (16,), "rate": 0.01}, "shallow": {"hidden": (64,)}, "deep": {"hidden": (64, 32)}, "slow": {"hidden": (64, 32), "rate": 0.0005},
}


# Real runs: the earlier half of them trains on, and the network that comes back is the chosen run's best epoch.
@query(
    "m15_run_selection",
    """SELECT unnest(['deep', 'narrow', 'shallow', 'slow']) AS run, 1 AS history_whole, 1 AS least_of_run, 1 AS best_is_least,
              1 AS restored""",
)
def m15_runs(spark, sf):
    train, test = split_features(spark, sf)
    folder = fresh_folder(spark)
    log = durable(network.halved(train, test, models.feature_columns(train), SETTINGS, folder))
    best = models.best_epochs(log)
    chosen = best.where("is_best = 1").first()
    model = network.restored(spark, f"{folder}/{chosen.run}")
    again = head_losses(
        head_rows(model, test).withColumn("model", F.lit(chosen.run)), {h: (f"y_{h}", f"prob_{h}", w) for h, w in LOSS_WEIGHTS.items()}
    )
    same = again.select((F.abs(F.col("loss") - chosen.val_loss) < 1e-6).cast("int")).scalar()
    least = log.agg(F.min("val_loss")).scalar()
    runs = log.groupBy("run").agg(F.min("val_loss").alias("least"), F.count(F.lit(1)).alias("n"), F.max("epoch").alias("last"))
    return best.join(runs, "run").select(
        "run", (F.col("n") == F.col("last") + 1).cast("int").alias("history_whole"), (F.col("val_loss") == F.col("least")).cast("int").alias("least_of_run"),
        ((F.col("is_best") == 1) == (F.col("least") == least)).cast("int").alias("best_is_least"), same.alias("restored"),
    )


@query(
    "m16_training_history",
    f"""SELECT 'boost' AS run, CAST(epoch AS INTEGER) AS epoch, 1 AS finite, 1 AS train_loss_falls
        FROM (SELECT unnest(range(1, {BOOST_TREES} + 1)) AS epoch)""",
)
def m16(spark, sf):
    log = durable(models.training_history(*boosted(spark, sf), "boost"))
    falls = log.agg((F.max_by("train_loss", "epoch") < 0.5 * F.min_by("train_loss", "epoch")).cast("int")).scalar()
    finite = (F.abs("train_loss") < float("inf")) & (F.abs("val_loss") < float("inf"))
    return log.select("run", "epoch", finite.cast("int").alias("finite"), falls.alias("train_loss_falls"))


@query(
    "m17_principal_components",
    """SELECT vec_id, 1 AS centred, 1 AS descending, 1 AS uncorrelated, 1 AS shares_agree FROM embeddings""",
)
def m17(spark, sf):
    vectors = durable(views.vectors(spark, sf).select("vec_id", "vec"))
    projected, shares = models.principal_components(vectors, ["vec_id"])
    projected = durable(projected)
    cells = vectors.select(F.posexplode("vec").alias("pos", "x")).groupBy("pos").agg(F.var_samp("x").alias("v"))
    total = cells.agg(F.sum("v")).scalar()
    first, second = F.var_samp("pc1"), F.var_samp("pc2")
    facts = projected.agg(
        F.struct(
            ((F.abs(F.avg("pc1")) < 1e-9) & (F.abs(F.avg("pc2")) < 1e-9)).cast("int").alias("centred"),
            (first >= second).cast("int").alias("descending"),
            (F.abs(F.corr("pc1", "pc2")) < 1e-6).cast("int").alias("uncorrelated"),
            F.struct(first.alias("a"), second.alias("b")).alias("v"),
        )
    ).scalar()
    agree = (F.abs(facts["v"]["a"] / total - shares[0]) < 1e-9) & (F.abs(facts["v"]["b"] / total - shares[1]) < 1e-9)
    return projected.select("vec_id", *[facts[c].alias(c) for c in ("centred", "descending", "uncorrelated")], agree.cast("int").alias("shares_agree"))


@query("s11_model_reload", "SELECT flight_id, w, 1 AS same FROM window_split WHERE is_test")
def s11(spark, sf):
    fitted, _, test = boosted(spark, sf)
    folder = fresh_folder(spark)
    models.save(fitted, folder)
    model, columns = models.load(folder)
    keys, facts = ["flight_id", "w"], ["fault_prob", "fault_type", "severity_continuous"]
    before = models.predict(fitted, test).select(*keys, F.struct(*facts).alias("before"))
    after = models.predict(model, test.select(*keys, *columns)).select(*keys, F.struct(*facts).alias("after"))
    return before.join(after, keys, "left").select(*keys, F.expr("CAST(before <=> after AS INT)").alias("same"))


@query(
    "s11_knn_reload",
    "SELECT qid, code, votes FROM voted",
)
def s11_knn(spark, sf):
    model, queries = knn_parts(spark, sf)
    folder = fresh_folder(spark)
    knn.save(model, folder)
    model, _ = knn.load(spark, folder)
    return knn.majority_vote(knn.neighbours(model, queries))


def window_vectors(rows, columns):
    """Window features as the neighbours take them: an id, a vector and the combined label code."""
    code = encode_combined(F.col("y_fault"), F.col("y_type"), F.col("y_sev"))
    return rows.select(F.concat_ws("|", "flight_id", "w").alias("id"), F.array(*columns).alias("vec"), code.alias("code"))


def trained_predictions(spark, sf):
    """(model, labels, predicted labels) of the three trained models on one split: boosted trees, neighbours, network."""
    trees, train, test = boosted(spark, sf)
    labels = list(models.LABELS)
    first = models.predict(trees, test, labels)

    columns = models.feature_columns(train)
    near = knn.fit(window_vectors(train, columns))
    voted = knn.predict(near, window_vectors(test, columns).select(F.col("id").alias("qid"), "vec"))
    keyed = test.select(F.concat_ws("|", "flight_id", "w").alias("qid"), *labels)
    second = keyed.join(voted, "qid").select(
        *labels, F.col("fault").alias("fault_label"), F.col("type").alias("fault_type"), F.col("sev").alias("severity_level")
    )

    net = trained_network(spark, sf)[0]
    likeliest = lambda h: F.array_position(f"prob_{h}", F.array_max(f"prob_{h}")).cast("int")
    kinds = F.array(*[F.lit(k) for k in net.kinds])
    third = net.transform(test).select(
        *labels, (F.get("prob_fault", F.lit(1)) >= 0.5).cast("int").alias("fault_label"),
        F.element_at(kinds, likeliest("type")).alias("fault_type"), (likeliest("sev") - 1).alias("severity_level"),
    )
    rows = None
    for name, found in (("boosted", first), ("neighbours", second), ("network", third)):
        part = found.select(F.lit(name).alias("model"), *labels, "fault_label", "fault_type", "severity_level")
        rows = part if rows is None else rows.unionByName(part)
    return rows


# The comparison of trained models; each of its figures is held against a plain average over the same rows.
@query(
    "e9_trained_models",
    """SELECT unnest(['boosted', 'neighbours', 'network']) AS model, count(*) AS n, 1 AS in_range, 1 AS as_averaged
       FROM window_split WHERE is_test""",
)
def e9_trained(spark, sf):
    rows = durable(trained_predictions(spark, sf))
    same = lambda a, b: F.avg((F.col(a) == F.col(b)).cast("int"))
    plain = rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), same("y_fault", "fault_label").alias("a"), same("y_type", "fault_type").alias("b"),
        same("y_sev", "severity_level").alias("c"), F.avg(F.abs(F.col("y_sev") - F.col("severity_level"))).alias("d"),
    )
    table = compare_models(rows)
    shares = [c for c in table.columns if c not in ("model", "sev_mae")]
    in_range = F.col("sev_mae").between(0, 3)
    for c in shares:
        in_range = in_range & F.col(c).between(0, 1)
    agrees = F.lit(True)
    for a, c in (("a", "fault_acc"), ("b", "type_acc"), ("c", "sev_acc"), ("d", "sev_mae")):
        agrees = agrees & (F.abs(F.col(a) - F.col(c)) < 1e-9)
    return table.join(plain, "model").select("model", "n", in_range.cast("int").alias("in_range"), agrees.cast("int").alias("as_averaged"))


@query("g9_score_flights", f"SELECT flight_id, w, {r('t')}, 1 AS consistent, 1 AS learned FROM centres")
def g9(spark, sf):
    model, train, _ = boosted(spark, sf)
    stats = durable(scaling.channel_stats(grid(spark, sf), CHANNELS))
    scored = consistent(score_flights(views.raw(spark, sf), stats, model, CHANNELS))
    return rounded(scored.select("flight_id", "w", "t", "consistent", learned(model, train).alias("learned")))
