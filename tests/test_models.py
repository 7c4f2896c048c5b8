import math
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultframe.functions.labels import decode_combined, encode_combined
from faultframe.functions.numeric import severity_level
from faultframe.operators import boosting, evaluate as ev, isolation, knn, models, monitor as mon, network
from faultframe.plans import queries_models
from faultframe.plans.registry import registered


def vectors(spark, x, codes=None, first=0):
    rows = [(first + i, [float(c) for c in v], int(codes[i]) if codes is not None else 0) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, vec array<double>, code int")


def brute_force(train, queries, k):
    mean, std = train.mean(0), train.std(0)
    std[std == 0] = 1
    a, b = (train - mean) / std, (queries - mean) / std
    far = np.sqrt(((b[:, None] - a[None]) ** 2).sum(-1)).round(knn.DECIMALS)
    order = np.lexsort((np.broadcast_to(np.arange(len(a)), far.shape), far), axis=1)[:, :k]
    return order, np.take_along_axis(far, order, 1)


@pytest.mark.parametrize("pivots, block, piece", [(1, 1000, 1000), (8, 20, 7), (32, 5, 1000)])
def test_neighbours_equal_brute_force(spark, pivots, block, piece):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 5)) * 8
    # A third of the rows are copies of one vector.
    train = np.concatenate([centres[rng.integers(0, 6, 140)] + rng.normal(size=(140, 5)), np.tile(centres[0], (70, 1))])
    train[:, 4] = 1.0
    queries = np.concatenate([rng.normal(size=(25, 5)) * 8, centres[:1]])
    model = knn.fit(vectors(spark, train), k=5, pivots=pivots)
    asked = vectors(spark, queries).select(F.col("id").alias("qid"), "vec")
    found = knn.neighbours(model, asked, train_block=block, query_slice=piece).toPandas().sort_values(["qid", "rank"])
    ids, far = brute_force(train, queries, 5)
    assert (found.id.to_numpy().reshape(-1, 5) == ids).all()
    assert np.allclose(found.distance.to_numpy().reshape(-1, 5), far, atol=1e-8)


def test_neighbours_of_a_small_training_set_and_reload(spark, rows, tmp_path):
    model = knn.fit(vectors(spark, [[0, 0], [1, 0], [1, 1]], [120, 0, 120]), k=5)
    asked = spark.createDataFrame([(7, [0.9, 0.9])], "qid long, vec array<double>")
    assert rows(knn.neighbours(model, asked), "rank", "id") == [(1, 2), (2, 1), (3, 0)]
    assert rows(knn.predict(model, asked)) == [(7, 120, 1, 2, 0)]
    knn.save(model, str(tmp_path / "knn"), ["a", "b"])
    back, columns = knn.load(spark, str(tmp_path / "knn"))
    assert columns == ["a", "b"] and rows(knn.predict(back, asked)) == [(7, 120, 1, 2, 0)]


def test_vote_ties_take_the_lowest_code(spark, rows):
    found = spark.createDataFrame([(1, 30), (1, 20), (1, 30), (1, 20), (1, 99)], "qid long, code int")
    assert rows(knn.majority_vote(found)) == [(1, 20, 2)]


def test_label_codes(spark, rows):
    df = spark.createDataFrame([(0, 0, 0), (1, 2, 3), (1, 4, 0)], "f int, t int, s int")
    code = encode_combined(F.col("f"), F.col("t"), F.col("s"))
    coded = df.select("*", code.alias("code"))
    assert rows(coded, "code") == [(0,), (123,), (140,)]
    decoded = coded.select(*[c.alias(n) for n, c in decode_combined(F.col("code")).items()])
    assert rows(decoded) == rows(df)
    assert rows(ev.distinct_codes(coded.union(coded), "code")) == [(0, 0, 0, 0), (123, 1, 2, 3), (140, 1, 4, 0)]


def test_severity_rounds_half_to_even(spark):
    df = spark.createDataFrame([(x,) for x in (-0.5, 0.5, 1.5, 2.5, 3.5)], "severity_continuous double")
    df = df.select("*", F.lit(0.5).alias("fault_prob"), F.lit(4).alias("fault_type"))
    found = mon.postprocess(df).orderBy("severity_continuous").collect()
    assert [r.severity_level for r in found] == [0, 0, 2, 2, 3]
    assert found[0].fault_label == 1 and found[0].fault_type_name == "Unknown (4)"


def pairs(spark, truth, pred):
    return spark.createDataFrame([("m", int(a), int(b)) for a, b in zip(truth, pred)], "model string, t int, p int")


def reference_f1(truth, pred, label):
    tp = sum(a == b == label for a, b in zip(truth, pred))
    wrong = sum((a == label) != (b == label) for a, b in zip(truth, pred))
    return 2 * tp / (2 * tp + wrong) if tp + wrong else 0.0


def test_metrics_on_labels_missing_from_one_side(spark, rows):
    truth, pred = [0, 0, 1, 1, 2], [0, 1, 1, 3, 3]
    df = pairs(spark, truth, pred)
    assert ev.accuracy(df, "t", "p").first().accuracy == 0.4
    macro = ev.macro_f1(df, "t", "p").first()
    assert macro.n_labels == 4
    assert macro.f1_macro == pytest.approx(np.mean([reference_f1(truth, pred, c) for c in range(4)]))
    matrix = {(r.truth, r.pred): r.n for r in ev.confusion_matrix(df, "t", "p").collect()}
    assert len(matrix) == 16 and sum(matrix.values()) == 5 and matrix[2, 3] == 1 and matrix[3, 3] == 0
    labels = spark.createDataFrame([(0,), (9,)], "label int")
    assert rows(ev.restricted_confusion(df, "t", "p", labels)) == [("m", 0, 0, 1), ("m", 0, 9, 0), ("m", 9, 0, 0), ("m", 9, 9, 0)]
    labels = spark.createDataFrame([(0,), (1,)], "label int")
    assert rows(ev.restricted_confusion(df, "t", "p", labels)) == [("m", 0, 0, 1), ("m", 0, 1, 1), ("m", 1, 0, 0), ("m", 1, 1, 1)]


def test_binary_f1_without_predicted_positives(spark):
    df = spark.createDataFrame([("m", 1, 0.2), ("m", 0, 0.1)], "model string, t int, prob double")
    row = ev.binary_scores(df, "t", "prob").first()
    assert (row.f1, row.accuracy, row.fn) == (0.0, 0.5, 1)
    assert ev.binary_scores(df, "t", "prob", 0.2).first().f1 == 1.0


def test_severity_errors(spark):
    df = spark.createDataFrame([("m", 2, 2.5), ("m", 3, 9.0), ("m", 0, -0.4)], "model string, t int, x double")
    row = ev.severity_errors(df, "t", "x").first()
    assert row.mae == pytest.approx(6.9 / 3) and row.mae_levels == 0.0


def test_multitask_loss(spark):
    df = spark.createDataFrame([("m", 1, [0.2, 0.8]), ("m", 0, [0.0, 1.0])], "model string, y int, p array<double>")
    row = ev.head_losses(df, {"fault": ("y", "p", 2.0)}).first()
    expected = (-math.log(0.8) - math.log(1e-15)) / 2
    assert row.loss_fault == pytest.approx(expected) and row.loss == pytest.approx(2 * expected)


def test_best_run(spark, rows):
    log = spark.createDataFrame(
        [("a", 1, 0.9, 0.5), ("a", 2, 0.8, 0.3), ("b", 1, 0.9, 0.3), ("b", 2, 0.1, 0.7)],
        "run string, epoch int, train_loss double, val_loss double",
    )
    assert rows(models.best_run(log)) == [("a", 2, 0.8, 0.3)]
    assert rows(models.best_epochs(log)) == [("a", 2, 0.3, 1), ("b", 1, 0.3, 0)]


def planted(spark, n=240):
    """Windows whose first feature tells the fault, the second the type, the third the severity."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        kind = int(rng.integers(0, 3))
        severity = int(rng.integers(1, 4)) if kind else 0
        noise = rng.normal(scale=0.1, size=4)
        rows.append((f"f{i % 8}", i, kind and 1.0 + noise[0], kind + noise[1], severity + noise[2], noise[3], int(kind > 0), kind, severity))
    schema = "flight_id string, w long, a double, b double, c double, d double, y_fault int, y_type int, y_sev int"
    return spark.createDataFrame([tuple(float(v) if 1 < j < 6 else v for j, v in enumerate(r)) for r in rows], schema)


def check(scored):
    hits = scored.select(
        F.avg((F.col("y_fault") == F.col("fault_label")).cast("int")),
        F.avg((F.col("y_type") == F.col("fault_type")).cast("int")),
        F.avg((F.col("y_sev") == F.col("severity_level")).cast("int")),
    ).first()
    assert all(h > 0.9 for h in hits), hits


def test_tree_models_find_the_planted_signal_and_reload(spark, rows, tmp_path):
    df = planted(spark)
    train, test = df.where("w % 4 > 0"), df.where("w % 4 = 0")
    columns = models.feature_columns(df)
    assert columns == ["a", "b", "c", "d"]
    keep = ["flight_id", "w", *models.LABELS]
    boosted = models.fit_boosted(train, columns, trees=12, depth=3, rate=0.3)
    scored = models.predict(boosted, test, keep)
    check(scored)
    models.save(boosted, str(tmp_path / "boost"))
    back, names = models.load(str(tmp_path / "boost"))
    assert names == columns
    assert rows(models.predict(back, test, keep)) == rows(scored)
    log = models.training_history(boosted, train, test, "r").orderBy("epoch").collect()
    assert [r.epoch for r in log] == list(range(1, 13)) and log[-1].train_loss < log[0].train_loss
    # More rounds later are the same as in one go.
    begun = boosting.fit(train, columns, rounds=5, depth=3, rate=0.3)
    gone_on = boosting.fit(train, columns, rounds=7, start=begun)
    after, at_once = (models.predict(m, test, keep).orderBy("flight_id", "w").toPandas() for m in (gone_on, boosted))
    assert np.allclose(after[["fault_prob", "severity_continuous"]], at_once[["fault_prob", "severity_continuous"]])
    assert (after.fault_type == at_once.fault_type).all()
    check(models.predict(models.fit_forest(train, columns, trees=8, depth=6), test, keep))


def plain_splits(bins, slope, curve, penalty, least):
    """Every column and bin of one node, row by row: (gain, column, bin) of the best, the first of equal ones."""
    best = (0.0, 0, 0)
    score = lambda g, h: g * g / (h + penalty)
    for c in range(bins.shape[1]):
        for cut in sorted(set(bins[:, c].tolist()))[:-1]:
            left = bins[:, c] <= cut
            sides = [(slope[s].sum(), curve[s].sum()) for s in (left, ~left)]
            if min(h for _, h in sides) >= least:
                gain = (sum(score(*s) for s in sides) - score(slope.sum(), curve.sum())) / 2
                if gain > best[0] + 1e-9:
                    best = (gain, c, cut)
    return best


def test_histogram_splits_equal_a_plain_search():
    rng = np.random.default_rng(12)
    bins = rng.integers(0, 12, (300, 5)).astype(np.uint8)
    slope, curve = rng.normal(size=(300, 2)), rng.uniform(0.1, 1, (300, 2))
    slots = np.stack([rng.integers(-1, 3, 300), rng.integers(-1, 2, 300) + 3], axis=1)
    slots[slots[:, 1] == 2, 1] = -1
    cells = boosting.histograms(bins, slope, curve, slots, 5)
    found = boosting.best_splits(cells, np.ones((5, 5), bool), 1.0, 2.0)
    for s in range(5):
        k = int(s >= 3)
        mine = slots[:, k] == s
        gain, column, cut = plain_splits(bins[mine], slope[mine, k], curve[mine, k], 1.0, 2.0)
        assert found[s][1:3] == (column, cut) and found[s][0] == pytest.approx(gain)
        assert found[s][5:] == pytest.approx((slope[mine, k].sum(), curve[mine, k].sum()))
    # What is left of a parent without one child is the other child.
    parent = boosting.histograms(bins, slope, curve, np.where(slots >= 0, 0, -1), 1)
    rest = boosting.Cells.added(np.concatenate([parent.index, cells.of_slots(np.array([0]), 5 * 256)[0]]),
                                np.concatenate([parent.sums, -cells.of_slots(np.array([0]), 5 * 256)[1]]))
    other = boosting.histograms(bins, slope, curve, np.where(slots > 0, 0, -1), 1)
    assert rest.index.tolist() == other.index.tolist() and np.allclose(rest.sums, other.sums)


def plain_tree(bins, slope, curve, depth, rate):
    """(places, values) of a tree that is grown node by node on whole columns."""
    value, todo, out = {}, [(0, np.arange(len(bins)), 0)], np.zeros(len(bins))
    while todo:
        node, rows, level = todo.pop()
        out[rows] = value[node] = -rate * slope[rows].sum() / (curve[rows].sum() + 1.0)
        if level < depth and (node == 0 or curve[rows].sum() >= 2.0):
            gain, column, cut = plain_splits(bins[rows], slope[rows], curve[rows], 1.0, 1.0)
            if gain > boosting.LEAST_GAIN:
                left = bins[rows, column] <= cut
                todo += [(2 * node + 1, rows[left], level + 1), (2 * node + 2, rows[~left], level + 1)]
    return out


@pytest.mark.parametrize("task_rows, task_columns", [(50_000, 64), (60, 2)])
def test_boosted_rounds_equal_a_plain_loop(spark, monkeypatch, task_rows, task_columns):
    """All heads over several rounds, in one task or in many, with all rows and columns in every round."""
    monkeypatch.setattr(boosting, "TASK_ROWS", task_rows)
    monkeypatch.setattr(boosting, "TASK_COLUMNS", task_columns)
    df = planted(spark)
    columns = ["a", "b", "c", "d"]
    model = boosting.fit(df, columns, rounds=3, depth=3, rate=0.3, rows=1.0, share=1.0)
    table = df.toPandas()
    x = table[columns].to_numpy()
    bins = boosting.binned(x, [np.array(c) for c in model.cuts])
    labels = np.stack([table.y_fault, table.y_type, table.y_sev], axis=1).astype(float)
    scores = np.tile(model.base, (len(x), 1))
    for _ in range(3):
        slope, curve = boosting.gradients(scores, labels)
        scores = scores + np.stack([plain_tree(bins, slope[:, k], curve[:, k], 3, 0.3) for k in range(scores.shape[1])], axis=1)
    got = model.raw(df).toPandas()
    assert np.allclose(np.stack(got["scores"].to_list()), scores, atol=1e-9)
    staged = boosting.staged_losses(model, df).orderBy("epoch").toPandas()
    assert np.allclose(staged[["loss_fault", "loss_type", "loss_sev"]].iloc[-1], boosting.losses(scores, labels).mean(axis=0))


def test_a_task_of_boosting_has_one_block_of_rows(spark):
    """However many Arrow batches its rows come in."""
    train = spark.range(300).selectExpr("id", "double(id) x", "id % 2 y_fault", "int(id % 3) y_type", "double(id % 4) y_sev")
    model = boosting.BoostedTrees(["x"], [0, 1, 2], [0.0] * 5, 2, {}, [[100.0, 200.0]])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        blocks = boosting.dealt(train, model, F.xxhash64("id")).map(lambda b: [len(part) for part in b]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert blocks == [[300] * 4]


def test_boosting_of_missing_inputs_and_one_class(spark):
    data = [("f", i, None if i % 3 == 0 else float(i % 3), float("nan") if i % 2 else 1.0, 0, 7, 2) for i in range(60)]
    data += [("f", 100, 1.0, 1.0, None, 7, 2), ("f", 101, 1.0, 1.0, 0, None, 2)]
    df = spark.createDataFrame(data, "flight_id string, w long, a double, b double, y_fault int, y_type int, y_sev int")
    model = boosting.fit(df, ["a", "b"], rounds=2, depth=2)
    scored = models.predict(model, df).collect()
    assert len(scored) == 62 and all(r.fault_type == 7 and r.fault_label == 0 and r.severity_continuous == 2 for r in scored)
    with pytest.raises(ValueError):
        boosting.fit(df.limit(0), ["a", "b"], rounds=1)


def test_softmax_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(4)
    scores, labels = rng.normal(size=(6, 5)), np.stack([[0, 1, 0, 1, 1, 0], [0, 1, 2, 0, 1, 2], [0, 1, 2, 3, 1, 0]], axis=1).astype(float)
    slope, _ = boosting.gradients(scores, labels)
    for k in range(5):
        step = np.zeros(5)
        step[k] = 1e-6
        change = (boosting.losses(scores + step, labels) - boosting.losses(scores - step, labels)).sum(axis=1) / 2e-6
        assert np.allclose(change / (2 if k == 4 else 1), slope[:, k], atol=1e-5)


def test_network_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(5)
    x, labels = rng.normal(size=(9, 4)), np.stack([rng.integers(0, n, 9) for n in (2, 3, 4)], axis=1)
    weights = [0.3 * rng.normal(size=s) for s in [(4, 5), 5, (5, 6), 6, (6, 9), 9]]
    factors = [2.0, 1.0, 1.0]
    loss = lambda w: float(np.dot(factors, network.gradient(x, labels, w, (2, 3, 4), factors)[-2]))
    found = network.gradient(x, labels, weights, (2, 3, 4), factors)
    for i, w in enumerate(weights):
        at = tuple(rng.integers(0, n) for n in w.shape)
        moved = [[v.copy() for v in weights] for _ in range(2)]
        moved[0][i][at] += 1e-6
        moved[1][i][at] -= 1e-6
        assert (loss(moved[0]) - loss(moved[1])) / 2e-6 == pytest.approx(found[i][at], abs=1e-4)


def test_network_learns_three_heads_and_goes_on(spark, tmp_path, monkeypatch):
    df = planted(spark)
    train, test = df.where("w % 4 > 0"), df.where("w % 4 = 0")
    columns, folder = ["a", "b", "c", "d"], str(tmp_path / "one")
    made = lambda: network.created(train, columns, hidden=(16,), rate=0.02, batch=64)
    log = network.train_on("one", made(), train, test, folder, 12).orderBy("epoch").collect()
    assert [r.epoch for r in log] == list(range(13)) and log[-1].train_loss < 0.5 * log[0].train_loss
    model = network.Network.load(spark, f"{folder}/weights")
    found = model.transform(test).toPandas()
    for head, label, size in (("fault", "y_fault", 2), ("type", "y_type", 3), ("sev", "y_sev", 4)):
        p = np.stack(found[f"prob_{head}"].to_list())
        assert p.shape[1] == size and np.allclose(p.sum(1), 1)
        assert (p.argmax(1) == found[label]).mean() > 0.8
    # In many tasks the sums are the same, and a run that goes on is the run itself.
    monkeypatch.setattr(network, "TASK_ROWS", 50)
    other = str(tmp_path / "two")
    network.train_on("two", made(), train, test, other, 5)
    again = network.train_on("two", network.Network.load(spark, f"{other}/weights"), train, test, other, 7).orderBy("epoch").collect()
    assert np.allclose([r.val_loss for r in again], [r.val_loss for r in log])
    best = min(log, key=lambda r: (r.val_loss, r.epoch))
    assert network.restored(spark, folder).epoch == best.epoch


def test_runs_are_halved_and_stop_early(spark, tmp_path):
    df = planted(spark)
    train, test = df.where("w % 4 > 0"), df.where("w % 4 = 0")
    settings = {"good": {"hidden": (16,), "rate": 0.02, "batch": 64}, "lame": {"hidden": (2,), "rate": 1e-6}, "wild": {"hidden": (4,), "rate": 30.0}}
    log = network.halved(train, test, ["a", "b", "c", "d"], settings, str(tmp_path), first=2, patience=3).toPandas()
    assert log.groupby("run").epoch.max()["good"] >= 6 and log.groupby("run").epoch.max()["lame"] < 7
    best = models.best_epochs(spark.createDataFrame(log)).toPandas()
    assert best[best.is_best == 1].run.tolist() == ["good"]
    least = log.sort_values(["val_loss", "run", "epoch"]).iloc[0]
    assert (least.run, least.epoch) == tuple(best[best.is_best == 1][["run", "epoch"]].iloc[0])


def test_isolation_forest_ranks_a_planted_outlier_first(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 3))
    x[17] = [9, -9, 9]
    healthy = vectors(spark, x).drop("code")
    forest = isolation.fit(healthy.where("id <> 17"), ["id"], trees=30, sample=64)
    again = isolation.fit(healthy.where("id <> 17").repartition(5), ["id"], trees=30, sample=64)
    assert sorted(map(tuple, forest.collect())) == sorted(map(tuple, again.collect()))
    scored = isolation.score(forest, healthy).toPandas()
    assert scored.sort_values("score").id.iloc[-1] == 17 and scored.score.between(0, 1).all()
    assert forest.groupBy("tree").count().count() == 30


def test_rows_that_share_an_id_are_not_multiplied(spark):
    rng = np.random.default_rng(10)
    same = spark.createDataFrame([(i // 3, [float(v) for v in x]) for i, x in enumerate(rng.normal(size=(60, 2)))], "id long, vec array<double>")
    forest = isolation.fit(same, ["id"], trees=5, sample=64)
    assert {r["sample"] for r in forest.select("sample").distinct().collect()} == {60}


def test_severity_levels_of_odd_values(spark):
    values = spark.createDataFrame([(None,), (float("nan"),), (1e12,), (-1e12,), (float("inf"),), (0.5,), (2.5,)], "x double")
    assert [r[0] for r in values.select(severity_level(F.col("x"))).collect()] == [None, None, 3, 0, 3, 0, 2]


def test_every_row_can_reach_a_tree(spark):
    """No part of a table larger than all samples together is left out, and samples are full."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 2)).round(9)
    forest = isolation.fit(vectors(spark, x).drop("code"), ["id"], trees=40, sample=64)
    assert {r["sample"] for r in forest.select("sample").distinct().collect()} == {64}
    planted = np.vstack([x, [[50.0, 50.0]] * 600])  # a tenth of the rows, whatever their hashes
    forest = isolation.fit(vectors(spark, planted).drop("code"), ["id"], trees=40, sample=64)
    roots = forest.where("node = 0").toPandas()
    assert (roots.threshold > 5).mean() > 0.5


def test_average_path_of_small_sets():
    assert isolation.average_path(np.array([0, 1, 2])).tolist() == [0.0, 0.0, 1.0]
    harmonic = math.log(255) + np.euler_gamma
    assert isolation.average_path(np.array([256]))[0] == pytest.approx(2 * harmonic - 2 * 255 / 256)


def test_anomaly_threshold(spark):
    rng = np.random.default_rng(7)
    scores, faults = rng.uniform(size=400), rng.integers(0, 2, 400)
    df = spark.createDataFrame([(float(s), int(f)) for s, f in zip(scores, faults)], "score double, y_fault int")
    threshold = np.percentile(scores[faults == 0], 95)
    found = isolation.flag_anomalies(df).toPandas()
    assert found.threshold.unique() == pytest.approx([threshold])
    assert found.flag.sum() == (scores >= threshold).sum()


def test_principal_components_equal_svd(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 4)) @ np.diag([5, 2, 1, 0.5]) + 3
    projected, ratio = models.principal_components(vectors(spark, x), ["id"])
    found = projected.toPandas().sort_values("id")
    centred = x - x.mean(0)
    _, s, v = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(ratio, (s**2 / (s**2).sum())[:2])
    for i in range(2):
        axis = v[i] * np.sign(v[i][np.abs(v[i]).argmax()])
        assert np.allclose(found[f"pc{i + 1}"], centred @ axis)


@pytest.mark.parametrize(
    "name, fit",
    [
        *[(n, "fit_boosted") for n in ("m2_boosted_trees", "m3_batch_predict", "m16_training_history", "s11_model_reload", "g9_score_flights")],
        ("m5_random_forest", "fit_forest"),
    ],
)
def test_registered_models_are_trained_in_full(monkeypatch, name, fit):
    """No registered run gives a size of its own, so that the defaults hold."""
    class Fitted(Exception):
        pass

    def stop(*_, **given):
        raise Fitted(given)

    rows = SimpleNamespace(columns=["flight_id", "w", "a"])
    monkeypatch.setattr(models, fit, stop)
    monkeypatch.setattr(queries_models, "split_features", lambda *_: (rows, rows))
    with pytest.raises(Fitted) as reached:
        registered()[name](SimpleNamespace(sparkContext=SimpleNamespace(applicationId="test")), "")
    assert not reached.value.args[0]
