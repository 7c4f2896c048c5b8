"""One network with three heads on window features, trained together by data-parallel gradient descent.

The hidden layers are shared by the heads for fault (2 classes), type and severity (4 levels); the loss is the weighted sum
of the three cross-entropies. Each step is one job: every partition works out the gradient of its rows of the batch, the
gradients are added in a tree, and the driver takes an Adam step. Weights are the only thing that travels; their size
follows the columns and layers, not the rows. Rows never move after they are dealt out; a batch is a slice of their hash
order, which changes from epoch to epoch.

Weights of every epoch are stored, so that a training can go on from any of them and the best one can be had back.
"""

import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf

from ..settings import LOSS_WEIGHTS
from .boosting import TASK_ROWS, _mixed, _values, softmax

HEADS = ("fault", "type", "sev")
FIRST, SECOND, SMALL = 0.9, 0.999, 1e-8  # Adam's decay rates and the guard of its quotient


@dataclass
class Network:
    """Weights and what is needed to go on: layers, type codes, scaling of the inputs, Adam's moments, epochs so far."""

    columns: list[str]
    kinds: list[int]
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    settings: dict = field(default_factory=dict)
    moments: tuple = ()
    steps: int = 0
    epoch: int = 0

    @property
    def classes(self) -> tuple[int, int, int]:
        return 2, len(self.kinds), 4

    def save(self, spark: SparkSession, folder: str) -> None:
        """The state after this epoch, one row of the folder's table."""
        row = [(self.epoch, bytearray(pickle.dumps(self.__dict__)))]
        spark.createDataFrame(row, "epoch int, state binary").write.mode("append").parquet(folder)

    @staticmethod
    def load(spark: SparkSession, folder: str, epoch: int | None = None) -> "Network":
        """The state after an epoch, the last one unless given."""
        states = spark.read.parquet(folder)
        chosen = states.where(F.col("epoch") == epoch) if epoch is not None else states.orderBy(F.desc("epoch"))
        return Network(**pickle.loads(bytes(chosen.first().state)))

    def transform(self, frame: DataFrame) -> DataFrame:
        """`frame` with prob_fault, prob_type and prob_sev as arrays; missing inputs count as the mean."""
        shared = frame.sparkSession.sparkContext.broadcast((self.weights, self.mean, self.scale, self.classes))
        width = len(self.columns)

        @pandas_udf("prob_fault array<double>, prob_type array<double>, prob_sev array<double>")
        def probabilities(values: pd.Series) -> pd.DataFrame:
            weights, mean, scale, classes = shared.value
            x = scaled(np.array(values.to_list(), dtype=np.float64).reshape(-1, width), mean, scale)
            return pd.DataFrame({f"prob_{h}": list(p) for h, p in zip(HEADS, heads(forward(x, weights)[-1], classes), strict=True)})

        found = frame.withColumn("__p", probabilities(_values(self.columns)))
        return found.withColumns({f"prob_{h}": F.col(f"__p.prob_{h}") for h in HEADS}).drop("__p")


def scaled(values: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.nan_to_num((values - mean) / scale, nan=0.0, posinf=0.0, neginf=0.0)


def forward(x: np.ndarray, weights: list[np.ndarray]) -> list[np.ndarray]:
    """The output of every layer: rectified hidden layers, then the scores of all heads side by side."""
    out = [x]
    for i in range(0, len(weights), 2):
        x = x @ weights[i] + weights[i + 1]
        x = np.maximum(x, 0) if i + 2 < len(weights) else x
        out.append(x)
    return out


def heads(scores: np.ndarray, classes) -> list[np.ndarray]:
    return [softmax(s) for s in np.split(scores, np.cumsum(classes)[:-1], axis=1)]


def gradient(x: np.ndarray, labels: np.ndarray, weights: list[np.ndarray], classes, factors) -> list[np.ndarray]:
    """Sums over the rows: of the gradients of the weighted loss by each weight, and of the three losses."""
    layers = forward(x, weights)
    rows = np.arange(len(x))
    losses, deltas = np.zeros(3), []
    for h, p in enumerate(heads(layers[-1], classes)):
        losses[h] = -np.log(np.maximum(p[rows, labels[:, h]], 1e-15)).sum()
        p[rows, labels[:, h]] -= 1
        deltas.append(factors[h] * p)
    delta, found = np.concatenate(deltas, axis=1), []
    for i in range(len(weights) - 2, -1, -2):
        found = [layers[i // 2].T @ delta, delta.sum(axis=0), *found]
        if i:
            delta = (delta @ weights[i].T) * (layers[i // 2] > 0)
    return [*found, losses, np.array([len(x)])]


def _added(a: list, b: list) -> list:
    return [x + y for x, y in zip(a, b, strict=True)]


def _labels(model: Network):
    code = F.array_position(F.array(*[F.lit(k) for k in model.kinds]), F.col("y_type").cast("int")) - 1
    level = F.greatest(F.lit(0), F.least(F.lit(3), F.round("y_sev")))
    return F.array(F.col("y_fault").cast("long"), code.cast("long"), level.cast("long"))


def dealt(frame: DataFrame, model: Network, ids):
    """An RDD of blocks (keys, scaled inputs, labels); rows with a missing or unknown label are left out."""
    rows = frame.select(F.xxhash64(*ids).alias("key"), _values(model.columns).alias("values"), _labels(model).alias("labels"))
    rows = rows.where("labels[0] is not null and labels[1] >= 0 and labels[2] is not null")
    tasks = max(1, -(-rows.count() // TASK_ROWS))
    mean, scale, width = model.mean, model.scale, len(model.columns)

    def work(batches):
        for batch in batches:
            values = np.array(batch.column("values").to_pylist(), dtype=np.float64).reshape(-1, width)
            block = np.asarray(batch.column("key")).view(np.uint64), scaled(values, mean, scale), np.array(batch.column("labels").to_pylist()).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], ["block"])

    return rows.repartition(tasks, "key").mapInArrow(work, "block binary").rdd.map(lambda r: pickle.loads(bytes(r.block)))


def created(train: DataFrame, columns, hidden=(64, 32), rate=0.005, batch=256, seed=42, factors=LOSS_WEIGHTS) -> Network:
    """An untrained network: inputs scaled by the training rows, random weights, the heads' biases at the class shares."""
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    facts = train.agg(*[f(value(c)).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([facts[f"m{i}"] or 0.0 for i in range(len(columns))])
    scale = np.array([facts[f"s{i}"] or 1.0 for i in range(len(columns))])
    kinds = sorted(int(r[0]) for r in train.where("y_type is not null").select("y_type").distinct().collect())  # a closed list
    model = Network(list(columns), kinds, mean, scale, [])
    model.settings = {"hidden": tuple(hidden), "rate": rate, "batch": batch, "seed": seed, "factors": dict(factors)}
    random = np.random.default_rng(seed)
    sizes = [len(columns), *hidden, sum(model.classes)]
    for a, b in zip(sizes, sizes[1:], strict=False):
        model.weights += [random.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)]
    counts = train.select(F.posexplode(_labels(model)).alias("h", "c")).groupBy("h", "c").count().collect()
    first = np.cumsum([0, *model.classes])
    shares = np.full(first[-1], 0.5)  # classes without rows count as half a row
    for r in counts:
        if r.c is not None and 0 <= r.c < model.classes[r.h]:
            shares[first[r.h] + r.c] += r["count"]
    model.weights[-1] = np.concatenate([np.log(s / s.sum()) for s in np.split(shares, first[1:-1])])
    model.weights[-2] *= 0.1
    model.moments = ([np.zeros_like(w) for w in model.weights], [np.zeros_like(w) for w in model.weights])
    return model


def mean_losses(blocks, model: Network) -> np.ndarray:
    """(weighted loss, fault, type, severity): means over all rows."""
    classes, weights, factors = model.classes, model.weights, [model.settings["factors"][h] for h in HEADS]

    def work(block):
        _, x, labels = block
        found = heads(forward(x, weights)[-1], classes)
        rows = np.arange(len(x))
        return np.array([*[-np.log(np.maximum(p[rows, labels[:, h]], 1e-15)).sum() for h, p in enumerate(found)], len(x)])

    sums = blocks.map(work).treeReduce(lambda a, b: a + b)
    means = sums[:3] / max(1.0, sums[3])
    return np.array([float(np.dot(factors, means)), *means])


def epochs(model: Network, blocks, n_rows: int, count: int):
    """Trains on, epoch by epoch; yields the model after each. A step takes one slice of this epoch's hash order."""
    given = model.settings
    slices = max(1, round(n_rows / given["batch"]))
    factors, classes = [given["factors"][h] for h in HEADS], model.classes
    for _ in range(count):
        salt = _mixed(np.array([given["seed"] * 1_000_003 + model.epoch + 1], dtype=np.uint64))
        for turn in range(slices):
            weights = model.weights

            def work(block, weights=weights, salt=salt, turn=turn):
                keys, x, labels = block
                mine = (_mixed(keys ^ salt) >> np.uint64(11)).astype(np.float64) * (slices / 2.0**53)
                mine = mine.astype(np.int64) == turn
                return gradient(x[mine], labels[mine], weights, classes, factors)

            *sums, _, n = blocks.map(work).treeReduce(_added)
            model.steps += 1
            if not n[0]:
                continue
            first, second, stepped = [], [], []
            for w, g, a, b in zip(model.weights, sums, *model.moments, strict=True):
                g = g / n[0]
                first.append(FIRST * a + (1 - FIRST) * g)
                second.append(SECOND * b + (1 - SECOND) * g * g)
                step = (first[-1] / (1 - FIRST**model.steps)) / (np.sqrt(second[-1] / (1 - SECOND**model.steps)) + SMALL)
                stepped.append(w - given["rate"] * step)
            model.weights, model.moments = stepped, (first, second)
        model.epoch += 1
        yield model


HISTORY = "run string, epoch int, train_loss double, val_loss double"


def train_on(run: str, model: Network, train: DataFrame, validation: DataFrame, folder: str, count: int, patience: int | None = None,
             ids=("flight_id", "w")) -> DataFrame:
    """Trains `count` more epochs and stores weights and losses of each; the history (run, epoch, train_loss, val_loss).

    Epoch 0 is the untrained network. The run stops early when the validation loss has not improved for `patience` epochs.
    `folder` holds the run: `weights` with the state after each epoch, `history`. A run goes on from Network.load.
    """
    spark = train.sparkSession
    inside, outside = (dealt(f, model, ids).persist(StorageLevel.MEMORY_AND_DISK) for f in (train, validation))
    try:
        n_rows = int(inside.map(lambda b: len(b[0])).sum())
        best, since, history = float("inf"), 0, []

        def kept(now: Network) -> float:
            now.save(spark, f"{folder}/weights")
            history.append((run, now.epoch, float(mean_losses(inside, now)[0]), float(mean_losses(outside, now)[0])))
            return history[-1][3]

        if model.epoch == 0:
            best = kept(model)
        for now in epochs(model, inside, n_rows, count):
            loss = kept(now)
            since = 0 if loss < best else since + 1
            best = min(best, loss)
            if patience is not None and since >= patience:
                break
        spark.createDataFrame(history, HISTORY).write.mode("append").parquet(f"{folder}/history")
    finally:
        inside.unpersist()
        outside.unpersist()
    return spark.read.schema(HISTORY).parquet(f"{folder}/history")


def restored(spark: SparkSession, folder: str) -> Network:
    """The weights of a run's epoch of least validation loss, the earliest of equal ones."""
    best = spark.read.schema(HISTORY).parquet(f"{folder}/history").orderBy("val_loss", "epoch").first()
    return Network.load(spark, f"{folder}/weights", best.epoch)


def halved(train: DataFrame, validation: DataFrame, columns, settings: dict[str, dict], folder: str, first=4, seed=42,
           patience: int | None = None, ids=("flight_id", "w")) -> DataFrame:
    """Successive halving: every setting trains `first` epochs, the better half twice as many more, until one is left.

    `settings` maps a run's name to arguments of `created`. Runs go on from their stored state. The history of all runs.
    """
    spark = train.sparkSession
    alive, count, logs = sorted(settings), first, {}
    while alive:
        for run in alive:
            place = f"{folder}/{run}"
            model = Network.load(spark, f"{place}/weights") if run in logs else created(train, columns, seed=seed, **settings[run])
            logs[run] = train_on(run, model, train, validation, place, count, patience, ids)
        if len(alive) == 1:
            break
        ranked = sorted(alive, key=lambda run: (logs[run].agg(F.min("val_loss")).first()[0], run))
        alive, count = sorted(ranked[: -(-len(ranked) // 2)]), 2 * count
    whole = None
    for run in sorted(logs):
        whole = logs[run] if whole is None else whole.unionByName(logs[run])
    return whole
