"""Boosted trees for the three heads, grown together on histograms of binned columns.

Columns are cut once at their quantiles, so that a value is one byte. All outputs (fault, one for each type, severity)
grow their trees in the same pass: at each level every partition adds up gradient and curvature by (node, column, bin), the
sums of a group of columns meet in one task, and that task names the best split of each node. Only the smaller of two
siblings is summed up; the other is what is left of their parent. The driver sees one row for each open node.

Rows never move after they are dealt out. A partition holds its rows as arrays with their current scores; scores are
cached from round to round and checkpointed every CHECKPOINT rounds, so a lost executor costs at most that many rounds. RDDs
hold them because a round is many short jobs over the same blocks, which DataFrames would plan anew each time. Where all rows
are in one task there is nothing to meet, and the same steps run there, CHECKPOINT rounds a job.
"""

import pickle
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf

from ..session import shared_folder
from ..settings import BOOST_COLUMNS, BOOST_DEPTH, BOOST_RATE, BOOST_ROWS, BOOST_TREES

BINS = 256
# Rows of a task, columns whose histograms meet in one task (eight times as many where all rows are in one), rounds between
# two checkpoints.
TASK_ROWS, TASK_COLUMNS, CHECKPOINT = 50_000, 8, 20
# Accuracy of the quantiles that cut the columns (relative rank error 1 / ACCURACY).
ACCURACY = 10_000
LEAST_GAIN = 1e-6
# Rows whose paths through all trees are followed at a time.
WALK_ROWS = 256


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn(keys: np.ndarray, seed: int, turn: int, share: float) -> np.ndarray:
    """Which rows take part in a round, by a hash of row, seed and round."""
    salt = _mixed(np.array([seed * 1_000_003 + turn + 1], dtype=np.uint64))
    return _mixed(keys ^ salt).astype(np.float64) < share * 2.0**64


def softmax(scores: np.ndarray) -> np.ndarray:
    powers = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return powers / powers.sum(axis=-1, keepdims=True)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def gradients(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature (n, outputs) of log loss (fault), softmax loss (types) and squared loss (severity).

    `labels` has the fault, the index of the type, the severity. The curvature of the softmax is 2p(1 - p), a bound on
    what a step in several classes at once meets.
    """
    fault, kinds = sigmoid(scores[:, 0]), softmax(scores[:, 1:-1])
    target = np.arange(kinds.shape[1]) == labels[:, 1:2]
    slope = [fault - labels[:, 0], *(kinds - target).T, scores[:, -1] - labels[:, 2]]
    curve = [fault * (1 - fault), *(2 * kinds * (1 - kinds)).T, np.ones(len(scores))]
    return np.stack(slope, axis=1), np.maximum(np.stack(curve, axis=1), 1e-16)


def losses(scores: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """(..., 3): log loss of the fault, log loss of the type, squared error of the severity of each row."""
    fault = np.logaddexp(0, scores[..., 0]) - labels[..., 0] * scores[..., 0]
    kinds = scores[..., 1:-1]
    top = kinds.max(axis=-1)
    own = np.take_along_axis(kinds, np.broadcast_to(labels[..., 1:2].astype(np.int64), (*kinds.shape[:-1], 1)), axis=-1)[..., 0]
    kind = top + np.log(np.exp(kinds - top[..., None]).sum(axis=-1)) - own
    return np.stack([fault, kind, (scores[..., -1] - labels[..., 2]) ** 2], axis=-1)


@dataclass
class Cells:
    """Histograms as cells that are not empty: sorted indices (slot, column, bin), and sums of slope, curvature and rows."""

    index: np.ndarray
    sums: np.ndarray

    @staticmethod
    def added(index: np.ndarray, sums: np.ndarray) -> "Cells":
        """Cells of an index with repetitions; those whose rows cancel out are gone."""
        if len(index):
            order = np.argsort(index, kind="stable")
            index, sums = index[order], sums[order]
            heads = np.flatnonzero(np.append(True, index[1:] != index[:-1]))
            index, sums = index[heads], np.add.reduceat(sums, heads, axis=0)
        some = sums[:, 2] > 0.5
        return Cells(index[some], sums[some])

    def of_slots(self, slots: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Index and sums of the cells of some slots, under the numbers 0, 1, ... of their order in `slots`."""
        first = np.searchsorted(self.index, slots * width)
        size = np.searchsorted(self.index, (slots + 1) * width) - first
        at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        owner = np.repeat(np.arange(len(slots)), size)
        return self.index[at] - (slots[owner] - owner) * width, self.sums[at]


def histograms(bins: np.ndarray, slope: np.ndarray, curve: np.ndarray, slots: np.ndarray, n: int) -> Cells:
    """Sums by slot, column and bin; `slots` (rows, outputs) names each row's slot below n or is -1."""
    rows, outputs = np.nonzero(slots >= 0)
    m = bins.shape[1]
    if n * BINS <= 4 * len(rows):  # column by column, since few cells are empty
        first, weights = slots[rows, outputs] * BINS, [v[rows, outputs] for v in (slope, curve)]
        dense = np.empty((n, m, BINS, 3))
        for j in range(m):
            index = first + bins[rows, j]
            for i, v in enumerate([*weights, None]):
                dense[:, j, :, i] = np.bincount(index, v, n * BINS).reshape(n, BINS)
        sums = dense.reshape(-1, 3)
        cells = np.flatnonzero(sums[:, 2] > 0)
        return Cells(cells, sums[cells])
    index = ((slots[rows, outputs][:, None] * m + np.arange(m)) * BINS + bins[rows]).ravel()
    cells, which = np.unique(index, return_inverse=True)
    values = [np.repeat(v[rows, outputs], m) for v in (slope, curve)]
    sums = np.stack([*[np.bincount(which, v, len(cells)) for v in values], np.bincount(which, minlength=len(cells))], axis=-1)
    some = sums[:, 2] > 0
    return Cells(cells[some], sums[some])


def best_splits(cells: Cells, allowed: np.ndarray, penalty: float, least: float) -> list[tuple]:
    """For each slot (gain, column, bin, slope and curvature on the left, of the whole); the first of equal gains.

    `allowed` (slots, columns) says which columns a slot may use. Rows up to the bin go left. Both sides need a row and a
    curvature of `least`; without such a split the gain is 0.
    """
    n, m = allowed.shape
    segment = cells.index // BINS  # (slot, column)
    heads = np.flatnonzero(np.append(True, segment[1:] != segment[:-1])) if len(segment) else np.empty(0, np.int64)
    sizes = np.diff(np.append(heads, len(segment)))
    running = np.cumsum(cells.sums, axis=0)
    left = running - np.repeat((running - cells.sums)[heads], sizes, axis=0)
    whole = np.repeat(np.add.reduceat(cells.sums, heads, axis=0), sizes, axis=0) if len(heads) else left
    right = whole - left
    score = lambda s: s[:, 0] ** 2 / (s[:, 1] + penalty)
    slot, column = segment // m, segment % m
    open_ = (left[:, 1] >= least) & (right[:, 1] >= least) & (right[:, 2] > 0.5) & allowed[slot, column]
    gain = np.where(open_, (score(left) + score(right) - score(whole)) / 2, 0.0)
    out = [(0.0, 0, 0, 0.0, 0.0, 0.0, 0.0)] * n
    starts = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else []
    for a, b in zip(starts, [*starts[1:], len(slot)], strict=True):
        i = a + int(gain[a:b].argmax())
        out[slot[i]] = (float(gain[i]), int(column[i]), int(cells.index[i] % BINS), *left[i, :2].tolist(), *whole[i, :2].tolist())
    return out


@dataclass
class Tree:
    """A tree as a heap: the children of node i are 2i + 1 and 2i + 2; `column` is -1 in a leaf."""

    column: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(depth: int) -> "Tree":
        n = (1 << (depth + 1)) - 1
        return Tree(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n))

    def places(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node in which each row is after `levels` steps."""
        place, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(levels):
            column = self.column[place]
            right = bins[rows, column] > self.cut[place]
            place = np.where(column >= 0, 2 * place + 1 + right, place)
        return place


@dataclass
class BoostedTrees:
    """A fitted model: inputs, type codes, starting scores, and a tree for each (round, output) as heaps."""

    columns: list[str]
    kinds: list[int]
    base: list[float]
    depth: int
    settings: dict = field(default_factory=dict)
    cuts: list[list[float]] = field(default_factory=list)
    trees: list[list[Tree]] = field(default_factory=list)

    def arrays(self, rounds: slice = slice(None)) -> tuple:
        """Column, threshold and value of all nodes (rounds, outputs, nodes), for walking."""
        chosen = self.trees[rounds]
        n = (1 << (self.depth + 1)) - 1
        shape = (len(chosen), len(self.base), n)
        column = np.array([t.column for r in chosen for t in r], np.int16).reshape(shape)
        value = np.array([t.value for r in chosen for t in r]).reshape(shape)
        limits = [np.array([*c, np.inf]) for c in self.cuts]
        bound = np.full(shape, np.inf)
        for r, k, i in zip(*np.nonzero(column >= 0), strict=True):
            c = limits[column[r, k, i]]
            bound[r, k, i] = c[min(chosen[r][k].cut[i], len(c) - 1)]
        return column, bound, value

    def raw(self, frame: DataFrame, name="scores") -> DataFrame:
        """`frame` with the scores of all outputs as an array."""
        return frame.withColumn(name, _scorer(frame.sparkSession, self)(_values(self.columns)))

    def transform(self, frame: DataFrame) -> DataFrame:
        """`frame` with prob_fault, prob_type (arrays), p_type (the likeliest code, the lowest of equal ones) and p_sev."""
        count = len(self.kinds)
        found = self.raw(frame, "__scores")
        shifted = F.transform(F.slice("__scores", 2, count), lambda s: F.exp(s - F.array_max(F.slice("__scores", 2, count))))
        found = found.withColumn("__powers", shifted)
        total = F.aggregate("__powers", F.lit(0.0), lambda a, x: a + x)
        fault = 1 / (1 + F.exp(-F.get("__scores", F.lit(0))))
        likeliest = F.array_position("__powers", F.array_max("__powers")).cast("int")
        return found.withColumns(
            {
                "prob_fault": F.array(1 - fault, fault),
                "prob_type": F.transform("__powers", lambda p: p / total),
                "p_type": F.element_at(F.array(*[F.lit(k) for k in self.kinds]), likeliest),
                "p_sev": F.get("__scores", F.lit(count + 1)),
            }
        ).drop("__scores", "__powers")

    def save(self, spark: SparkSession, path: str) -> None:
        """Two tables: one row about the model, one for each node."""
        nodes = [
            pa.table({"round": np.full(len(at), r), "output": np.full(len(at), k), "node": at, "column": t.column[at], "cut": t.cut[at], "value": t.value[at]})
            for r, trees in enumerate(self.trees) for k, t in enumerate(trees)
            for at in [np.flatnonzero((t.column >= 0) | (t.value != 0))]
        ]
        kind = "round long, output long, node long, column int, cut int, value double"
        spark.createDataFrame(pa.concat_tables(nodes).to_pandas(), kind).write.mode("overwrite").parquet(f"{path}/nodes")
        about = (self.columns, self.kinds, self.base, self.depth, len(self.trees), repr(self.settings), self.cuts)
        kind = "columns array<string>, kinds array<int>, base array<double>, depth int, rounds int, settings string, cuts array<array<double>>"
        spark.createDataFrame([about], kind).write.mode("overwrite").parquet(f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "BoostedTrees":
        import ast

        about = spark.read.parquet(f"{path}/model").first()
        made = BoostedTrees(about.columns, about.kinds, about.base, about.depth, ast.literal_eval(about.settings), about.cuts)
        made.trees = [[Tree.empty(about.depth) for _ in about.base] for _ in range(about.rounds)]
        nodes = spark.read.parquet(f"{path}/nodes").toPandas()  # bounded by rounds, outputs and depth
        for (r, k), part in nodes.groupby(["round", "output"]):
            tree, at = made.trees[r][k], part["node"].to_numpy()
            tree.column[at], tree.cut[at], tree.value[at] = part["column"], part["cut"], part["value"]
        return made


def _values(columns) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def walked(values: np.ndarray, arrays: tuple, depth: int) -> np.ndarray:
    """(rows, rounds, outputs): the value that each tree gives to each row. NaN goes left, as it is binned lowest."""
    column, bound, value = arrays
    n = column.shape[-1]
    first = np.arange(column.shape[0] * column.shape[1]) * n
    column, bound, value = column.ravel(), bound.ravel(), value.ravel()
    place = np.zeros((len(values), len(first)), np.int64)
    rows = np.arange(len(values))[:, None] * values.shape[1]
    for _ in range(depth):
        at = first + place
        c = column.take(at)
        right = values.take(rows + c) > bound.take(at)  # in a leaf c is -1 and what it reads is not used
        place = np.where(c >= 0, 2 * place + 1 + right, place)
    return value.take(first + place).reshape(len(values), *arrays[0].shape[:2])


def _scorer(spark: SparkSession, model: BoostedTrees):
    shared = spark.sparkContext.broadcast((model.arrays(), np.array(model.base), model.depth))

    @pandas_udf("array<double>")
    def scores(values: pd.Series) -> pd.Series:
        arrays, base, depth = shared.value
        out = []
        for first in range(0, len(values), WALK_ROWS):
            rows = np.array(values.iloc[first : first + WALK_ROWS].to_list(), dtype=np.float64).reshape(-1, len(model.columns))
            out += list(base + walked(rows, arrays, depth).sum(axis=1))
        return pd.Series(out, dtype=object)

    return scores


def quantile_cuts(train: DataFrame, columns) -> list[list[float]]:
    """For each column up to BINS - 1 increasing cuts; a value's bin is the number of cuts below it."""
    shares = [i / (BINS - 1) for i in range(BINS - 1)]
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    found = train.agg(*[F.percentile_approx(value(c), shares, ACCURACY).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return [sorted(set(found[i] or [])) for i in range(len(columns))]


def binned(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    out = np.empty(values.shape, np.uint8)
    for j, c in enumerate(cuts):
        v = values[:, j]
        out[:, j] = np.where(np.isnan(v), 0, np.searchsorted(c, np.where(np.isnan(v), 0, v), "left"))
    return out


def dealt(train: DataFrame, model: BoostedTrees, key: Column):
    """An RDD of blocks (keys, bins, labels, scores), one of about TASK_ROWS rows a partition; more where keys repeat.

    Histograms of many small blocks would be mostly empty cells that have to be sorted to meet.
    """
    n = train.count()
    tasks = max(1, -(-n // TASK_ROWS))
    code = F.array_position(F.array(*[F.lit(k) for k in model.kinds]), F.col("y_type").cast("int")) - 1
    labels = F.array(F.col("y_fault").cast("double"), code.cast("double"), F.col("y_sev").cast("double"))
    rows = model.raw(train, "scores") if model.trees else train.withColumn("scores", F.array(*[F.lit(float(b)) for b in model.base]))
    rows = rows.select(key.alias("key"), _values(model.columns).alias("values"), labels.alias("labels"), "scores").repartition(tasks, "key")
    cuts, columns = [np.array(c) for c in model.cuts], len(model.columns)

    def joined(parts):
        block = tuple(np.concatenate(arrays) for arrays in zip(*parts, strict=True))
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], ["block"])

    def work(batches):
        parts, n = [], 0
        for batch in batches:
            matrix = lambda name, width: np.array(batch.column(name).to_pylist(), dtype=np.float64).reshape(-1, width)
            part = (
                np.asarray(batch.column("key")).view(np.uint64), binned(matrix("values", columns), cuts), matrix("labels", 3),
                matrix("scores", len(model.base)),
            )
            parts.append(part)
            n += batch.num_rows
            if n >= 2 * TASK_ROWS:
                yield joined(parts)
                parts, n = [], 0
        if parts:
            yield joined(parts)

    return rows.mapInArrow(work, "block binary").rdd.map(lambda r: pickle.loads(bytes(r.block)))


@dataclass
class Level:
    """What is open at a level of a round: the slots to sum up, and those that are their parent less their sibling."""

    depth: int
    direct: list[tuple[int, int]]  # (output, node)
    derived: list[tuple[int, int]]
    links: np.ndarray  # for each derived slot the slot of its parent in the level above, and of its sibling here
    allowed: np.ndarray  # (slots, columns)
    trees: list[Tree]

    @property
    def slots(self) -> list[tuple[int, int]]:
        return [*self.direct, *self.derived]


def grown(model: BoostedTrees, turn: int, judge) -> list[Tree]:
    """The trees of one round; `judge` gives the best split of each slot of a level, as `best_splits`."""
    given, outputs, m = model.settings, len(model.base), len(model.columns)
    penalty, least, rate = given["penalty"], given["least"], given["rate"]
    trees = [Tree.empty(model.depth) for _ in range(outputs)]
    random = np.random.default_rng([given["seed"], turn])
    usable = np.zeros((outputs, m), dtype=bool)
    for k in range(outputs):
        usable[k, random.choice(m, max(1, round(given["columns"] * m)), replace=False)] = True
    direct, derived, links = [(k, 0) for k in range(outputs)], [], []
    for depth in range(model.depth):
        slots = [*direct, *derived]
        level = Level(depth, direct, derived, np.array(links, dtype=np.int64).reshape(-1, 2), usable[[k for k, _ in slots]], trees)
        found = judge(level)
        direct, derived, links = [], [], []
        for s, (k, node) in enumerate(slots):
            gain, column, cut, slope, curve, all_slope, all_curve = found[s]
            tree = trees[k]
            if node == 0:
                tree.value[0] = -rate * all_slope / (all_curve + penalty)
            if gain <= LEAST_GAIN:
                continue
            tree.column[node], tree.cut[node] = column, cut
            sides = [(2 * node + 1, slope, curve), (2 * node + 2, all_slope - slope, all_curve - curve)]
            for child, a, b in sides:
                tree.value[child] = -rate * a / (b + penalty)
            going = [c for c in sorted(sides, key=lambda c: c[2]) if c[2] >= 2 * least]
            if going:
                direct.append((k, going[0][0]))
                if len(going) == 2:
                    derived.append((k, going[1][0]))
                    links.append((s, len(direct) - 1))
        if not direct:
            break
    return trees


def summed(blocks, level: Level, given: dict, turn: int, width: int) -> list[Cells]:
    """The histograms of some blocks for the direct slots of a level, one for each group of `width` columns."""
    n = len(level.trees[0].column)
    slot_of = np.full((len(level.trees), n), -1, np.int64)
    for s, (k, node) in enumerate(level.direct):
        slot_of[k, node] = s
    groups = -(-level.allowed.shape[1] // width)
    found = [[] for _ in range(groups)]
    for keys, bins, labels, scores in blocks:
        inside = drawn(keys, given["seed"], turn, given["rows"])
        bins, slope, curve = bins[inside], *(v[inside] for v in gradients(scores, labels))
        slots = np.stack([slot_of[k][t.places(bins, level.depth)] for k, t in enumerate(level.trees)], axis=1)
        for g in range(groups):
            found[g].append(histograms(bins[:, g * width : (g + 1) * width], slope, curve, slots, len(level.direct)))
    return [merged(parts) for parts in found if parts]


def merged(parts: list[Cells]) -> Cells:
    if len(parts) == 1:
        return parts[0]
    return Cells.added(np.concatenate([p.index for p in parts]), np.concatenate([p.sums for p in parts]))


def judged(group: int, cells: Cells, above: Cells | None, level: Level, given: dict, width: int) -> tuple[Cells, list[tuple]]:
    """All slots' cells of a group of columns and their best splits, from those of the direct slots and of the level above."""
    usable = level.allowed[:, group * width : (group + 1) * width]
    if len(level.links):
        size = usable.shape[1] * BINS
        there, total = above.of_slots(level.links[:, 0], size)
        here, less = cells.of_slots(level.links[:, 1], size)
        total[np.searchsorted(there, here)] -= less  # a parent has all its children's cells
        some = total[:, 2] > 0.5
        rest = Cells(there[some], total[some])
        index = np.concatenate([cells.index, rest.index + len(level.direct) * size])
        cells = Cells(index, np.concatenate([cells.sums, rest.sums]))
    found = [(s[0], s[1] + group * width, *s[2:]) for s in best_splits(cells, usable, given["penalty"], given["least"])]
    return cells, found


def best_of(groups: list[list[tuple]]) -> list[tuple]:
    """The best split of each slot over groups of columns in their order, the first of equal ones."""
    return [max(found, key=lambda s: s[0]) for found in zip(*groups, strict=True)]


def scored(blocks, trees: list[Tree], depth: int) -> list[tuple]:
    return [(k, b, y, s + np.stack([t.value[t.places(b, depth)] for t in trees], axis=1)) for k, b, y, s in blocks]


def round_over_tasks(state, model: BoostedTrees, turn: int) -> list[Tree]:
    """A round over rows in many tasks: a level is a job in which the sums of each group of columns meet in a task."""
    given, width = model.settings, TASK_COLUMNS
    groups = -(-len(model.columns) // width)
    previous = []

    def judge(level: Level) -> list[tuple]:
        def meeting(parts):
            met = {}
            for g, found in parts:
                met.setdefault(g, ([], []))[isinstance(found, tuple)].append(found)
            for g, (new, above) in met.items():
                yield g, judged(g, merged(new), above[0][0] if above else None, level, given, width)

        met = state.mapPartitions(lambda blocks: enumerate(summed(blocks, level, given, turn, width))).partitionBy(groups)
        both = previous[-1].union(met) if previous else met
        sums = both.mapPartitions(meeting, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
        found = sorted(sums.map(lambda item: (item[0], item[1][1])).collect(), key=lambda x: x[0])
        previous.append(sums)
        if len(previous) > 1:
            previous.pop(0).unpersist()
        return best_of([splits for _, splits in found])

    trees = grown(model, turn, judge)
    previous.pop().unpersist()
    return trees


def rounds_in_task(blocks: list[tuple], model: BoostedTrees, turns: range) -> tuple[list[tuple], list[list[Tree]]]:
    """Rounds over rows that are all in one task, where sums need not travel to meet."""
    made, width = [], 8 * TASK_COLUMNS
    for turn in turns:
        above = []

        def judge(level: Level, above=above, turn=turn, blocks=blocks) -> list[tuple]:
            found = [
                judged(g, cells, above[g] if above else None, level, model.settings, width)
                for g, cells in enumerate(summed(blocks, level, model.settings, turn, width))
            ]
            above[:] = [cells for cells, _ in found]
            return best_of([splits for _, splits in found])

        made.append(grown(model, turn, judge))
        blocks = scored(blocks, made[-1], model.depth)
    return blocks, made


def fit(train: DataFrame, columns, ids=("flight_id", "w"), rounds=BOOST_TREES, depth=BOOST_DEPTH, rate=BOOST_RATE, rows=BOOST_ROWS,
        share=BOOST_COLUMNS, seed=42, penalty=1.0, least=1.0, start: BoostedTrees | None = None) -> BoostedTrees:
    """Boosted trees for y_fault (0 or 1), y_type (any codes) and y_sev (a number).

    Each round draws `rows` of all rows and, for each tree, `share` of the columns. `penalty` is added to the curvature of
    a leaf, `least` is the curvature that each side of a split needs. With `start`, `rounds` more rounds are added to a model;
    the same rounds come out as in one run. NULL and NaN inputs are lowest. Rows without all three labels are left out.
    """
    spark = train.sparkSession
    train = train.where("y_fault is not null and y_type is not null and y_sev is not null")
    if start is None:
        facts = train.agg(F.avg("y_fault"), F.avg("y_sev"), F.count(F.lit(1))).first()
        if not facts[2]:
            raise ValueError("no labelled rows to learn from")
        kinds = {int(r[0]): r[1] for r in train.groupBy("y_type").agg(F.count(F.lit(1))).collect()}  # types are a closed list
        odds = min(max(facts[0], 1e-6), 1 - 1e-6)
        codes = sorted(kinds)
        base = [float(np.log(odds / (1 - odds))), *[float(np.log(kinds[k] / facts[2])) for k in codes], float(facts[1])]
        settings = {"rate": rate, "rows": rows, "columns": share, "seed": seed, "penalty": penalty, "least": least}
        model = BoostedTrees(list(columns), codes, base, depth, settings, quantile_cuts(train, columns))
    else:
        model = BoostedTrees(start.columns, start.kinds, start.base, start.depth, start.settings, start.cuts, list(start.trees))
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    state = dealt(train, model, F.xxhash64(*ids)).persist(StorageLevel.MEMORY_AND_DISK)
    state.checkpoint()
    first, last, bare = len(model.trees), len(model.trees) + rounds, replace(model, trees=[])
    older = []

    def moved(new):
        older.append(state)
        new = new.persist(StorageLevel.MEMORY_AND_DISK)
        if len(model.trees) % CHECKPOINT == 0:
            new.checkpoint()
        return new

    if state.getNumPartitions() == 1:
        for turn in range(first, last, CHECKPOINT):
            turns = range(turn, min(turn + CHECKPOINT, last))
            done = state.mapPartitions(lambda blocks, turns=turns: [rounds_in_task(list(blocks), bare, turns)])
            done = done.persist(StorageLevel.MEMORY_AND_DISK)
            model.trees += [trees for part in done.map(lambda x: x[1]).collect() for trees in part]
            state = moved(done.flatMap(lambda x: x[0]))
            state.count()
            done.unpersist()
            older.pop().unpersist()
    else:
        for turn in range(first, last):
            model.trees.append(round_over_tasks(state, bare, turn))
            while older:
                older.pop().unpersist()
            if turn + 1 < last:
                state = moved(state.mapPartitions(lambda blocks, trees=model.trees[-1]: scored(blocks, trees, bare.depth)))
    state.unpersist()
    return model


def staged_losses(model: BoostedTrees, frame: DataFrame, first=0) -> DataFrame:
    """(epoch, loss_fault, loss_type, loss_sev): mean losses after each round from `first` + 1 on, in one pass over the rows.

    Rows whose type the model has not learned have no type loss and are left out.
    """
    rounds = len(model.trees)
    code = F.array_position(F.array(*[F.lit(k) for k in model.kinds]), F.col("y_type").cast("int")) - 1
    labels = F.array(F.col("y_fault").cast("double"), code.cast("double"), F.col("y_sev").cast("double"))
    rows = frame.select(_values(model.columns).alias("values"), labels.alias("labels")).where("labels[1] >= 0")
    shared = frame.sparkSession.sparkContext.broadcast((model.arrays(), np.array(model.base), model.depth))

    def work(batches):
        arrays, base, depth = shared.value
        sums, n = np.zeros((rounds, 3)), 0
        for batch in batches:
            for at in range(0, batch.num_rows, WALK_ROWS):
                part = batch.slice(at, WALK_ROWS)
                values = np.array(part.column("values").to_pylist(), dtype=np.float64).reshape(len(part), -1)
                truth = np.array(part.column("labels").to_pylist(), dtype=np.float64)
                scores = base + np.cumsum(walked(values, arrays, depth), axis=1)
                sums += losses(scores, truth[:, None, :]).sum(axis=0)
                n += len(part)
        columns = [np.arange(1, rounds + 1, dtype=np.int32), np.full(rounds, n), *sums.T]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["epoch", "n", "fault", "type", "sev"])

    parts = rows.mapInArrow(work, "epoch int, n long, fault double, type double, sev double").where(F.col("epoch") > first)
    means = [(F.sum(c) / F.sum("n")).alias(f"loss_{c}") for c in ("fault", "type", "sev")]
    return parts.groupBy("epoch").agg(*means)
