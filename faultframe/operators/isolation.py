"""Isolation forest: one task per tree over a bounded sample, scoring by a broadcast forest.

Scores follow Liu, Ting and Zhou (2008): 2 ** (-E[path length] / c(sample size)), higher is more anomalous.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..functions.labels import hash_key
from ..settings import ISOLATION_TREES
from .quantiles import exact_percentiles

SAMPLE = 256
# Rows that reach a tree before its sample is taken from them, as a multiple of the sample.
MARGIN = 2
NODES = "tree int, node int, feature int, threshold double, left int, right int, path double, sample int"


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3)
    exact = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, exact, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    """Split rows at random until isolated; yields one tuple per node, the root first."""
    nodes, open_nodes = [], [(0, np.arange(len(x)), 0)]
    made = 1
    while open_nodes:
        node, rows, depth = open_nodes.pop()
        spread = np.flatnonzero(np.ptp(x[rows], axis=0) > 0) if len(rows) > 1 and depth < max_depth else []
        if len(spread) == 0:
            nodes.append((node, -1, 0.0, node, node, depth + float(average_path(len(rows)))))
            continue
        feature = int(rng.choice(spread))
        column = x[rows, feature]
        threshold = float(rng.uniform(column.min(), column.max()))
        left, right = made, made + 1
        made += 2
        nodes.append((node, feature, threshold, left, right, 0.0))
        open_nodes.append((left, rows[column <= threshold], depth + 1))
        open_nodes.append((right, rows[column > threshold], depth + 1))
    return nodes


def fit(rows: DataFrame, ids, trees=ISOLATION_TREES, sample=SAMPLE, seed=42) -> DataFrame:
    """Forest node table from `rows` (ids, vec), usually the healthy windows.

    Each tree samples the whole table: every row draws some trees by hash, so that about MARGIN * sample rows reach
    each of them, and those of lowest hash are its sample.
    """
    n = rows.count()
    share = trees * MARGIN * sample / max(1, n)
    every = F.sequence(F.lit(0), F.lit(trees - 1))
    if n > MARGIN * sample:
        unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *ids), 11) / float(1 << 53)
        draws = F.floor(F.lit(share) + unit).cast("int")
        tree = lambda j: F.pmod(F.xxhash64(F.lit(seed), j, *ids), F.lit(trees)).cast("int")
        every = F.when(draws > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), draws), tree)))
    # As many rows as trees * MARGIN * sample carry their vector, whatever the table; rows that share an id stay apart.
    drawn = rows.select(*ids, "vec", F.explode(every).alias("tree"))
    order = W.partitionBy("tree").orderBy(hash_key(seed, "tree", *ids), *ids, "vec")
    drawn = drawn.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample)

    def grow(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(frame.sort_values("r")["vec"].to_list())
        depth = int(np.ceil(np.log2(max(len(x), 2))))
        nodes = _grow(x, np.random.default_rng([seed, int(key[0])]), depth)
        out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "path"])
        return out.assign(tree=int(key[0]), sample=len(x))[[c.split()[0] for c in NODES.split(", ")]]

    return drawn.select("tree", "r", "vec").groupBy("tree").applyInPandas(grow, NODES)


def score(forest: DataFrame, rows: DataFrame, vec="vec") -> DataFrame:
    """Adds `score`. The forest has at most trees * 2 * sample nodes, so every task gets a copy."""
    nodes = forest.orderBy("tree", "node").toPandas()
    start = nodes.groupby("tree", sort=True)["node"].transform("size").groupby(nodes["tree"]).first().cumsum().shift(1)
    start = start.fillna(0).astype(int)
    base = nodes["tree"].map(start).to_numpy()
    arrays = {
        "feature": nodes["feature"].to_numpy(),
        "threshold": nodes["threshold"].to_numpy(),
        "left": nodes["left"].to_numpy() + base,
        "right": nodes["right"].to_numpy() + base,
        "path": nodes["path"].to_numpy(),
        "roots": start.to_numpy(),
    }
    scale = float(average_path(nodes["sample"].max()))
    shared = rows.sparkSession.sparkContext.broadcast(arrays)

    @F.pandas_udf(T.DoubleType())
    def anomaly(vectors: pd.Series) -> pd.Series:
        forest_arrays = shared.value
        x = np.stack(vectors.to_list())
        at = np.tile(forest_arrays["roots"], (len(x), 1))
        while True:
            feature = forest_arrays["feature"][at]
            if (feature < 0).all():
                break
            value = np.take_along_axis(x, np.maximum(feature, 0), axis=1)
            below = value <= forest_arrays["threshold"][at]
            at = np.where(feature < 0, at, np.where(below, forest_arrays["left"][at], forest_arrays["right"][at]))
        return pd.Series(2.0 ** (-forest_arrays["path"][at].mean(axis=1) / scale))

    return rows.withColumn("score", anomaly(vec))


def healthy_threshold(scored: DataFrame, share=0.95) -> DataFrame:
    """One row `threshold`: the exact percentile of the scores of healthy rows."""
    healthy = scored.where(F.col("y_fault") == 0)
    return exact_percentiles(healthy, [], "score", [share]).select(F.col("x").alias("threshold"))


def flag_anomalies(scored: DataFrame, share=0.95) -> DataFrame:
    """Adds `threshold` and `flag`: 1 where the score reaches the healthy percentile."""
    tagged = scored.withColumn("threshold", healthy_threshold(scored, share).agg(F.max("threshold")).scalar())
    return tagged.withColumn("flag", (F.col("score") >= F.col("threshold")).cast("int"))
