"""Exact nearest neighbours and majority vote.

Training vectors are grouped into cells around a few pivot vectors. A query visits only the cells that the
triangle inequality cannot rule out, so the neighbours are exact. Cells of any size are cut into blocks; a task
holds one training block and one slice of the queries, and emits k candidates per query, never all pairs.
"""

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.labels import decode_combined
from ..session import durable
from ..settings import KNN_K
from .joins import attach
from .scaling import vector_stats, zscore_vectors
from .splits import subsample

PIVOTS = 32
TRAIN_BLOCK = 20_000
QUERY_SLICE = 5_000
# Queries whose distances to a block are a matrix at a time.
QUERY_ROWS = 128
# Distances are compared at this precision, so that copies of a vector tie exactly.
DECIMALS = 9


@dataclass
class KnnModel:
    """`train` (id, vec, code, cell) holds scaled vectors; the cell arrays have one entry per pivot."""

    train: DataFrame
    stats: DataFrame
    pivots: np.ndarray
    counts: np.ndarray
    radius: np.ndarray
    k: int = KNN_K


def _matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in vectors])


def _to_pivots(vectors: pd.Series, pivots: np.ndarray) -> np.ndarray:
    x = _matrix(vectors)
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def fit(train: DataFrame, k=KNN_K, poison_nan=False, pivots=PIVOTS) -> KnnModel:
    """`train` has (id, vec, code). Statistics and pivots are small; the training rows stay distributed."""
    stats = vector_stats(train)
    scaled = zscore_vectors(train.select("id", "vec", "code"), stats, poison_nan=poison_nan)
    centres = _matrix([r.vec for r in subsample(scaled, ["id"], pivots).select("vec").collect()])

    @F.pandas_udf("cell int, reach double")
    def locate(vectors: pd.Series) -> pd.DataFrame:
        far = _to_pivots(vectors, centres)
        cell = far.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype("int32"), "reach": far[np.arange(len(far)), cell]})

    located = scaled.withColumn("at", locate("vec")).select("id", "vec", "code", "at.cell", "at.reach")
    counts, radius = np.zeros(len(centres), dtype=int), np.zeros(len(centres))
    for row in located.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("r")).collect():
        counts[row.cell], radius[row.cell] = row.n, row.r
    return KnnModel(located.drop("reach"), stats, centres, counts, radius, k)


def neighbours(model: KnnModel, queries: DataFrame, train_block=TRAIN_BLOCK, query_slice=QUERY_SLICE) -> DataFrame:
    """(qid, rank, id, code, distance) of the k nearest training rows of each query (qid, vec)."""
    k = int(min(model.k, model.counts.sum()))
    pivots, counts, radius = model.pivots, model.counts, model.radius

    @F.pandas_udf("home int, cells array<int>")
    def cells_to_visit(vectors: pd.Series) -> pd.DataFrame:
        near = _to_pivots(vectors, pivots)
        # The closest cells holding k rows in all bound the distance of the k-th neighbour.
        within = np.where(counts > 0, near + radius, np.inf)
        order = within.argsort(axis=1)
        held = counts[order].cumsum(axis=1)
        limit = np.take_along_axis(within, order, axis=1)[np.arange(len(near)), (held >= k).argmax(axis=1)]
        visit = (near - radius <= limit[:, None] + 1e-6) & (counts > 0)
        return pd.DataFrame({"home": near.argmin(axis=1).astype("int32"), "cells": [np.flatnonzero(v).astype("int32") for v in visit]})

    # Queries of one slice have their home in one cell, so a cell travels only to the slices of cells near it.
    located = durable(zscore_vectors(queries.select("qid", "vec"), model.stats).withColumn("at", cells_to_visit("vec")))
    located = located.select("qid", "vec", "at.home", "at.cells")
    parts = [1] * len(pivots)
    for row in located.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each pivot at most
        parts[row.home] = -(-row.n // query_slice)
    first = F.array(*[F.lit(int(v)) for v in np.cumsum([0, *parts[:-1]])])
    n_parts = F.get(F.array(*[F.lit(int(v)) for v in parts]), F.col("home"))
    blocks = F.array(*[F.lit(int(max(1, -(-c // train_block)))) for c in counts])
    n_blocks = F.get(blocks, F.col("cell"))
    asked = located.withColumn("slice", (F.get(first, F.col("home")) + F.pmod(F.xxhash64("qid"), n_parts)).cast("int"))
    asked = asked.select("qid", "vec", "slice", F.explode("cells").alias("cell"))
    wanted = asked.groupBy("cell").agg(F.collect_set("slice").alias("slices"))  # a row for each cell
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    held = attach(model.train, wanted, "cell", bound=len(pivots))
    held = held.withColumn("block", F.pmod(F.xxhash64("id"), n_blocks).cast("int")).withColumn("slice", F.explode("slices")).drop("slices")

    def nearest(train: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(train) and len(wanted):
            known, ids, codes = _matrix(train["vec"]), train["id"].to_numpy(), train["code"].to_numpy()
            sizes, all_asked = (known * known).sum(axis=1), _matrix(wanted["vec"])
            qids = wanted["qid"].to_numpy()
            for at in range(0, len(all_asked), QUERY_ROWS):
                asked = all_asked[at : at + QUERY_ROWS]
                own = (asked * asked).sum(axis=1)[:, None]
                square = own + sizes - 2 * (asked @ known.T)
                # The product only chooses whom to look at, with room for its rounding; distances are taken anew.
                last = np.partition(square, min(k, len(known)) - 1, axis=1)[:, [min(k, len(known)) - 1]]
                row, col = np.nonzero(square <= last + 1e-9 * (1 + own + sizes.max()))
                far = np.sqrt(((known[col] - asked[row]) ** 2).sum(axis=1)).round(DECIMALS)
                order = np.lexsort((ids[col], far, row))
                row, col, far = row[order], col[order], far[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                best = rank < k
                parts.append(pd.DataFrame({"qid": qids[at + row[best]], "id": ids[col[best]], "code": codes[col[best]], "distance": far[best]}))
        return pd.concat(parts) if parts else pd.DataFrame(columns=["qid", "id", "code", "distance"])

    keys = ["cell", "block", "slice"]
    types = {f.name: f.dataType.simpleString() for f in [*located.schema, *model.train.schema]}
    schema = f"qid {types['qid']}, id {types['id']}, code {types['code']}, distance double"
    found = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(nearest, schema)
    rank = F.row_number().over(W.partitionBy("qid").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "rank", "id", "code", "distance")


def majority_vote(found: DataFrame) -> DataFrame:
    """(qid, code, votes): the most frequent code, the lowest one on ties."""
    votes = found.groupBy("qid", "code").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), "code")).alias("b")
    return votes.groupBy("qid").agg(best).select("qid", "b.code", (-F.col("b.m")).alias("votes"))


def predict(model: KnnModel, queries: DataFrame) -> DataFrame:
    """(qid, code, fault, type, sev)."""
    voted = majority_vote(neighbours(model, queries))
    return voted.select("qid", "code", *[c.alias(n) for n, c in decode_combined(F.col("code")).items()])


def save(model: KnnModel, path: str, feature_columns=()) -> None:
    """Parquet tables plus one JSON row for what is small."""
    spark = model.train.sparkSession
    model.train.write.mode("overwrite").parquet(f"{path}/train")
    model.stats.write.mode("overwrite").parquet(f"{path}/stats")
    meta = {
        "k": model.k,
        "pivots": model.pivots.tolist(),
        "counts": model.counts.tolist(),
        "radius": model.radius.tolist(),
        "feature_columns": list(feature_columns),
    }
    spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> tuple[KnnModel, list[str]]:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    arrays = [np.asarray(meta[name]) for name in ("pivots", "counts", "radius")]
    model = KnnModel(spark.read.parquet(f"{path}/train"), spark.read.parquet(f"{path}/stats"), *arrays, meta["k"])
    return model, meta["feature_columns"]
