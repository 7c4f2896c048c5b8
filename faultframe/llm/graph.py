"""Connected components of an edge table."""

from pyspark.sql import DataFrame, functions as F

from .shared import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of `edges` (a, b), which has each edge in both directions; the label is the smallest
    node that can be reached.

    Labels spread to neighbours and then along the labels themselves, so a chain of n edges takes about log n rounds.
    Every round is a stored table; smallest labels are combined before the shuffle, so a hub needs no task of its own.
    Where no neighbour has a smaller label, all labels of a component are its smallest node.
    """
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        spread = stored(
            labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "labels"
        )
        if spread.where("label <> old").isEmpty():
            return spread.select("node", "label")
        jump = spread.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = spread.join(jump, "label", "left")
        labels = stored(jumped.select("node", F.coalesce(F.least("label", "further"), "label").alias("label")), "labels")
