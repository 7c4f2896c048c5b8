"""The prefix trie of conversations, with totals of all subtrees.

A node is a distinct sequence of first turns. It is named by the smallest conversation that has it, its owner, and its
depth. Prefixes are told apart by two 64-bit hashes, which are folded along a conversation in bands of turns, so that no
task holds a long conversation.

Totals of subtrees come from a centroid decomposition of the forest of parent edges. The forest is first split where the
number of members passes a power of FAN and every BAND turns. Inside such a component fewer than FAN nodes have the same
depth, as their members are different and each has at least the FAN-th part of the top's: a component holds fewer than
FAN * BAND nodes however large the trie is, and a task takes whole components. There it is split on and on at centroids;
the total below a centroid is added along the path from the centroid to its component's top. A component's total then
counts for the node that its top hangs on. Components are taken from few members to many and from deep to shallow, so a
component finds the totals of all that hang on it.
"""

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.joins import attach_counted
from ..operators.ordered import row_index
from .shared import small_batches, stored

BAND = 4096
FAN_BITS = 6
FAN = 1 << FAN_BITS
# Conversation numbers whose names one task joins, and turn numbers that it puts in order.
RUN_NAMES, RUN_TURNS = 1 << 16, 1024
# Nodes of whole components that are worked on at a time; a single component may have more.
AT_ONCE = 20_000
# Turns that a conversation may take over from the first one of its hundred.
BORROWED = 5

EDGE = ("owner", "depth")


def numbered(rows: DataFrame) -> DataFrame:
    """Stored: (conv_id, idx, n, e, f, points): turns by number, NULL first, with two hashes of role and text and the text's
    code points; ties follow the hashes. NULL role and text are empty; rows without conv_id take no part."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    narrow = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.xxhash64(role, text).alias("e"), F.xxhash64(text, F.lit(1), role).alias("f"),
        F.length(text).cast("long").alias("points"),
    )
    narrow = stored(narrow, "turns")
    run = F.coalesce(F.floor(F.col("turn") / RUN_TURNS), F.lit(-(1 << 60)))
    found = row_index(narrow, ["conv_id"], ["turn", "e", "f"], run, out="idx", total="n")
    return stored(found.select("conv_id", "idx", "n", "e", "f", "points"), "numbered-turns")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: (conv_id, depth, total, e, f, points) of `numbered` turns, and (conv_id, total).

    Conversation c takes its first h turns from conversation c - c % 100, as far as there are any, and goes on with its
    own after the first h; h is the CRC-32 of c's decimal digits modulo 6.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (BORROWED + 1)
    convs = turns.where("idx = 0").select("conv_id", "n")
    wanted = convs.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("donor"))
    # A donor serves its hundred only.
    plan = wanted.join(convs.select(F.col("conv_id").alias("donor"), F.col("n").alias("has")), "donor", "left")
    plan = plan.withColumn("taken", F.least("h", F.coalesce("has", F.lit(0))))
    plan = stored(plan.withColumn("total", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "rebuilt-plan")
    heads = turns.where(F.col("idx") < BORROWED).select(F.col("conv_id").alias("donor"), "idx", "e", "f", "points")
    taken = plan.join(heads, "donor").where("idx < taken")
    own = attach_counted(turns.where(F.col("idx") >= h).drop("n"), plan.drop("donor", "has"), "conv_id", turns.count())
    columns = ["conv_id", "depth", "total", "e", "f", "points"]
    both = taken.withColumn("depth", F.col("idx") + 1).select(*columns).unionByName(
        own.withColumn("depth", F.col("taken") + F.col("idx") - F.col("h") + 1).select(*columns)
    )
    return stored(both, "rebuilt-turns"), plan.select("conv_id", "total")


def prefixes(turns: DataFrame) -> DataFrame:
    """Stored: `turns` with (x, y), the hashes of all turns up to this one."""
    own = {"x": F.xxhash64("depth", "e", "f"), "y": F.xxhash64("f", "depth", "e")}
    rows = turns.withColumns({**{f"own_{k}": v for k, v in own.items()}, "band": F.floor((F.col("depth") - 1) / BAND)})
    inside = W.partitionBy("conv_id", "band").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({k: F.bit_xor(f"own_{k}").over(inside) for k in own})
    # Only conversations of more than one band have something to carry over.
    bands = rows.where(F.col("total") > BAND).groupBy("conv_id", "band").agg(*[F.bit_xor(f"own_{k}").alias(k) for k in own])
    earlier = W.partitionBy("conv_id").orderBy("band").rowsBetween(W.unboundedPreceding, -1)
    carried = bands.select("conv_id", "band", *[F.bit_xor(k).over(earlier).alias(f"carried_{k}") for k in own]).where("band > 0")
    later = rows.where("band > 0").join(carried, ["conv_id", "band"])
    later = later.withColumns({k: F.col(k).bitwiseXOR(F.col(f"carried_{k}")) for k in own})
    columns = ["conv_id", "depth", "total", "points", "x", "y"]
    return stored(rows.where("band = 0").select(*columns).unionByName(later.select(*columns)), "prefixes")


def level(members: Column) -> Column:
    """floor(log(members) to the base FAN)."""
    return F.floor((F.length(F.bin(members)) - 1) / FAN_BITS)


def forest_of(paths: DataFrame, root: tuple[int, int]) -> DataFrame:
    """Stored: a row for each node but the root, with its parent and the top of its component.

    `paths` has the owner and members of the node behind each turn. Along a path the top of a node's component is the last
    node that starts a component, in the same band.
    """
    owner, members = (F.lit(v).cast("long") for v in root)
    band = F.floor(F.col("depth") / BAND)
    # The last turn of a band is also seen from the next one, as the parent of its first.
    seen = paths.withColumn("band", F.explode(F.when((F.col("depth") + 1) % BAND == 0, F.array(band, band + 1)).otherwise(F.array(band))))
    path = W.partitionBy("conv_id", "band").orderBy("depth")
    rows = seen.withColumns(
        {
            "parent_owner": F.coalesce(F.lag("owner").over(path), owner),
            "level": level(F.col("members")),
            "above": level(F.coalesce(F.lag("members").over(path), members)),
        }
    ).where(band == F.col("band"))
    rows = rows.withColumn("top", (F.col("level") != F.col("above")) | (F.col("depth") % BAND == 0))
    upto = path.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("found", F.last(F.when(F.col("top"), F.struct("owner", "depth")), ignorenulls=True).over(upto))
    rows = rows.where("conv_id = owner").select(
        "owner", "depth", "parent_owner", "members", "points", "level", "band",
        F.coalesce("found.owner", owner).alias("top_owner"), F.coalesce("found.depth", F.lit(0)).cast("long").alias("top_depth"),
    )
    return stored(rows, "trie-nodes")


def weighed(nodes: DataFrame) -> DataFrame:
    """Stored: `nodes` with n_children, and what each adds to the totals: `leaves` and `saved`."""
    children = nodes.where("depth > 0").groupBy(F.col("parent_owner").alias("owner"), (F.col("depth") - 1).alias("depth"))
    rows = nodes.join(children.agg(F.count(F.lit(1)).alias("n_children")), list(EDGE), "left").na.fill(0, ["n_children"])
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("members") - 1) * F.col("points")
    return stored(rows.withColumns({"leaves": leaf, "saved": saved}), "trie-forest")


def rolled_up(parent: np.ndarray, depth: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each node of a forest the sum of `weights` (n, k) over its subtree, by centroid decomposition.

    `parent` is an index or -1. In each round every component is split at its centroid, the deepest node that has half of
    the component below it; no part has more than half of the nodes, so there are about log n rounds.
    """
    n = len(parent)
    total, up, alive = np.zeros_like(weights), parent.copy(), np.arange(n)[np.argsort(depth, kind="stable")]
    while len(alive):
        levels = np.split(alive, np.flatnonzero(np.diff(depth[alive])) + 1)
        linked = [nodes[up[nodes] >= 0] for nodes in levels]
        size, below, top = np.ones(n, dtype=np.int64), weights.copy(), np.arange(n)
        for nodes in reversed(linked):
            np.add.at(size, up[nodes], size[nodes])
            np.add.at(below, up[nodes], below[nodes])
        for nodes in linked:
            top[nodes] = top[up[nodes]]
        heavy = alive[2 * size[alive] >= size[top[alive]]]
        last = np.full(n, -1)
        np.maximum.at(last, top[heavy], np.arange(len(heavy)))  # in the order of depth
        centroids = heavy[last[last >= 0]]
        added = np.zeros_like(weights)
        added[centroids] = below[centroids]
        for nodes in reversed(linked):  # one path to the top in each component
            np.add.at(added, up[nodes], added[nodes])
        total += added
        gone = np.zeros(n + 1, dtype=bool)
        gone[centroids] = True
        up[gone[up]] = -1  # index -1 is the last entry, which is never gone
        alive = alive[~gone[alive]]
    return total


ROLLED = "owner long, depth long, parent_owner long, n_leaves long, saved_tokens long, is_top boolean"


def component_totals(nodes: DataFrame) -> DataFrame:
    """The columns ROLLED of whole components; a task holds a few of them at a time."""

    def totals(rows: pd.DataFrame) -> pa.RecordBatch:
        own = pd.MultiIndex.from_arrays([rows["owner"], rows["depth"]])
        is_top = ((rows["owner"] == rows["top_owner"]) & (rows["depth"] == rows["top_depth"])).to_numpy()
        parent = own.get_indexer(pd.MultiIndex.from_arrays([rows["parent_owner"], rows["depth"] - 1]))
        parent[is_top] = -1
        found = rolled_up(parent, rows["depth"].to_numpy(), rows[["leaves", "saved"]].to_numpy())
        columns = [rows["owner"], rows["depth"], rows["parent_owner"], found[:, 0], found[:, 1], is_top]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in ROLLED.split(", ")])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch.to_pandas())
            size += len(held[-1])
            if size >= AT_ONCE:
                rows = pd.concat(held, ignore_index=True)
                tops = rows[["top_owner", "top_depth"]].to_numpy()
                border = np.flatnonzero((tops[1:] != tops[:-1]).any(axis=1))
                if len(border):  # the last component may go on in the next batch
                    yield totals(rows.iloc[: border[-1] + 1])
                    rows = rows.iloc[border[-1] + 1 :]
                held, size = [rows], 0 if len(border) else size
        rows = pd.concat(held, ignore_index=True) if held else []
        if len(rows):
            yield totals(rows)

    key = ["top_owner", "top_depth"]
    rows = nodes.select("owner", "depth", F.coalesce("parent_owner", F.lit(0)).alias("parent_owner"), *key, "leaves", "saved")
    return rows.repartition(*key).sortWithinPartitions(*key, "depth").mapInArrow(work, ROLLED)


def rollup(forest: DataFrame) -> DataFrame:
    """(owner, depth, n_leaves, saved_tokens) for every node: its own weights and those of all below it.

    A wave takes all components of one level and band. There are about log(members) levels, and one band for BAND turns.
    """
    waves = sorted((r.level, -r.band) for r in forest.select("level", "band").distinct().collect())
    found, hanging = [], None
    for at, band in waves:
        nodes = forest.where((F.col("level") == at) & (F.col("band") == -band))
        if hanging is not None:
            more = hanging.groupBy(*EDGE).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
            nodes = nodes.join(more, list(EDGE), "left").na.fill(0, ["more_leaves", "more_saved"])
            nodes = nodes.withColumns({"leaves": F.col("leaves") + F.col("more_leaves"), "saved": F.col("saved") + F.col("more_saved")})
        found.append(stored(component_totals(nodes), "component-totals"))
        tops = found[-1].where("is_top and depth > 0")
        tops = tops.select(F.col("parent_owner").alias("owner"), (F.col("depth") - 1).alias("depth"), "n_leaves", "saved_tokens")
        hanging = tops if hanging is None else hanging.unionByName(tops)
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole.select(*EDGE, "n_leaves", "saved_tokens")


def ends(paths: DataFrame, turnless: DataFrame) -> DataFrame:
    """(owner, depth, ends_sha256): the SHA-256 of the conversations that end in a node, as sorted decimals.

    Names are joined in runs of RUN_NAMES numbers; the digest of a node reads its runs as a stream.
    """
    last = paths.where("depth = total").select(*EDGE, "conv_id").unionByName(turnless)
    runs = last.groupBy(*EDGE, F.floor(F.col("conv_id") / RUN_NAMES).alias("run")).agg(F.array_sort(F.collect_list("conv_id")).alias("names"))
    runs = runs.withColumn("names", F.array_join(F.col("names").cast("array<string>"), ","))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            out = []
            for owner, depth, names in zip(*[batch.column(c).to_pylist() for c in (*EDGE, "names")], strict=True):
                if (owner, depth) == key:
                    sha.update(b"," + names.encode())
                    continue
                if key is not None:
                    out.append((*key, sha.hexdigest()))
                key, sha = (owner, depth), hashlib.sha256(names.encode())
            yield digests(out)
        if key is not None:
            yield digests([(*key, sha.hexdigest())])

    def digests(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*EDGE, "ends_sha256"])

    dealt = runs.repartition(*EDGE).sortWithinPartitions(*EDGE, "run")
    return dealt.mapInArrow(work, "owner long, depth long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for each node.

    `turns` (conv_id, depth from 1, total, e, f, points) has each turn once, `convs` (conv_id, total) every conversation,
    those without turns too. The root is of depth 0 and without text. Without conversations there are no nodes.
    """
    spark = turns.sparkSession
    small_batches(spark)
    root = convs.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    root = (root[0] or 0, root[1])
    rows = prefixes(turns)
    key = ["depth", "x", "y"]
    nodes = rows.groupBy(*key).agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("members"))
    paths = stored(attach_counted(rows, stored(nodes, "prefix-nodes"), key, rows.count(), count="members").drop("x", "y"), "paths")
    top = convs.groupBy().agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("members")).where("members > 0")
    zero = F.lit(0).cast("long")
    top = top.select(
        "owner", zero.alias("depth"), F.lit(None).cast("long").alias("parent_owner"), "members", zero.alias("points"),
        level(F.col("members")).alias("level"), zero.alias("band"), F.col("owner").alias("top_owner"), zero.alias("top_depth"),
    )
    forest = weighed(forest_of(paths, root).unionByName(top))
    if forest.isEmpty():
        totals = forest.select(*EDGE, F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    else:
        totals = rollup(forest)
    turnless = convs.where("total = 0").select(F.lit(root[0]).cast("long").alias("owner"), zero.alias("depth"), "conv_id")
    found = forest.join(totals, list(EDGE)).join(ends(paths, turnless), list(EDGE), "left")
    return found.select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent_owner").alias("parent_conv_id"), F.col("members").alias("n_convs"), "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(rows: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text, any others) as they are.

    Turns are ordered by number, NULL first, ties by a hash of role and text; NULL role and text are empty; repeated rows
    are turns like any other; rows without conv_id take no part. An empty table gives no nodes.
    """
    turns = numbered(rows)
    whole = turns.select("conv_id", (F.col("idx") + 1).alias("depth"), F.col("n").alias("total"), "e", "f", "points")
    return trie(whole, turns.where("idx = 0").select("conv_id", F.col("n").alias("total")))


def rebuilt_trie(rows: DataFrame) -> DataFrame:
    """The same of conversations that are first `rebuilt` to share beginnings."""
    return trie(*rebuilt(numbered(rows)))
