"""Exact Jaccard join of documents on word shingles, with adaptive multi-match prefixes.

Shingles are ordered from rare to frequent. Two sets of sizes m and n with Jaccard likeness of at least 4/5 share at
least ceil(4/5 max(m, n)) shingles, so the first n - ceil(4n/5) + l shingles of each (the l-prefix) have at least l in
common. Each document chooses l by what it costs: longer prefixes mean more rows, but fewer candidates to verify. For a
pair, the l of the larger set holds.

Equal sets are one set. Because classes are wanted and not all pairs, sets that share prefix shingles are first compared
with one of their number (a hub). Where many sets of a shingle are outside its largest class, they are then compared with a
few of that class, drawn anew as long as a round leaves less than half of the meetings open. Only between sets which this leaves in different classes
all candidates are compared. So a group of n near copies costs about n comparisons, even if its hub links with few of them,
and no link between different classes is lost.

Every set has a sketch, the parities of its shingles in 512 buckets. A shingle that only one of two sets has changes one
parity, so sketches that differ in d bits belong to sets that differ in at least d shingles. Candidates whose sketches
differ too much are dropped before any shingles are fetched; a bound, which loses no link.
"""

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from . import words
from .graph import components
from .shared import REMEMBERED, bit_map, in_map, slices, small_batches, stored, text_bytes

# Counters of the frequency table that orders shingles: its size bounds what the driver and every task hold.
COUNTER_BITS = 22
BLOCK = 1 << 14
# Largest l, and what a prefix row and a verification cost against looking at one candidate.
MOST = 3
ROW_COST, VERIFY_COST = 4.0, 32.0
# Prefix shingles whose counter exceeds this (or four times the mean counter) are known to repeat without a look.
HOT = 1024

# Shingles with more sets than this outside their largest class are crowded; hubs a set is compared with in a round, and
# rounds at most. They decide how many candidates are left for the last step, not the result.
CROWD, HUBS, ROUNDS = 8, 4, 6

# Text bytes of which a task makes shingles at a time. Hashing takes some 30 bytes for each byte of text.
SLICE = 1 << 18

SKETCH = [f"s{k}" for k in range(8)]

_SALT = np.uint64(0xA0761D6478BD642F)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and the index of each text's first one (one more at the end)."""
    found, first = words.shingles(*words.word_hashes(*text_bytes(column)))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        found[a:b].sort()
    new = np.ones(len(found), dtype=bool)
    new[1:] = found[1:] != found[:-1]
    new[first[:-1][first[:-1] < first[1:]]] = True
    return found[new], np.concatenate([[0], np.cumsum(new)])[first]


def set_ids(found: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; 0 for an empty one."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(found ^ _SALT))])
    sizes = np.diff(first)
    names = words.mix(total[first[1:]] - total[first[:-1]] + sizes.astype(np.uint64))
    return np.where(sizes > 0, names, np.uint64(0)).view(np.int64)


def sketches(found: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(sets, 8): the parities of each set's shingles by the lowest 9 bits, as 64-bit words."""
    n, width = len(first) - 1, 64 * len(SKETCH)
    owner = np.repeat(np.arange(n), np.diff(first))
    bucket = (found & np.uint64(width - 1)).astype(np.int64)
    odd = np.bincount(owner * width + bucket, minlength=n * width).astype(np.uint8) & 1
    return np.packbits(odd.reshape(n, width), axis=1).view(np.int64)


def alike(x: str, y: str):
    """Whether the sketches of x and y allow a likeness of 0.8: 9 * differing shingles <= all shingles."""
    differing = sum((F.bit_count(F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}"))) for s in SKETCH), F.lit(0))
    return differing * 9 <= F.col(f"{x}.size") + F.col(f"{y}.size")


def count_in(counts: np.ndarray, found: np.ndarray) -> None:
    """Adds the shingles to their counters in place."""
    np.add.at(counts, (found >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), np.uint32(1))


def described(docs: DataFrame) -> DataFrame:
    """Stored: a row (doc_id, n_shingles, sid, sketch) for each document, and rows (task, block, counts) of shingle counts."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, dtype=np.uint32)
        for rows, column in slices(batches, "text", SLICE):
            found, first = shingle_sets(column)
            count_in(counts, found)
            n = len(column)
            none = pa.nulls(n, pa.int32())
            columns = [rows.column("doc_id"), pa.array(np.diff(first)), pa.array(set_ids(found, first)), none, none, pa.nulls(n, pa.binary())]
            columns += [pa.array(s) for s in sketches(found, first).T]
            yield pa.RecordBatch.from_arrays(columns, names)
        task = TaskContext.get().partitionId()
        for block, part in enumerate(counts.reshape(-1, BLOCK)):
            if part.any():
                none = pa.nulls(1, pa.int64())
                columns = [none, none, none, pa.array([task], pa.int32()), pa.array([block], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)])]
                yield pa.RecordBatch.from_arrays([*columns, *[none] * len(SKETCH)], names)

    names = ["doc_id", "n_shingles", "sid", "task", "block", "counts", *SKETCH]
    schema = "doc_id long, n_shingles long, sid long, task int, block int, counts binary, " + ", ".join(f"{s} long" for s in SKETCH)
    return stored(docs.mapInArrow(work, schema), "shingle-sets")


def frequency_classes(parts: DataFrame) -> np.ndarray:
    """For each counter, 8 * log2(1 + its sum) as one byte. Sums are made in two levels of bounded groups."""

    def added(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, dtype=np.uint64)
        for packed, wide in zip(group["counts"], group["wide"], strict=True):
            total += np.frombuffer(zlib.decompress(packed), dtype=np.uint64 if wide else np.uint32)
        return pd.DataFrame({"block": group["block"].iloc[:1], "counts": [zlib.compress(total.tobytes(), 1)], "wide": [True]})

    kind = "block int, counts binary, wide boolean"
    parts = parts.select("block", "counts", F.lit(False).alias("wide"), (F.col("task") % 64).alias("part"))
    first = parts.groupBy("block", "part").applyInPandas(added, kind)
    total = np.zeros(1 << COUNTER_BITS, dtype=np.uint64)
    for r in first.groupBy("block").applyInPandas(added, kind).toLocalIterator():
        total[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(zlib.decompress(r.counts), dtype=np.uint64)
    return np.minimum(255, 8 * np.log2(1.0 + total)).astype(np.uint8)


def prefixes(docs: DataFrame, classes: np.ndarray) -> DataFrame:
    """(token, sid, size, pos, ell, hot): the prefix shingles of each set, once for each task that meets the set."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(classes)
    count_of = 2.0 ** (np.arange(256) / 8) - 1
    mean = float(count_of[classes].mean())
    excess = np.maximum(0.0, count_of - 2 * mean)  # frequency beyond what chance puts into one counter
    hot_from = max(HOT, 4 * mean)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for _, column in slices(batches, "text", SLICE):
            found, first = shingle_sets(column)
            if len(seen) > REMEMBERED:  # equal rows are made one later
                seen.clear()
            group = table.value[found >> np.uint64(64 - COUNTER_BITS)]
            picked, sids, sizes, places, ells = [], [], [], [], []
            for a, b, sid in zip(first[:-1].tolist(), first[1:].tolist(), set_ids(found, first).tolist(), strict=True):
                if a == b or sid in seen:
                    continue
                seen.add(sid)
                n, need = b - a, -(-4 * (b - a) // 5)
                most = min(MOST, need)
                order = np.argsort(group[a:b], kind="stable")[: n - need + most]
                load = np.cumsum(excess[group[a:b][order]])
                cost = [ROW_COST * (n - need + e) + load[n - need + e - 1] * (1 + VERIFY_COST / e) for e in range(1, most + 1)]
                picked.append(a + order)
                sids.append(sid)
                sizes.append(n)
                places.append(len(order))
                ells.append(int(np.argmin(cost)) + 1)
            if not picked:
                continue
            at = np.concatenate(picked)
            many = np.array(places)
            pos = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found[at].view(np.int64)),
                    pa.array(np.repeat(np.array(sids, dtype=np.int64), many)),
                    pa.array(np.repeat(np.array(sizes, dtype=np.int32), many)),
                    pa.array(pos.astype(np.int32)),
                    pa.array(np.repeat(np.array(ells, dtype=np.int32), many)),
                    pa.array(count_of[group[at]] > hot_from),
                ],
                ["token", "sid", "size", "pos", "ell", "hot"],
            )

    return docs.mapInArrow(work, "token long, sid long, size int, pos int, ell int, hot boolean")


def repeated_prefixes(rows: DataFrame) -> DataFrame:
    """Stored: the prefix rows of shingles that more than one set may have in its prefix, one for each set.

    Frequent shingles stay without being counted, so no task of the count gets a group beyond the bound of `hot`.
    """
    columns = ["token", "sid", "meta"]
    packed = rows.withColumn("meta", F.shiftleft(F.col("size").cast("long"), 32) + F.col("pos") * 8 + F.col("ell"))
    same = W.partitionBy("token")
    cold = packed.where("not hot").select(*columns).repartition("token")
    cold = cold.select(*columns, F.min("sid").over(same).alias("low"), F.max("sid").over(same).alias("high"))
    kept = cold.where("low <> high").select(*columns).union(packed.where("hot").select(*columns)).distinct()
    size, pos = F.shiftright("meta", 32), F.shiftright(F.col("meta").bitwiseAND(0xFFFFFFFF), 3)
    need = F.ceil(size * 4 / 5)
    return stored(
        kept.select(
            "token", "sid", size.alias("size"), pos.alias("pos"), F.col("meta").bitwiseAND(7).alias("ell"),
            F.greatest(F.lit(1), pos - (size - need) + 1).alias("level"),
        ),
        "prefixes",
    )


def sets_of(docs: DataFrame, info: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, shingles) for the sids `wanted`. A bit map of their smallest doc_ids spares the others' texts."""
    carriers = info.join(wanted, "sid", "left_semi").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
    carriers = stored(carriers, "carriers")
    table = docs.sparkSession.sparkContext.broadcast(bit_map(carriers, F.xxhash64("doc_id")))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_map(table.value, np.asarray(batch.column("mark")))))
            for _, column in slices([batch], "text", SLICE):
                found, first = shingle_sets(column)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(set_ids(found, first)), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(found.view(np.int64)))],
                    ["sid", "shingles"],
                )

    sets = docs.select("text", F.xxhash64("doc_id").alias("mark")).mapInArrow(work, "sid long, shingles array<long>")
    return sets.join(carriers, "sid", "left_semi").groupBy("sid").agg(F.first("shingles").alias("shingles"))


def verified(docs: DataFrame, info: DataFrame, pairs: DataFrame) -> DataFrame:
    """Stored: the pairs (a, b) of sids whose sets have 100 * intersection >= 80 * union, each in both directions."""
    wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    sets = sets_of(docs, info, wanted)  # both joins read the same shuffled sets
    left = pairs.select("a", "b").join(sets.select(F.col("sid").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("sid").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    linked = common * 100 >= (F.size("x") + F.size("y") - common) * 80
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    # The shuffle brings the few links of many tasks into few files.
    return stored(both.where(linked).select(ways.alias("way")).select("way.*").distinct(), "links")


def hub_pairs(shared: DataFrame, marks: DataFrame) -> DataFrame:
    """Stored: for each set the hub with which it shares most prefix shingles, if their sketches are alike.

    The hub of a shingle is the set of lowest hash.
    """
    hubs = shared.groupBy("token").agg(F.min(F.struct(F.xxhash64("sid").alias("h"), "sid", "size")).alias("hub"))
    met = shared.join(hubs, "token").where("sid <> hub.sid and 5 * least(size, hub.size) >= 4 * greatest(size, hub.size)")
    counted = met.groupBy(F.col("sid").alias("a"), F.col("hub.sid").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b"))
    x, y = marks.alias("x"), marks.alias("y")
    met = best.join(x, F.col("a") == F.col("x.sid")).join(y, F.col("b") == F.col("y.sid"))
    return stored(met.where(alike("x", "y")).select("a", "b"), "hub-pairs")


def with_labels(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """`shared` with the label of each set's class; a set without links is its own."""
    rows = shared.join(labels.select(F.col("node").alias("sid"), "label"), "sid", "left")
    return rows.withColumn("label", F.coalesce("label", "sid"))


def mixed_tokens(rows: DataFrame) -> DataFrame:
    """(token, main, sets, apart): the shingles of more than one class, the most common class, all sets, those of the others."""
    counts = rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = counts.groupBy("token").agg(
        F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("sets"), (F.sum("n") - F.max("n")).alias("apart")
    )
    return mixed.where("apart > 0")


def crowded(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Stored: of `rows` (token, sid, size) those of crowded shingles, with the set's label and the columns of mixed_tokens."""
    rows = with_labels(rows.select("token", "sid", "size"), labels)
    return stored(rows.join(mixed_tokens(rows).where(F.col("apart") > CROWD), "token"), "crowded")


def further_hub_pairs(rows: DataFrame, marks: DataFrame, turn: int) -> DataFrame:
    """Stored: for each set outside the most common class of a crowded shingle up to HUBS sets of that class.

    The class's sets are dealt into HUBS parts, and of each part that of lowest hash is a hub; `turn` draws them anew. Of
    each part a set meets the hub with which it shares most shingles, if their sketches are alike.
    """
    order = F.xxhash64("sid", F.lit(turn))
    hubs = rows.where("label = main").groupBy("token", F.pmod(order, F.lit(HUBS)).alias("part"))
    hubs = hubs.agg(F.min(F.struct(order.alias("h"), "sid", "size")).alias("hub"))
    met = rows.where("label <> main").join(hubs, "token").where("5 * least(size, hub.size) >= 4 * greatest(size, hub.size)")
    counted = met.groupBy(F.col("sid").alias("a"), "part", F.col("hub.sid").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("a", "part").agg(F.max_by("b", F.struct("n", "b")).alias("b")).select("a", "b").distinct()
    x, y = marks.alias("x"), marks.alias("y")
    met = best.join(x, F.col("a") == F.col("x.sid")).join(y, F.col("b") == F.col("y.sid"))
    return stored(met.where(alike("x", "y")).select("a", "b"), "hub-pairs")


def hub_links(docs: DataFrame, known: DataFrame, shared: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, labels): what comparisons with hubs link, and the classes that this makes.

    A round costs many passes over small tables, so there is a further one only if the last left less than half of the
    meetings of crowded shingles open.
    """
    links = verified(docs, known, hub_pairs(shared, marks))
    labels, rows, before = components(links), shared, None
    for turn in range(ROUNDS):
        rows = crowded(rows, labels)  # sets of one class stay so: what is not crowded does not become so
        left = rows.where("label <> main").agg(F.sum("sets")).first()[0] or 0
        if not left or (before is not None and left * 2 > before):
            break
        met = verified(docs, known, further_hub_pairs(rows, marks, turn))
        if met.isEmpty():
            break
        links, before = links.union(met), left
        labels = components(links)
    return links, labels


def open_pairs(shared: DataFrame, labels: DataFrame, marks: DataFrame) -> DataFrame:
    """Stored: candidate pairs of sets with different labels.

    For each shingle, sets outside its most common label meet all others, so that sets of one label never meet.
    """
    rows = stored(with_labels(shared, labels), "labelled")
    rows = rows.join(mixed_tokens(rows).select("token", "main"), "token").join(marks.drop("size"), "sid")
    x, y = rows.where("label <> main").alias("x"), rows.alias("y")
    rest = F.least(F.col("x.size") - F.col("x.pos"), F.col("y.size") - F.col("y.pos"))
    need = F.ceil((F.col("x.size") + F.col("y.size")) * 4 / 9)
    probe = F.when(F.struct("x.size", "x.sid") > F.struct("y.size", "y.sid"), F.col("x.ell")).otherwise(F.col("y.ell"))
    met = x.join(y, F.col("x.token") == F.col("y.token")).where(
        (F.col("x.label") != F.col("y.label"))
        & ((F.col("y.label") == F.col("y.main")) | (F.col("x.sid") < F.col("y.sid")))
        & (F.least("x.size", "y.size") * 5 >= F.greatest("x.size", "y.size") * 4)
        & alike("x", "y")
        # The first l of at least `need` common shingles stand so far in front in both.
        & (F.col("x.pos") <= F.col("x.size") - need + probe - 1)
        & (F.col("y.pos") <= F.col("y.size") - need + probe - 1)
    )
    # Which of the two is x differs from shingle to shingle.
    counted = met.groupBy(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b")).agg(
        F.count(F.lit(1)).alias("matches"),
        F.first(probe).alias("ell"),
        F.first(need).alias("need"),
        # All that is shared up to the last of these shingles, and at most everything behind it.
        (F.count(F.lit(1)) + F.min(rest) - 1).alias("most"),
    )
    return stored(counted.where("matches >= ell and most >= need").select("a", "b"), "open-pairs")


def labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored: (doc_id, n_shingles, sid, sketch) of every row, and (sid, label, lowest, component_id) of every set.

    Sets of one label are one class; `lowest` is the smallest doc_id that has the set, `component_id` that of the class.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    all_rows = described(docs)
    info = all_rows.where("block is null").select("doc_id", "n_shingles", "sid", *SKETCH)
    known = info.where("n_shingles > 0 and doc_id is not null")
    marks = known.groupBy("sid").agg(F.first("n_shingles").alias("size"), *[F.first(s).alias(s) for s in SKETCH])
    marks = stored(marks, "sketches")
    order = frequency_classes(all_rows.where("block is not null"))
    owned = docs.where("doc_id is not null")
    shared = repeated_prefixes(prefixes(owned, order))
    links, labels = hub_links(owned, known, shared, marks)
    further = open_pairs(shared, labels, marks)
    if not further.isEmpty():
        labels = components(links.union(verified(owned, known, further)))
    lowest = known.groupBy("sid").agg(F.min("doc_id").alias("lowest")).join(labels.withColumnRenamed("node", "sid"), "sid", "left")
    lowest = lowest.withColumn("label", F.coalesce("label", "sid"))
    group = lowest.groupBy("label").agg(F.min("lowest").alias("component_id"))
    # Named by label and sid, both unique on this side; the documents' side may be split where one set is frequent.
    return info, stored(lowest.join(group, "label").select("sid", "label", "lowest", "component_id"), "classes")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs` (doc_id, text, any others).

    Two documents link when their sets of five-word shingles have a Jaccard likeness of 0.8 or more; component_id is the
    smallest doc_id to be reached by links. Texts that are NULL or without words have no shingles and link with nothing.
    A NULL doc_id takes no part and gets a NULL component. Rows with equal texts are one class; repeated rows come back
    as often as they occur. Sets and shingles are told apart by 64-bit hashes.
    """
    info, named = labelled(docs)
    rows = info.select("doc_id", "n_shingles", "sid").join(named.select("sid", "component_id"), "sid", "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def with_set_ids(docs: DataFrame) -> DataFrame:
    """`docs` with __sid, the name of each text's set (0 without words)."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, column in slices(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(set_ids(*shingle_sets(column)))], [*rows.schema.names, "__sid"])

    return docs.mapInArrow(work, docs.withColumn("__sid", F.lit(0).cast("long")).schema)


def one_of_each(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each class: that of the lowest doc_id, and of the smallest set name if that id has
    several texts of the class.

    Of rows with that id and set the one with the smallest text stays, then that of the smallest hash of all columns. A
    doc_id with unlike texts has a document in each of their classes. Rows without doc_id or without words link with
    nothing and all stay.
    """
    _, named = labelled(docs)
    chosen = named.groupBy("label").agg(F.min(F.struct("lowest", "sid")).alias("c")).select("c.lowest", F.col("c.sid").alias("__sid"))
    linked = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    names = docs.columns
    rows = with_set_ids(docs.where(linked))
    kept = rows.join(chosen, (rows["doc_id"] == chosen["lowest"]) & (rows["__sid"] == chosen["__sid"]), "left_semi")
    first = F.min_by(F.struct(*names), F.struct("text", F.xxhash64(*names))).alias("row")
    return kept.groupBy("doc_id", "__sid").agg(first).select("row.*").union(docs.where(~linked))
