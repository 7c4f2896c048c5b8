"""Benchmark decontamination by spaced seeds.

A seed mask looks at some of a few neighbouring words and ignores the others, so a substituted word spoils only the masks
that look at it. Benchmark and documents are hashed under fixed masks, equal hashes give an alignment of a document with
a benchmark item, and around such hits the aligned words are compared one by one: a stretch counts +1 for an equal and
-2 for a substituted word, and one of the maximal stretches must hold enough equal words. Those are the stretches that no
word on either side can improve; every stretch that is positive from both ends lies inside one of them.

Words are runs of letters, digits and non-ASCII characters with A-Z lower-cased, so punctuation does not matter.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words
from .shared import REMEMBERED, bit_map, in_map, slices, small_batches, stored, text_bytes

# With these, a passage of 15 words with 3 of them substituted at random has a hit with probability above 0.999.
MASKS = ("11111", "1110011", "1101101", "10110101", "110001011", "1010100101")
# Equal words that a stretch needs; of an item with fewer words, this share of them.
ENOUGH, SHARE = 12, 0.75
SUBSTITUTION = -2


def seeds(hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(seed hashes, position of their first words among all words) for each mask, inside texts only."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for number, mask in enumerate(MASKS):
        places = [k for k, c in enumerate(mask) if c == "1"]
        n = len(hashes) - len(mask) + 1
        if n <= 0:
            continue
        total = np.full(n, number + 1, dtype=np.uint64)
        for rank, k in enumerate(places):
            total += hashes[k : k + n] * words._PLACES[rank]
        inside = np.flatnonzero(text[:n] == text[len(mask) - 1 :])
        yield words.mix(total[inside]), inside


def hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return words.word_hashes(*text_bytes(column), words.MARKS)


def benchmark_items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored: (item_id, words) with one item, the one of lowest id, for equal word sequences, and (seed, item_id, at)."""

    def spelled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, column in slices(batches, "text"):
            found, first = hashed(column)
            yield pa.RecordBatch.from_arrays([rows.column("item_id"), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(found.view(np.int64)))], ["item_id", "words"])

    def seeded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = np.asarray(batch.column("item_id")), batch.column("words")
            first = np.asarray(lists.offsets, dtype=np.int64)
            flat, first = np.asarray(lists.values).view(np.uint64)[first[0] : first[-1]], first - first[0]
            for found, at in seeds(flat, first):
                item = np.searchsorted(first, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(ids[item]), pa.array(at - first[item])], ["seed", "item_id", "at"])

    known = benchmark.where("item_id is not null").select(F.col("item_id").cast("long"), "text")
    items = known.mapInArrow(spelled, "item_id long, words array<long>").where("size(words) > 0")
    items = stored(items.groupBy("words").agg(F.min("item_id").alias("item_id")).select("item_id", "words"), "benchmark-items")
    return items, stored(items.mapInArrow(seeded, "seed long, item_id long, at long").distinct(), "benchmark-seeds")


def hits(docs: DataFrame, table) -> DataFrame:
    """(key, seed, at) for the seeds of the texts that may be seeds of the benchmark; equal texts have one key."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for rows, column in slices(batches, "text"):
            keys = np.asarray(rows.column("key"))
            if len(seen) > REMEMBERED:  # then a copy may come again; the join makes its rows one
                seen.clear()
            new = np.array([k not in seen and not seen.add(k) for k in keys.tolist()], dtype=bool)
            found, first = hashed(column)
            for seed, at in seeds(found, first):
                may = in_map(table.value, seed)
                seed, at = seed[may], at[may]
                text = np.searchsorted(first, at, "right") - 1
                keep = new[text]
                seed, at, text = seed[keep], at[keep], text[keep]
                if len(seed):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[text]), pa.array(seed.view(np.int64)), pa.array(at - first[text])], ["key", "seed", "at"])

    return docs.mapInArrow(work, "key long, seed long, at long")


def texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, words) of the texts with these keys, once each. A bit map spares the other texts."""
    table = docs.sparkSession.sparkContext.broadcast(bit_map(keys, F.col("key")))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_map(table.value, np.asarray(batch.column("key")))))
            for rows, column in slices([batch], "text"):
                found, first = hashed(column)
                yield pa.RecordBatch.from_arrays([rows.column("key"), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(found.view(np.int64)))], ["key", "words"])

    found = docs.mapInArrow(work, "key long, words array<long>")
    return found.join(keys, "key", "left_semi").groupBy("key").agg(F.first("words").alias("words"))


def stretches(equal: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, equal words) of all maximal stretches, in order: a linear pass over the runs of equal words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]]).astype(np.int8))).tolist()
    found, total, at = [], 0, 0  # (start, end, sum before, sum behind)
    for start, end in zip(edges[::2], edges[1::2], strict=True):
        before = total + SUBSTITUTION * (start - at)
        total, at = before + end - start, end
        own = (start, end, before, total)
        while True:
            # The nearest stretch that begins lower; with one that ends lower too, everything in between becomes one.
            near = next((k for k in range(len(found) - 1, -1, -1) if found[k][2] < own[2]), None)
            if near is None or found[near][3] >= own[3]:
                found.append(own)
                break
            own = (found[near][0], own[1], found[near][2], own[3])
            del found[near:]
    return [(s, e, int(equal[s:e].sum())) for s, e, _, _ in found]


def overlaps(aligned: DataFrame) -> DataFrame:
    """Verified stretches of rows (key, item_id, shift, words, item): document word `shift + j` lies over item word j."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                shift = batch.column("shift")[i].as_py()
                text = np.asarray(batch.column("words")[i].values)
                item = np.asarray(batch.column("item")[i].values)
                low, high = max(0, -shift), min(len(item), len(text) - shift)
                same, enough = text[shift + low : shift + high] == item[low:high], min(ENOUGH, SHARE * len(item))
                if same.sum() < enough:
                    continue
                for start, end, equal in stretches(same):
                    if equal >= enough:
                        out.append((batch.column("key")[i].as_py(), batch.column("item_id")[i].as_py(), shift + low + start, end - start, equal))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["key", "item_id", "start_word", "n_words", "n_equal"])

    return aligned.mapInArrow(work, "key long, item_id long, start_word long, n_words long, n_equal long")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, n_equal): the best overlap of each document and benchmark item that have one.

    Rows repeated in `docs` repeat their results, NULL ids included; NULL and empty texts have none. Items with equal
    words count as the one of lowest item_id; an item of fewer words than a mask looks at (5) is not found, nor is one
    without id. Ties between overlaps go to the most words, then to the first place.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("key"))
    texts = docs.where("text is not null").select("key", "text")
    items, known = benchmark_items(benchmark)
    table = docs.sparkSession.sparkContext.broadcast(bit_map(known, F.col("seed")))
    met = hits(texts, table).join(known.withColumnRenamed("at", "item_at"), "seed")
    shifts = stored(met.select("key", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "alignments")
    spelled = texts_of(texts, shifts.select("key").distinct())
    aligned = shifts.join(spelled, "key").join(items.withColumnRenamed("words", "item"), "item_id")
    best = F.struct("n_equal", "n_words", (-F.col("start_word")).alias("back"))
    found = overlaps(aligned.select("key", "item_id", "shift", "words", "item")).groupBy("key", "item_id").agg(F.max(best).alias("best"))
    found = stored(found, "overlaps")
    rows = docs.drop("text").join(found, "key")
    return rows.select("doc_id", "item_id", (-F.col("best.back")).alias("start_word"), "best.n_words", "best.n_equal")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the rows whose text overlaps a benchmark item."""
    found = leaks(docs.withColumn("doc_id", F.xxhash64("text")), benchmark).select(F.col("doc_id").alias("__key")).distinct()
    return docs.withColumn("__key", F.xxhash64("text")).join(found, "__key", "left_anti").select(*docs.columns)
