"""Document fingerprints by one-permutation MinHash.

Every shingle of five words is hashed once; the top bits of the hash choose a bin and the smallest hash of a bin stays.
A bin that got no shingle takes the value of a filled bin which a hash of (bin, attempt) picks, so that two texts pick
alike (optimal densification). Only the low `bits` of each bin are stored, packed; the likeness of two fingerprints is
the share of equal bins, corrected for the 2^-bits that agree by chance.
"""

from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.functions import pandas_udf

from . import words
from .shared import slices, small_batches, text_bytes

BINS = 512
BITS = 4
# Documents of one run of the order; a parameter of the shuffle, not of the result.
RUN_ROWS = 8192
# Runs, and so borders, there are at most; beyond that runs grow longer.
MOST_RUNS = 1 << 16

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def packed_bins(hashes: np.ndarray, first: np.ndarray, bins=BINS, bits=BITS) -> np.ndarray:
    """Packed low bits, a row of bins * bits / 8 bytes for each text; texts without shingles get zeros."""
    texts = len(first) - 1
    width = np.uint64(64 - (bins.bit_length() - 1))
    owner = np.repeat(np.arange(texts), np.diff(first))
    table = np.full(texts * bins, _NONE)
    np.minimum.at(table, owner * bins + (hashes >> width).astype(np.int64), hashes)
    table = table.reshape(texts, bins)
    filled = table != _NONE
    row, empty = np.nonzero(~filled & filled.any(axis=1)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        pick = words.mix(empty.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(bins)
        pick = pick.astype(np.int64)
        found = filled[row, pick]
        table[row[found], empty[found]] = table[row[found], pick[found]]
        row, empty = row[~found], empty[~found]
    # The bin takes part in the stored bits, so that bins with the same donor agree by chance one by one.
    salt = words.mix(np.arange(1, bins + 1, dtype=np.uint64))
    low = (words.mix(table ^ salt) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    low[~filled.any(axis=1)] = 0
    per = 8 // bits
    shifts = (np.arange(per, dtype=np.uint8) * bits).astype(np.uint8)
    return np.bitwise_or.reduce(low.reshape(texts, bins // per, per) << shifts, axis=2)


def fingerprint_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Packed fingerprints of a string column, and which rows have any shingle."""
    hashes, first = words.shingles(*words.word_hashes(*text_bytes(column)))
    return packed_bins(hashes, first), np.diff(first) > 0


def hex_strings(packed: np.ndarray, known: np.ndarray) -> list[str]:
    """Lower-case hex; the empty string for a text without words."""
    return [row.tobytes().hex() if k else "" for row, k in zip(packed, known, strict=True)]


def likeness(a: np.ndarray, b: np.ndarray, a_known: np.ndarray, b_known: np.ndarray, bits=BITS) -> np.ndarray:
    """Estimated Jaccard likeness of packed fingerprints, row by row; two texts without words are alike, one is not."""
    differ = a ^ b
    mask = (1 << bits) - 1
    equal = sum(((differ >> s) & mask == 0).sum(axis=1) for s in range(0, 8, bits))
    share = equal / (a.shape[1] * (8 // bits))
    chance = 2.0**-bits
    value = np.clip((share - chance) / (1 - chance), 0.0, 1.0)
    return np.where(a_known & b_known, value, (a_known == b_known).astype(float))


def fingerprints(docs: DataFrame, text="text") -> DataFrame:
    """`docs` with a column `fingerprint` (hex string, empty for NULL texts and texts without words)."""
    small_batches(docs.sparkSession)
    docs = docs.drop("fingerprint")

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, column in slices(batches, text):
            prints = hex_strings(*fingerprint_column(column))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(prints, pa.string())], [*rows.schema.names, "fingerprint"])

    return docs.mapInArrow(mark, docs.select("*", F.lit("").alias("fingerprint")).schema)


def with_successors(docs: DataFrame, rows_per_run=RUN_ROWS) -> DataFrame:
    """(run, place, doc_id, text) in runs of descending doc_id, NULL ids last and equal ids by descending text.

    The last row of each run (place 1) is a copy of the first row of the next run, and that of the last run a copy of
    the very first, so that every document (place 0) has its successor beside it. Only the run borders, at most MOST_RUNS
    quantiles of the ids, pass through the driver; texts are shuffled once.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    runs = min(MOST_RUNS, max(1, -(-n // rows_per_run)))
    shares = [k / runs for k in range(1, runs)]
    borders = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * runs))).first()[0] if shares and n else []
    borders = np.unique(np.array(borders or [], dtype=np.int64))

    @pandas_udf("int")
    def run_of(ids):
        known = ids.notna().to_numpy()
        place = len(borders) - np.searchsorted(borders, ids.fillna(0).astype("int64").to_numpy(), "left")
        return ids.__class__(np.where(known, place, len(borders) + 1).astype("int32"))

    located = docs.withColumn("run", run_of("doc_id"))
    # A row for each run (MOST_RUNS at most), without its text: the run whose head it succeeds.
    heads = located.groupBy("run").agg(F.max("doc_id").alias("head"))
    order = W.orderBy("run")
    last = F.last("run").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    before = heads.select(F.col("run").alias("own"), "head", F.coalesce(F.lag("run").over(order), last).alias("run"))
    same = (F.col("own") == located["run"]) & F.col("head").eqNullSafe(located["doc_id"])
    firsts = located.join(F.broadcast(before), same).groupBy(before["run"]).agg(F.max(F.struct("doc_id", "text")).alias("head"))
    return located.select("run", F.lit(0).alias("place"), "doc_id", "text").unionByName(
        firsts.select("run", F.lit(1).alias("place"), "head.doc_id", "head.text")
    )


def edited_pairs(docs: DataFrame, rows_per_run=RUN_ROWS) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and their likenesses; see the query op1_fingerprints.

    NULL texts are empty. With one document, it is its own successor. Rows repeated in full give repeated results.
    """
    small_batches(docs.sparkSession)
    rows = with_successors(docs, rows_per_run)
    runs = rows.repartition("run").sortWithinPartitions("run", "place", F.desc_nulls_last("doc_id"), F.desc("text"))

    def described(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for part, column in slices(batches, "text"):
            ids, places, run = (part.column(c).to_pylist() for c in ("doc_id", "place", "run"))
            texts = column.to_pylist()
            packed, known = fingerprint_column(column)
            if last is not None:
                ids, places, run, texts = [last[0], *ids], [last[1], *places], [last[2], *run], [last[3], *texts]
                packed, known = np.vstack([last[4], packed]), np.concatenate([last[5], known])
            end = len(ids) - 1
            last = ids[end], places[end], run[end], texts[end], packed[end:], known[end:]
            own = np.flatnonzero(np.array(places[:end], dtype=int) == 0)
            if not len(own):
                continue
            edited = []
            for i in own:
                keep = len(texts[i]) // 3
                edited.append(texts[i][: len(texts[i]) - keep] + texts[i + 1][:keep])
            changed, changed_known = fingerprint_column(pa.array(edited, pa.large_string()))
            a, a_known = packed[own], known[own]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in own], pa.int64()),
                    pa.array([len(texts[i]) for i in own], pa.int64()),
                    pa.array([sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                    pa.array(hex_strings(a, a_known), pa.string()),
                    pa.array(hex_strings(changed, changed_known), pa.string()),
                    pa.array(likeness(a, changed, a_known, changed_known)),
                    pa.array(likeness(a, packed[own + 1], a_known, known[own + 1])),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return runs.mapInArrow(described, schema)
