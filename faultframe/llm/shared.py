"""What the text operators have in common: bounded Arrow batches, stored tables, bounded bit maps."""

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_folder

# Rows of an Arrow batch, and text bytes that a task holds as arrays at a time (one longer text still goes alone).
BATCH_ROWS = 1000
SLICE_BYTES = 2_000_000


def small_batches(spark: SparkSession) -> None:
    """Whole texts travel in batches of few rows, so that a task's memory does not follow the default of 10,000 rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the folder all executors share: computed once, lineage cut, columns prunable."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], text: str, most=SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cuts batches by rows so that a slice holds about `most` bytes of text; NULL texts count as empty."""
    for batch in batches:
        column = pc.fill_null(batch.column(text), "")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        sizes = np.cumsum(np.asarray(pc.binary_length(column), dtype=np.int64))
        first = 0
        while first < len(sizes):
            before = sizes[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(sizes, before + most, "right")))
            yield batch.slice(first, last - first), column.slice(first, last - first)
            first = last


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array without NULLs, and where each row starts and ends in them."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


# A bit map has 16 bits for each value, and 2^MOST_BITS at most: what that takes (128 MB) bounds the driver and the tasks.
LEAST_BITS, MOST_BITS = 16, 30
# Keys that a task remembers so as not to send a copy twice, before it starts again; a matter of traffic, not of the result.
REMEMBERED = 1_000_000


def bit_map(df: DataFrame, value: Column) -> np.ndarray:
    """A map of the non-NULL 64-bit values, packed into 64-bit words; each value sets two bits.

    Its size follows their number up to 2^MOST_BITS. Such a map only spares a later exact join rows that cannot match;
    beyond 2^MOST_BITS / 16 values it fills up and spares fewer.
    """
    n = df.where(value.isNotNull()).count()
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))
    slots = F.array(F.shiftrightunsigned(value, 64 - bits), value.bitwiseAND((1 << bits) - 1))
    words = (
        df.where(value.isNotNull())
        .select(F.explode(slots).alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("mask"))
        .toArrow()
    )
    table = np.zeros(1 << (bits - 6), dtype=np.int64)
    table[np.asarray(words.column("word"))] = np.asarray(words.column("mask"))
    return table.view(np.uint64)


def in_map(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the 64-bit values may be in a map made by bit_map."""
    bits = int(len(table)).bit_length() - 1 + 6
    values = values.view(np.uint64)
    bit = lambda slot: (table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
    found = bit(values >> np.uint64(64 - bits))
    found[found] = bit(values[found] & np.uint64((1 << bits) - 1))
    return found
