"""Best-fit decreasing packing of tokenised documents into sequences of a fixed length.

Best-fit decreasing looks only at lengths, and there are at most `capacity` different ones. So the driver packs the
histogram of lengths: sequences with equal remaining room are kept together as ranges of sequence numbers, and a
segment tree over the remaining capacities finds the tightest room that still fits, in logarithmic time. What comes out
is a table of ranges, bounded by the capacity and not by the number of documents; the n-th document of a length finds its
sequence and offset there. Spark tokenises, counts and numbers the documents of each length.
"""

import base64
import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.functions import pandas_udf

from . import words
from .shared import slices, small_batches, stored, text_bytes

CAPACITY = 2048
END = 0
VOCABULARY = "byte_bpe_50k.tiktoken"  # the ranks of byte_bpe_50k.json, with the same ids
# Distinct text chunks whose ids a worker remembers before it starts again; a matter of memory, not of the result.
REMEMBERED = 1_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>, task int, place long"

# A chunk starts at one of these bytes when a byte that surely begins no white space follows.
_CUTS = np.zeros(256, dtype=bool)
_CUTS[[0x20, 0x09, 0x0A, 0x0D]] = True
_PLAIN = np.ones(256, dtype=bool)
_PLAIN[:0x21] = False
_PLAIN[[0xC2, 0xE1, 0xE2, 0xE3]] = False


def added_tokens(path: str) -> dict[bytes, int]:
    """The tokens that a vocabulary has besides its ranks, from the JSON form beside it (none where there is no such file)."""
    whole = os.path.splitext(path)[0] + ".json"
    if not os.path.exists(whole):
        return {}
    with open(whole, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        raise ValueError("added tokens that take in or need white space around them are not supported")
    return {t["content"].encode(): t["id"] for t in added}


class ChunkTokenizer:
    """Ids of whole texts, tokenising each distinct chunk once.

    The tokenizer cuts a text before the last white-space character ahead of anything else before it merges, so ids of
    such chunks, one after the other, are the ids of the text. Texts are first cut at the `added` tokens.
    """

    def __init__(self, path: str, added: dict[bytes, int] | None = None):
        self.added = added or {}
        self.cutter = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if added else None
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        self.coder = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.sizes[list(ranks.values())] = [len(piece) for piece in ranks]
        self.forget()

    def forget(self):
        self.keys, self.slots = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.begin, self.ids = np.zeros(1, np.int64), np.empty(0, np.int32)

    def coded(self, text: bytes) -> np.ndarray:
        return self.coder.encode_to_numpy(text.decode(), disallowed_special=()).astype(np.int32)

    def learn(self, keys: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray):
        """New chunks: those that start with one white space go through the tokenizer as one text, the others alone.

        The head of a text can be white space that would run together with the end of the chunk before it.
        """
        own = np.frombuffer(raw, np.uint8)
        joined = _CUTS[own[starts]] & (ends > starts + 1) & _PLAIN[own[np.minimum(starts + 1, len(own) - 1)]]
        order = np.argsort(~joined, kind="stable")
        keys, starts, ends, many = keys[order], starts[order].tolist(), ends[order].tolist(), int(joined.sum())
        sizes = np.array(ends) - np.array(starts)
        flat = self.coded(b"".join([raw[s:e] for s, e in zip(starts[:many], ends[:many], strict=True)]))
        parts = [flat, *[self.coded(raw[s:e]) for s, e in zip(starts[many:], ends[many:], strict=True)]]
        flat = np.concatenate(parts)
        # The ids of a chunk end where the bytes of its pieces end.
        last = np.searchsorted(np.cumsum(self.sizes[flat]), np.cumsum(sizes)) + 1
        slots = len(self.begin) - 1 + np.arange(len(keys))
        self.begin, self.ids = np.concatenate([self.begin, self.begin[-1] + last]), np.concatenate([self.ids, flat])
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys, self.slots = np.insert(self.keys, at, keys[order]), np.insert(self.slots, at, slots[order])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the index of each text's first id (one more entry at the end)."""
        raw = data.tobytes() if self.added else b""
        if not any(token in raw for token in self.added):
            return self.encode_plain(data, offsets)
        bounds = zip(offsets.tolist(), offsets[1:].tolist(), strict=False)
        met = [(m.start(), m.end(), self.added[m[0]], k) for k, (s, e) in enumerate(bounds) for m in self.cutter.finditer(raw, s, e)]
        starts, ends, tokens, owner = np.array(met, dtype=np.int64).reshape(-1, 4).T
        # Without the tokens, each of them is a border between two texts.
        drop = np.zeros(len(data) + 1, dtype=np.int64)
        np.add.at(drop, starts, 1)
        np.add.at(drop, ends, -1)
        inside = np.cumsum(drop)
        shift = np.concatenate([[0], np.cumsum(inside[:-1])])
        borders = offsets - shift[offsets]
        at = np.searchsorted(owner, np.arange(len(offsets)))  # tokens ahead of each text
        ids, first = self.encode_plain(data[inside[:-1] == 0], np.insert(borders, owner + 1, starts - shift[starts]))
        heads = np.arange(len(offsets)) + at
        # The token of rank j ends piece owner + j, before which stand j other tokens.
        ids = np.insert(ids, first[owner + np.arange(len(owner)) + 1], tokens)
        return ids, first[heads] + at

    def encode_plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins = np.zeros(len(data), dtype=bool)
        begins[:-1] = _CUTS[data[:-1]] & _PLAIN[data[1:]]
        full = offsets[1:] > offsets[:-1]
        begins[offsets[1:][full] - 1] = False  # what follows belongs to another text
        begins[offsets[:-1][full]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        keys, seen, which = np.unique(words.hashes(data, starts, ends, lower=False), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > REMEMBERED:
            self.forget()
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        known[place < len(self.keys)] = self.keys[place[place < len(self.keys)]] == keys[place < len(self.keys)]
        if not known.all():
            new = seen[~known]
            self.learn(keys[~known], data.tobytes(), starts[new], ends[new])
        slot = self.slots[np.searchsorted(self.keys, keys)][which] if len(keys) else np.empty(0, np.int64)
        sizes = self.begin[slot + 1] - self.begin[slot]
        total = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(self.begin[slot] - total[:-1], sizes) + np.arange(total[-1])
        return self.ids[take], total[np.searchsorted(starts, offsets)]


@cache
def coder_of(path: str) -> ChunkTokenizer:
    """One tokenizer for all tasks of a worker."""
    return ChunkTokenizer(path, added_tokens(path))


def pieces(docs: DataFrame, capacity=CAPACITY, end=END, vocabulary: str | None = None, text="text") -> DataFrame:
    """Token ids of every document with `end` after them, cut into pieces of at most `capacity` ids.

    Only documents longer than that are cut; then the first piece takes the remainder. NULL and empty texts give one
    piece of the end id alone. `task` and `place` number the pieces of one length inside a task.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    small_batches(docs.sparkSession)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task = coder_of(path), TaskContext.get().partitionId()
        met = np.zeros(capacity + 1, dtype=np.int64)
        for rows, column in slices(batches, text):
            flat, first = coder.encode(*text_bytes(column))
            n = len(column)
            ids = np.insert(flat, first[1:], end).astype(np.int32)
            first = first + np.arange(n + 1)
            sizes = np.diff(first)
            many = -(-sizes // capacity)
            owner = np.repeat(np.arange(n), many)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
            head = sizes - (many - 1) * capacity
            start = np.where(number == 0, 0, head[owner] + (number - 1) * capacity)
            length = np.where(number == 0, head[owner], capacity)
            begin = first[owner] + start
            raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * b : 4 * (b + k)]) for b, k in zip(begin.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            values, at, counts = np.unique(length[order], return_index=True, return_counts=True)
            place = np.empty(len(owner), dtype=np.int64)
            place[order] = np.arange(len(owner)) - np.repeat(at, counts) + np.repeat(met[values], counts)
            met[values] += counts
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id").cast(pa.int64()).take(pa.array(owner)),
                    pa.array(number, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)), pa.int32()), pa.array(ids)),
                    pa.array(np.full(len(owner), task), pa.int32()),
                    pa.array(place),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "task", "place"],
            )

    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(cut, PIECES)


class RoomTree:
    """Segment tree over the remaining capacities 0..capacity: which of them have open sequences."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.some = bytearray(2 * self.size)

    def mark(self, room: int, present: bool):
        node = room + self.size
        self.some[node] = present
        while node > 1:
            node //= 2
            self.some[node] = self.some[2 * node] | self.some[2 * node + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest present capacity of at least `least`."""
        node = least + self.size
        if self.some[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.some[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node + (not self.some[2 * node])
                return node - self.size
            node //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity=CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first sequence, items per sequence, offset), in descending length and ascending rank."""
    tree, ranges = RoomTree(capacity), [[] for _ in range(capacity + 1)]
    plan, sequences = [], 0

    def leave(room, first, n):
        if n and room:
            ranges[room].append((first, n))
            tree.mark(room, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first = capacity, sequences
                n = -(-left // (capacity // length))
                sequences += n
            else:
                first, n = ranges[room].pop()
                tree.mark(room, bool(ranges[room]))
            per = room // length
            full = min(n, left // per)
            plan.append((length, rank, first, per, capacity - room))
            rest = min(left - full * per, per - 1) if full < n else 0
            leave(room - per * length, first, full)
            if rest:
                leave(room - rest * length, first + full, 1)
            leave(room, first + full + bool(rest), n - full - bool(rest))
            rank, left = rank + full * per + rest, left - full * per - rest
    return np.array(plan, dtype=np.int64).reshape(-1, 5)


def placements(cut: DataFrame, capacity=CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for stored `pieces`."""
    sizes = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_fit_plan(counts, capacity)
    heads = (capacity - plan[:, 0]) << 48 | plan[:, 1]  # ascending, as the plan is ordered

    @pandas_udf("sequence_id long, offset long")
    def locate(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(), rank.to_numpy()
        row = plan[np.searchsorted(heads, (capacity - length) << 48 | rank, "right") - 1]
        inside = rank - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 2] + inside // row[:, 3], "offset": row[:, 4] + inside % row[:, 3] * length})

    earlier = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = cut.drop("ids").join(before, ["length", "task"])
    found = ranked.withColumn("found", locate("length", (F.col("before") + F.col("place")).cast("long")))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "found.sequence_id", "found.offset")


def pack(docs: DataFrame, capacity=CAPACITY, end=END, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Stored pieces with their ids, and where each piece lies.

    NULL and empty texts take one id; equal lengths are placed in the order of tasks; repeated rows are packed as often
    as they occur; an empty table gives empty tables. Further columns of `docs` are left out.
    """
    cut = stored(pieces(docs, capacity, end, vocabulary), "pieces")
    return cut, placements(cut, capacity)
