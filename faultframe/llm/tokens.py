"""Token counts of whole texts, kept in a cache by the digests of content and tokenizer.

A count depends only on the text and the tokenizer. So every text is known by the SHA-256 of its normalised content, every
tokenizer by that of its file, library and normalisation, and counts are looked up by both. Texts without a count are
encoded once, whatever the number of their copies, and appended to the cache for later runs.
"""

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import cache
from importlib.metadata import version as release

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, functions as F
from tokenizers import Tokenizer

from ..operators.joins import attach_counted
from . import words
from .shared import slices, small_batches, stored, text_bytes

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
# Distinct words whose counts a worker remembers before it starts again; a matter of memory, not of the result.
REMEMBERED = 1_000_000
# Texts (or words) that go to the library in one call.
AT_ONCE = 20_000

CACHE = "digest binary, n_tokens long"


def drops_spaces(path: str) -> bool:
    """Whether a vocabulary file is of the kind that cuts at white space and drops it ahead of anything else.

    Then the count of a text is the sum of those of its words: the added tokens of such a file hold no white space, and
    neither composition nor lower-casing of characters reaches over a space.
    """
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    steps = (whole.get("pre_tokenizer") or {}).get("pretokenizers", [])
    folded = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "} in (whole.get("normalizer") or {}).get("normalizers", [])
    first = steps[0] if steps else {}
    cut = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and "\\s" in str(first.get("pattern"))
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"])) for t in whole["added_tokens"])
    return folded and cut and plain


def tokenizer_digest(path: str) -> str:
    """Hex digest of all that counts depend on besides the text."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as file:
        content = hashlib.sha256(file.read()).hexdigest()
    form = "spaces folded" if drops_spaces(path) else "as is"
    return hashlib.sha256("\n".join([content, library, release(library), form]).encode()).hexdigest()


def content_digest(text: Column, folded: bool) -> Column:
    """SHA-256 of the normalised content: NULL is empty; with `folded` runs of ASCII white space are one space, none outside."""
    text = F.coalesce(text, F.lit(""))
    if folded:
        text = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return F.unhex(F.sha2(text, 256))


class TokenCounter:
    """Numbers of tokens as the library gives them: no begin, end or added special tokens, no truncation or padding."""

    def __init__(self, path: str):
        self.by_words = drops_spaces(path)
        if path.endswith(".model"):
            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: self.model.encode(texts, num_threads=1)
        else:
            self.model = Tokenizer.from_file(path)
            self.model.no_truncation()
            self.model.no_padding()
            self.encode = lambda texts: self.model.encode_batch_fast(texts, add_special_tokens=False)
        self.forget()

    def forget(self):
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def lengths(self, texts: list[str]) -> np.ndarray:
        found = (len(ids) for first in range(0, len(texts), AT_ONCE) for ids in self.encode(texts[first : first + AT_ONCE]))
        return np.fromiter(found, np.int64, len(texts))

    def count(self, column: pa.Array) -> np.ndarray:
        """Counts of a string array without NULLs."""
        if not self.by_words:
            return self.lengths(column.to_pylist())
        data, offsets = text_bytes(column)
        starts, ends, first = words.spans(data, offsets)
        keys, seen, which = np.unique(words.hashes(data, starts, ends, lower=False), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > REMEMBERED:
            self.forget()
        new = ~np.isin(keys, self.keys, assume_unique=True)
        raw = data.tobytes()
        fresh = [raw[s:e].decode() for s, e in zip(starts[seen[new]].tolist(), ends[seen[new]].tolist(), strict=True)]
        at = np.searchsorted(self.keys, keys[new])
        self.keys, self.counts = np.insert(self.keys, at, keys[new]), np.insert(self.counts, at, self.lengths(fresh))
        total = np.concatenate([[0], np.cumsum(self.counts[np.searchsorted(self.keys, keys)][which])])
        return total[first[1:]] - total[first[:-1]]


@cache
def counter_of(path: str) -> TokenCounter:
    """One tokenizer for all tasks of a worker."""
    return TokenCounter(path)


def encoded(texts: DataFrame, path: str) -> DataFrame:
    """(digest, n_tokens) of rows (digest, text)."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, column in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([rows.column("digest"), pa.array(counter_of(path).count(column))], ["digest", "n_tokens"])

    return texts.mapInArrow(work, CACHE)


def count_tokens(docs: DataFrame, folder: str, vocabulary: str | None = None, limit=LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of `docs` (doc_id, text, any others).

    `folder` is the cache: a table of counts for each tokenizer digest, made if it is not there. The vocabulary is a file of
    `tokenizers` (.json) or `sentencepiece` (.model). NULL texts count as empty, empty texts have no tokens; a NULL doc_id
    is an id like any other; repeated rows come back as often as they occur and are encoded once; an empty table gives an
    empty table. Further columns are left out. Runs that fill a cache side by side may both append a count; it is read once.
    """
    spark = docs.sparkSession
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    folded = drops_spaces(path)
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text").withColumns(
        # The id that stands for NULL may also be a row's own: under one digest it is the same text.
        {"digest": content_digest(F.col("text"), folded), "carrier": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long"))}
    )
    rows = stored(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "digest", "carrier"), "content-digests")
    kinds = rows.groupBy("digest").agg(F.min("carrier").alias("carrier"), F.count(F.lit(1)).alias("n"))

    table = f"{folder}/{tokenizer_digest(path)}"
    spark.createDataFrame([], CACHE).write.mode("ignore").parquet(table)
    known = lambda: spark.read.schema(CACHE).parquet(table).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    misses = kinds.join(known(), "digest", "left_anti").select("digest", "carrier")
    # Texts travel once, under (digest, id), so that copies of one text do not meet in one task; equal rows are made one first.
    texts = docs.select("digest", "carrier", "text").dropDuplicates(["digest", "carrier"]).join(misses, ["digest", "carrier"])
    encoded(texts.select("digest", "text"), path).write.mode("append").parquet(table)

    counted = stored(kinds.drop("carrier").join(known(), "digest"), "token-counts")
    found = attach_counted(rows, counted, "digest", rows.count())
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
