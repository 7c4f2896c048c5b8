import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from faultframe.llm import tokens

ODD = [
    "", " ", "\n\t", "a", "Hello  World", "don't we'll I'M", "x<|endoftext|>y <|startoftext|>", "<|ENDOFTEXT|> <|end of text|>",
    "é É H̱ İ", " ́abc", "a b c\u0085d\u000bE\u000cF", "Σας ΣΑΣ", "12 345 ½ ²", "😀 👩‍👩‍👧 🇩🇪", "日本語 テキスト", "...!!! a.b,c",
    "﻿x ‍ \u0000y", "ß ẞ ﬁ K Å",
]


def plain(texts, name=tokens.VOCABULARY):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        return [len(i) for i in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    return [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_words_add_up_as_in_the_library():
    draw = random.Random(5)
    marks = [c for text in ODD for c in text] + list(" \n\t\r ABCxyz'<|>̱́̇")
    texts = ODD + ["".join(draw.choices(marks, k=draw.randrange(1, 60))) for _ in range(2000)]
    counter = tokens.TokenCounter(public_tokenizers.path(tokens.VOCABULARY))
    assert counter.by_words
    for part in (texts[:700], texts[700:]):
        assert counter.count(pa.array(part)).tolist() == plain(part)


def test_white_space_is_folded_only_where_it_is_dropped():
    assert tokens.drops_spaces(public_tokenizers.path("word_bpe_49k.json"))
    assert not tokens.drops_spaces(public_tokenizers.path("byte_bpe_50k.json"))
    assert not tokens.drops_spaces(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_match_the_library(spark, documents, rows, tmp_path, name):
    texts = [*ODD[:15], "word " * 30_000, None, "Hello World", "Hello  World", "Hello World"]
    docs = documents(*enumerate(texts), (3, texts[3]), (None, "null id"), (None, None))
    got = rows(tokens.count_tokens(docs, str(tmp_path), public_tokenizers.path(name)).na.fill(-1, ["doc_id"]))
    given = [*enumerate(texts), (3, texts[3]), (-1, "null id"), (-1, None)]
    counts = plain([t or "" for _, t in given], name)
    assert got == sorted((i, len((t or "").encode()), n, n > 2048) for (i, t), n in zip(given, counts, strict=True))


def test_only_distinct_misses_are_encoded(spark, documents, rows, tmp_path):
    folder = str(tmp_path)
    first = documents((1, "one two"), (2, " one\n two "), (3, "three"))
    tokens.count_tokens(first, folder).collect()
    table = f"{folder}/{tokens.tokenizer_digest(public_tokenizers.path(tokens.VOCABULARY))}"
    assert spark.read.parquet(table).count() == 2
    # What the cache says holds, so a stored count shows in the result.
    known = spark.createDataFrame([("known", 999)], "text string, n_tokens long")
    known.select(tokens.content_digest(F.col("text"), True).alias("digest"), "n_tokens").write.mode("append").parquet(table)
    got = rows(tokens.count_tokens(documents((1, "known"), (2, "one two"), (4, "four"), (5, "four")), folder), "doc_id", "n_tokens")
    assert got == [(1, 999), (2, 2), (4, 1), (5, 1)]
    assert spark.read.parquet(table).count() == 4


def test_empty_table_and_further_columns(spark, documents, tmp_path):
    assert tokens.count_tokens(documents().limit(0), str(tmp_path)).count() == 0
    odd = documents((1, "a b")).selectExpr("doc_id", "text", "'x' AS digest", "1 AS n_tokens", "2 AS n", "3 AS carrier", "4 AS n_bytes")
    assert [tuple(r) for r in tokens.count_tokens(odd, str(tmp_path)).collect()] == [(1, 3, 2, False)]


def test_frequent_texts_and_many_rows(spark, rows, tmp_path):
    docs = spark.range(30_000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'the same text', concat('text ', id)) AS text")
    got = tokens.count_tokens(docs, str(tmp_path))
    texts = ["the same text" if i % 3 == 0 else f"text {i}" for i in range(30_000)]
    assert rows(got, "doc_id", "n_tokens") == list(enumerate(plain(texts)))
