import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from faultframe.llm import language as lg

PATH = public_tokenizers.path(lg.VOCABULARY)


def model(languages=("aa", "bb")):
    rng = np.random.default_rng(4)
    table = rng.random((len(lg.pieces(PATH).names), len(languages))) ** 8
    return lg.Model(list(languages), table / table.sum(axis=0), PATH)


def segmentations(word):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        for rest in segmentations(word[n:]):
            yield [word[:n], *rest]


def by_hand(m, word):
    at = {p: i for i, p in enumerate(lg.pieces(PATH).names)}
    total = np.zeros(len(m.languages))
    counts = np.zeros_like(m.probabilities)
    for parts in segmentations(" " + word):
        if all(p in at or len(p) == 1 for p in parts):
            p = np.prod([m.probabilities[at[p]] if p in at else np.full(len(m.languages), lg.UNKNOWN) for p in parts], axis=0)
            total += p
            for part in parts:
                if part in at:
                    counts[at[part]] += p
    return total, counts / total


@pytest.mark.parametrize("word", ["a", "the", "straße", "international", "жук", "\U0001d51e\U0001d51f", "日本"])
def test_all_segmentations_are_summed(word):
    m = model()
    points = np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32)
    starts, lengths = np.array([0]), np.array([len(points)])
    total, counts = by_hand(m, word)
    assert np.allclose(lg.likelihoods(m, points, starts, lengths)[0], np.log(total))
    got = lg.expected_counts(m, points, starts, lengths, np.array([1]), np.array([3.0]))
    assert np.allclose(got[:, 1], 3 * counts[:, 1]) and not got[:, 0].any()


def test_runs_of_letters():
    points, first = lg.lettered(["Ab, C1d", "", "x" * 70])
    starts, lengths = lg.runs(points)
    spelled = ["".join(map(chr, points[a : a + n])) for a, n in zip(starts, lengths, strict=True)]
    assert spelled == ["ab", "c", "d", "x" * 32, "x" * 32, "x" * 6]
    assert np.searchsorted(first, starts, "right").tolist() == [1, 1, 1, 3, 3, 3]


def test_held_out_accuracy_and_odd_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(10_001, None), (10_002, ""), (10_003, "12 .. 7"), (None, "der die das und"), (10_004, "the " * 100_000)], "doc_id long, text string")
    model = lg.fit(docs.where(~lg.held_out()), sample_docs=60, rounds=3)
    tested = docs.select("doc_id", "text", "lang").unionByName(odd, allowMissingColumns=True).withColumn("score", F.lit("clash"))
    got = lg.predict(tested, model).withColumn("held", lg.held_out()).collect()
    assert len(got) == docs.count() + 5 and all(0 <= r.score <= 1 for r in got)
    held = [r.lang == r.lang_pred for r in got if r.held and r.lang]
    assert sum(held) / len(held) > 0.97
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by[10_001] == by[10_002] == by[10_003] == ("und", 0.0)
    assert by[10_004][0] == "en" and by[None][0] == "de"


def test_nothing_to_learn_from(documents):
    docs = documents((1, "abc"), (2, None))
    model = lg.fit(docs.limit(0))
    assert [r.lang_pred for r in lg.predict(docs, model).collect()] == ["und", "und"]
    assert lg.predict(docs.limit(0), model).count() == 0


def test_marks_alone_are_no_language(documents):
    m = model()
    rows = [(1, "́̂"), (2, "्"), (3, "12 ́"), (4, "é"), (5, "́ a")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in lg.predict(documents(*rows), m).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] != "und" and got[5][0] != "und"


def test_noise_and_unlearned_languages_are_not_recognised(spark, documents):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fitted = lg.fit(docs.where(~lg.held_out()), sample_docs=60, rounds=3)
    rng = np.random.default_rng(1)
    word = lambda letters, n: "".join(rng.choice(list(letters), n))
    noise = " ".join(word("qxzjkwvbcdfgh", 9) for _ in range(80))
    greek = " ".join(word("αβγδεζηθικλμνξοπρστυ", 6) for _ in range(80))
    known = docs.where("lang is not null and length(text) > 200").select("doc_id", "text").limit(40)
    kept = lg.recognised(known.unionByName(documents((-1, noise), (-2, greek), (-3, None), (-4, "12")).select("doc_id", "text")), fitted)
    found = {r.doc_id for r in kept.collect()}
    assert not found & {-1, -2, -3, -4} and len(found) >= 39
    assert kept.columns == ["doc_id", "text"]
