import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultframe.llm import jaccard
from faultframe.llm.shared import slices


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def expected(rows):
    sets = {k: grams(t) for k, (i, t) in enumerate(rows) if i is not None}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    out = []
    for k, (i, t) in enumerate(rows):
        same = [rows[j][0] for j in sets if i is not None and root(j) == root(k)]
        out.append((i, len(grams(t)), min(same) if same and sets[k] else i))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("the of und de la in on at to it".split()) + str(rng.randrange(60))
    text = lambda n: [word() for _ in range(n)]
    bases = [text(rng.choice([1, 2, 4, 5, 6, 8, 12, 40, 150])) for _ in range(25)]
    common = text(40)
    rows = []
    for _ in range(160):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            edit = rng.randrange(3)
            at = rng.randrange(len(w) + 1)
            if edit == 0:
                w.insert(at, word())
            elif edit == 1 and at < len(w):
                w[at] = word()
            elif at < len(w):
                del w[at]
        if rng.random() < 0.2:
            w = w[:10] + common
        rows.append((rng.randrange(10**6), rng.choice([" ", "\n", "\x0b "]).join(w).title() if rng.random() < 0.5 else " ".join(w)))
    chain = text(60)
    for k in range(20):  # each links only with its neighbours
        rows.append((2_000_000 - k, " ".join(chain[k * 2 :] + [f"c{j}" for j in range(k * 2)])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(documents, seed):
    rows = [*corpus(seed), (5, None), (6, ""), (7, " \n"), (None, "a b c d e f"), (None, None), (8, "a b c d e f"), (8, "a b c d e f")]
    got = jaccard.classes(documents(*rows).withColumn("sid", F.lit("clash"))).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_no_links_and_empty_table(documents):
    assert jaccard.classes(documents()).count() == 0
    rows = [(1, "a b c d e f g"), (2, "q r s t u v"), (3, None)]
    assert sorted(map(tuple, jaccard.classes(documents(*rows)).collect())) == [(1, 3, 1), (2, 2, 2), (3, 0, 3)]


def test_longer_prefixes_lose_no_link(documents, monkeypatch):
    monkeypatch.setattr(jaccard, "ROW_COST", 0.0)
    rows = corpus(3)
    assert sorted(map(tuple, jaccard.classes(documents(*rows)).collect()), key=str) == expected(rows)


def test_candidates_without_hubs(documents, monkeypatch):
    """Every link can be found by the prefixes alone."""
    none = lambda shared, marks: shared.select(F.col("sid").alias("a"), F.col("sid").alias("b")).limit(0)
    monkeypatch.setattr(jaccard, "hub_pairs", none)
    rows = corpus(4)
    assert sorted(map(tuple, jaccard.classes(documents(*rows)).collect()), key=str) == expected(rows)


def test_a_round_that_leaves_most_meetings_open_is_the_last(documents, monkeypatch):
    """Even if all its comparisons link."""
    passages = [[f"p{k}w{j}" for j in range(12)] for k in range(12)]
    long = [f"x{j}" for j in range(60)]
    pair = [" ".join(long), " ".join([*long[:-1], "y"])]
    rows = [(20, pair[0]), (10, pair[1]), *[(30 + k, " ".join(passages[k] + passages[k - 1])) for k in range(12)]]
    docs, turns = documents(*rows), []
    a, b = jaccard.set_ids(*jaccard.shingle_sets(pa.array(pair))).tolist()

    def further(*given):
        turns.append(given[-1])
        return docs.sparkSession.createDataFrame([(a, b)], "a long, b long")

    monkeypatch.setattr(jaccard, "CROWD", 0)
    monkeypatch.setattr(jaccard, "further_hub_pairs", further)
    assert sorted(map(tuple, jaccard.classes(docs).collect()), key=str) == expected(rows)
    assert turns == [0]


def test_sketches_bound_the_difference():
    rng = random.Random(9)
    for n in (1, 30, 700):
        sets = [np.array(sorted(rng.getrandbits(64) for _ in range(n)), dtype=np.uint64) for _ in range(2)]
        sets.append(np.sort(np.concatenate([sets[0][: n // 2], sets[1][: n // 3]])))
        marks = jaccard.sketches(np.concatenate(sets), np.cumsum([0, *map(len, sets)])).view(np.uint8)
        for i in range(3):
            for j in range(3):
                differing = int(np.unpackbits(marks[i] ^ marks[j]).sum())
                assert differing <= len(set(sets[i].tolist()) ^ set(sets[j].tolist())) and (i != j or differing == 0)


def test_one_of_each_keeps_a_document_of_every_class(documents):
    a, b = "a1 a2 a3 a4 a5 a6 a7", "b1 b2 b3 b4 b5 b6 b7"
    rows = [(1, a), (1, b), (2, b), (3, a.upper()), (4, None), (4, None), (None, a), (5, " "), (6, "c d"), (6, "C d"), (6, "c d")]
    got = sorted(((r.doc_id, r.text) for r in jaccard.one_of_each(documents(*rows)).collect()), key=str)
    assert got == sorted([(1, a), (1, b), (4, None), (4, None), (None, a), (5, " "), (6, "C d")], key=str)
    docs = documents(*rows).withColumns({"sid": F.lit(1), "label": F.lit("x"), "lowest": F.lit(2)})
    assert jaccard.one_of_each(docs).columns == docs.columns and jaccard.one_of_each(docs).count() == 7


def test_very_long_texts(documents):
    rng = random.Random(10)
    long = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    near = [w if rng.random() < 0.99 else "x" for w in long]
    rows = [(3, " ".join(long)), (2, " ".join(near)), (1, " ".join(long[:40_000]))]
    assert sorted(map(tuple, jaccard.classes(documents(*rows)).collect()), key=str) == expected(rows)


def test_few_links_of_many_tasks_are_one_file(spark, documents):
    texts = [[f"t{k}w{j}" for j in range(400)] for k in range(60)]
    rows = [x for k, t in enumerate(texts) for x in ((2 * k, " ".join(t)), (2 * k + 1, " ".join([*t, "more"])))]
    docs = documents(*rows)
    info = jaccard.described(docs).where("block is null")
    sids = {r.doc_id: r.sid for r in info.collect()}
    pairs = spark.createDataFrame([(sids[2 * k], sids[(2 * k + d) % 120]) for k in range(60) for d in (1, 2)], "a long, b long")
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "8k", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        links = jaccard.verified(docs, info, pairs)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len([f for f in links.inputFiles() if spark.read.parquet(f).count()]) == 1
    near = {(sids[2 * k], sids[2 * k + 1]) for k in range(60)}
    assert sorted(map(tuple, links.collect())) == sorted(near | {(b, a) for a, b in near})


def test_shingles_are_made_and_counted_in_little_memory():
    rng = random.Random(12)
    text = " ".join(f"w{rng.randrange(10**5)}" for _ in range(400))
    batch = pa.RecordBatch.from_arrays([pa.array([text] * 1000)], ["text"])
    counts, n = np.zeros(1 << jaccard.COUNTER_BITS, dtype=np.uint32), 0
    tracemalloc.start()
    try:
        for _, column in slices([batch], "text", jaccard.SLICE):
            found, _ = jaccard.shingle_sets(column)
            jaccard.count_in(counts, found)
            n += len(found)
        assert tracemalloc.get_traced_memory()[1] < 24e6
    finally:
        tracemalloc.stop()
    assert counts.sum() == n == 1000 * len(grams(text))
