import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultframe.llm import decontamination as dc


def split(text):
    return re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


MASKS = ("11111", "1110011", "1101101", "10110101", "110001011", "1010100101")


def holds(equal, enough):
    """Whether some stretch with `enough` equal words is positive from both ends (+1 for equal, -2 for other words)."""
    for a in range(len(equal)):
        total, equals, low = 0, 0, 1
        for b in range(a, len(equal)):
            total += 1 if equal[b] else -2
            equals += bool(equal[b])
            if total <= 0:
                break
            tail, ok = 0, True
            if equals >= enough:
                for c in range(b, a - 1, -1):
                    tail += 1 if equal[c] else -2
                    if tail <= 0:
                        ok = False
                        break
                if ok:
                    return True
    return False


def by_hand(docs, items):
    """Pairs whose words overlap well enough on an alignment that a seed can see."""
    found, low = set(), {}
    for item_id, text in sorted(items, key=str):
        if item_id is not None:
            low.setdefault(tuple(split(text)), item_id)
    for doc_id, text in docs:
        w = split(text)
        for item, item_id in low.items():
            for shift in range(-len(item) + 1, len(w)):
                at = [j for j in range(len(item)) if 0 <= shift + j < len(w)]
                equal = [w[shift + j] == item[j] for j in at]
                seen = any(all(equal[s + k] for k, c in enumerate(m) if c == "1") for m in MASKS for s in range(len(equal) - len(m) + 1))
                if seen and holds(equal, min(12, 0.75 * len(item))):
                    found.add((doc_id, item_id))
    return found


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: [rng.choice("the of and to in".split()) if rng.random() < 0.4 else f"w{rng.randrange(300)}" for _ in range(n)]
    items = [(k, text(rng.choice([3, 5, 8, 15, 30]))) for k in range(12)]
    docs = []
    for k in range(50):
        w = text(rng.choice([0, 10, 40, 120]))
        if k % 2:
            passage = list(rng.choice(items)[1])
            for _ in range(rng.choice([0, 1, len(passage) // 5, len(passage) // 2])):
                passage[rng.randrange(len(passage))] = f"x{rng.randrange(99)}"
            passage = passage[rng.choice([0, 0, 2]) :]
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage
        docs.append((k, rng.choice([" ", ", ", "*\n"]).join(w).title()))
    return docs, [(k, " ".join(w)) for k, w in items]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, documents, seed):
    docs, items = corpus(seed)
    docs += [(100, None), (101, ""), (102, docs[1][1]), (102, docs[1][1]), (None, docs[3][1]), (103, "the " * 3000)]
    items += [(500, items[0][1]), (None, docs[0][1]), (501, None), (502, "")]
    got = dc.leaks(documents(*docs).withColumn("key", F.lit("clash")), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == by_hand(docs, items)
    words = dict(docs)
    for r in got:
        assert 0 <= r.start_word and r.start_word + r.n_words <= len(split(words[r.doc_id])) and r.n_equal <= r.n_words


def test_stretches_against_all_stretches():
    """Every stretch that is positive from both ends lies in one of those found, and those are such stretches."""
    rng = random.Random(2)
    value = lambda e: [1 if x else -2 for x in e]
    for _ in range(300):
        equal = [rng.random() < rng.choice([0.6, 0.8]) for _ in range(rng.randrange(1, 30))]
        v = value(equal)
        good = [
            (a, b) for a in range(len(v)) for b in range(a + 1, len(v) + 1)
            if all(sum(v[a:c]) > 0 for c in range(a + 1, b + 1)) and all(sum(v[c:b]) > 0 for c in range(a, b))
        ]
        maximal = [(a, b) for a, b in good if not any((c, d) != (a, b) and c <= a and b <= d for c, d in good)]
        assert dc.stretches(np.array(equal)) == [(a, b, sum(equal[a:b])) for a, b in maximal]


def test_a_later_stretch_counts_too(spark, documents):
    words = [f"q{k}" for k in range(40)]
    text = words[:11] + [f"x{k}" for k in range(9)] + words[20:26] + ["y"] + words[27:33]
    got = dc.leaks(documents((1, " ".join(text))), spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(1, 9, 20, 13, 12)]


def test_very_long_text(spark, documents):
    passage = " ".join(f"q{k}" for k in range(20))
    text = "the of and " * 60_000 + passage + " a b" * 60_000
    got = dc.leaks(documents((1, text)), spark.createDataFrame([(9, passage)], "item_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(1, 9, 180_000, 20, 20)]


def test_cleaning_keeps_columns_and_clean_rows(spark, documents):
    passage = " ".join(f"q{k}" for k in range(20))
    docs = documents((1, f"a b {passage} c"), (2, "a b c"), (2, "a b c"), (3, None), (None, passage))
    kept = dc.clean(docs, spark.createDataFrame([(9, passage)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 2, 3]
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.clean(docs, none).count() == 5 and dc.leaks(documents(), none).count() == 0
