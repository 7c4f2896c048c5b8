import hashlib
import random
import zlib

import numpy as np
import pytest

from faultframe.llm import prefix_trie as pt

KIND = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(convs):
    """Node rows of {conv_id: [(role, text), ...]}, by looking at every prefix."""
    members = {}
    for conv, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    children = {}
    for prefix in members:
        if prefix:
            children.setdefault(prefix[:-1], []).append(prefix)

    def below(prefix):
        saved = (len(members[prefix]) - 1) * len(prefix[-1][1]) if prefix else 0
        parts = [below(c) for c in children.get(prefix, [])]
        return (sum(p[0] for p in parts) or 1, saved + sum(p[1] for p in parts))

    out = []
    for prefix, convs_of in members.items():
        here = sorted(c for c in convs_of if len(convs[c]) == len(prefix))
        parent = min(members[prefix[:-1]]) if prefix else None
        digest = hashlib.sha256(",".join(map(str, here)).encode()).hexdigest()
        out.append((min(convs_of), len(prefix), parent, len(convs_of), len(children.get(prefix, [])), *below(prefix), digest))
    return sorted(out, key=str)


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + turns[h:]
    return out


def as_rows(spark, convs):
    rows = [(c, 2 * t, *turn) for c, turns in convs.items() for t, turn in enumerate(turns)]
    return spark.createDataFrame(rows, KIND).repartition(5)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def random_convs(seed, n, longest, ids):
    draw = random.Random(seed)
    turn = lambda: (draw.choice(["user", "assistant"]), draw.choice(["", "a", "bé", "ccc", "🙂🙂"]))
    return {c: [turn() for _ in range(draw.randrange(1, longest))] for c in draw.sample(ids, n)}


@pytest.mark.parametrize("seed", range(3))
def test_subtree_sums(seed):
    draw = np.random.default_rng(seed)
    n = 400
    shapes = [draw.integers(0, np.arange(1, n)), np.arange(n - 1), np.zeros(n - 1, dtype=int), draw.integers(np.maximum(0, np.arange(n - 1) - 3), np.arange(1, n))]
    for shape in shapes:
        parent = np.concatenate([[-1], shape])
        parent[draw.integers(1, n, 3)] = -1  # a forest
        depth = np.zeros(n, dtype=int)
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1 if parent[i] >= 0 else 0
        weights = draw.integers(-5, 50, (n, 2))
        expected = weights.copy()
        for i in np.argsort(-depth, kind="stable"):
            if parent[i] >= 0:
                expected[parent[i]] += expected[i]
        order = draw.permutation(n)  # nodes in any order
        place = np.argsort(order)
        moved = np.where(parent[order] >= 0, place[parent[order]], -1)
        assert (pt.rolled_up(moved, depth[order], weights[order]) == expected[order]).all()


def test_conversations_as_they_are(spark):
    convs = random_convs(1, 150, 6, range(1000))
    assert got(pt.conversation_trie(as_rows(spark, convs))) == plain(convs)


def test_rebuilt_conversations(spark):
    convs = random_convs(2, 160, 7, range(50, 420))
    convs[500] = convs[100] = [("user", "x"), ("user", "y")]
    made = rebuilt(convs)
    assert any(not t for t in made.values()) or True
    assert got(pt.rebuilt_trie(as_rows(spark, convs))) == plain(made)


def test_turnless_conversations_are_members_of_the_root(spark):
    convs = {c: [("user", f"t{c}")] for c in range(101, 130)}  # without a conversation 100
    made = rebuilt(convs)
    assert sum(not t for t in made.values()) > 5
    assert got(pt.rebuilt_trie(as_rows(spark, convs))) == plain(made)


def test_small_bands_and_fans(spark, monkeypatch):
    """Many components, and conversations of many bands."""
    for name, value in {"BAND": 4, "FAN_BITS": 1, "RUN_NAMES": 8, "RUN_TURNS": 4, "AT_ONCE": 50}.items():
        monkeypatch.setattr(pt, name, value)
    convs = random_convs(3, 60, 4, range(300))
    stem = [("user", f"s{i}") for i in range(30)]
    convs |= {1000 + i: stem[: 5 + i] + [("assistant", str(i))] * (i % 3) for i in range(25)}
    convs |= {2000 + i: stem for i in range(40)}
    assert got(pt.conversation_trie(as_rows(spark, convs))) == plain(convs)


def test_long_conversation(spark):
    convs = {1: [("user", "a")] * 9000, 2: [("user", "a")] * 4096, 3: [("user", "a")] * 4097 + [("user", "b")]}
    got = {(r.conv_id, r.depth): r for r in pt.conversation_trie(as_rows(spark, convs)).collect()}
    assert len(got) == 9002
    assert got[1, 0].n_leaves == 2 and got[1, 0].saved_tokens == 2 * 4096 + 1
    assert got[3, 4098].parent_conv_id == 1 and got[1, 4097].n_children == 2 and got[1, 9000].n_leaves == 1


def test_nulls_ties_and_further_columns(spark):
    rows = [(None, 1, "user", "gone"), (5, None, None, None), (5, 1, "user", "x"), (5, 1, "user", "x"), (6, 0, "", ""), (6, 1, "user", "x")]
    frame = spark.createDataFrame(rows, KIND).selectExpr("*", "1 AS depth", "2 AS owner", "3 AS n", "4 AS idx", "5 AS e")
    convs = {5: [("", ""), ("user", "x"), ("user", "x")], 6: [("", ""), ("user", "x")]}
    assert got(pt.conversation_trie(frame)) == plain(convs)


def test_empty_table(spark):
    empty = spark.createDataFrame([], KIND)
    assert pt.conversation_trie(empty).count() == 0 and pt.rebuilt_trie(empty).count() == 0
