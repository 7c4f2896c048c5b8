import random

from faultframe.llm import graph


def test_components_against_brute_force(spark):
    rng = random.Random(11)
    edges = {(rng.randrange(120), rng.randrange(120)) for _ in range(70)} | {(500 + k, 501 + k) for k in range(40)} | {(7, 7)}
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    both = spark.createDataFrame(sorted(edges | {(b, a) for a, b in edges}), "a long, b long")
    assert {r.node: r.label for r in graph.components(both).collect()} == label
    assert graph.components(both.limit(0)).count() == 0


def test_a_star_takes_two_tables(spark, monkeypatch):
    """The first labels, and a round that leaves them as they are."""
    names, stored = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: names.append(name) or stored(df, name))
    star = [(0, k) for k in range(1, 9)]
    both = spark.createDataFrame(star + [(b, a) for a, b in star], "a long, b long")
    assert {tuple(r) for r in graph.components(both).collect()} == {(k, 0) for k in range(9)}
    assert names == ["labels", "labels"]
