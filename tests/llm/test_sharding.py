import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from faultframe.llm import queries, sharding


def test_growth_moves_rows_only_into_the_new_shard(spark):
    rows = sharding.assigned(spark.range(20_000).withColumnRenamed("id", "doc_id")).collect()
    assert all(r.grown_shard in (r.shard, 8) for r in rows)
    moved = sum(r.grown_shard == 8 for r in rows)
    assert abs(moved - 20_000 / 9) < 250
    assert all(abs(n - 2500) < 250 for n in Counter(r.shard for r in rows).values()) and {r.shard for r in rows} == set(range(8))


def test_weights_are_followed(spark):
    rows = sharding.assigned(spark.range(20_000).withColumnRenamed("id", "doc_id"), shards=3, weights=[1, 3, 0], grown_weight=4).collect()
    share = Counter(r.shard for r in rows)
    assert abs(share[0] - 5000) < 300 and share[2] == 0
    assert all(r.grown_shard in (r.shard, 3) for r in rows) and abs(sum(r.grown_shard == 3 for r in rows) - 10_000) < 400


@pytest.mark.parametrize("run_rows", [10, 100_000])
def test_slots_are_gapless(spark, documents, monkeypatch, run_rows):
    monkeypatch.setattr(sharding, "RUN_ROWS", run_rows)
    docs = documents(*[(i, "x" * (i % 9)) for i in range(300)], *[(7, "same")] * 400, (None, "n"), (None, None), (9, None))
    got = sharding.with_slots(sharding.assigned(docs.withColumn("shard", F.lit("clash"))).select("doc_id", "text", "shard")).collect()
    assert len(got) == 703
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert len({r.shard for r in got if r.doc_id == 7}) == 1
    assert sharding.with_slots(sharding.assigned(documents()).select("doc_id", "shard")).count() == 0


def test_query_matches_every_shard_tried_in_turn(spark, documents, tmp_path):
    """The shard of a key is that of the highest hash of (key, shard); all of the query's columns by hand."""
    rows = [*[(i, f"text é {i}" * (i % 5)) for i in range(200)], (7, "again"), (7, "again"), (8, None), (None, "no id"), (None, None), (-5, "")]
    documents(*rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op9_sharding"](spark, str(tmp_path)).collect()
    keys = spark.createDataFrame([(i, s) for i in {i for i, _ in rows} for s in range(9)], "k long, s int")
    scored = keys.select("k", "s", sharding.unit("k", "s").alias("score")).collect()
    best = lambda k, n: max((r.score, r.s) for r in scored if r.k == k and r.s < n)[1]
    expected = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", best(i, 8), best(i, 9)) for i, t in rows]
    assert sorted(((r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in got), key=str) == sorted(expected, key=str)
    for shard in range(8):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
