import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from faultframe.llm import jaccard
from test_decontamination import by_hand as leaks_by_hand
from test_jaccard import expected as classes_by_hand
from test_packing import tokenizer
from test_pii import by_hand as spans_by_hand


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Real documents with a planted case for each stage, and the benchmark of the small tables."""
    path = str(tmp_path_factory.mktemp("corpus"))
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet").where("doc_id < 60")
    rows = [tuple(r) for r in docs.collect()]
    benchmark = [tuple(r) for r in spark.read.parquet(f"{source}/benchmark.parquet").collect()]
    long = next(r for r in rows if len(r[1].split()) > 200 and "@" not in r[1])
    words = long[1].split(" ")
    near = " ".join([*words[:50], "changed", *words[51:]])
    extra = [
        (1000, near, "en", "s", 1), (1001, "12 34 !", "en", "s", 7), (1002, None, None, None, None), (1003, "", "en", "s", 0),
        (1004, f"{long[1][:400]} {benchmark[0][1]}", "en", "s", 1), (1005, "the mail of tom is tom@x.example and +1 689 555 4072", "en", "s", 1),
    ]
    spark.createDataFrame(rows + extra, docs.schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows + extra, benchmark


def test_stages_against_brute_force(spark, folder):
    path, rows, benchmark = folder
    texts = {r[0]: r[1] for r in rows}
    pieces = corpus_pipeline.run(spark, path, f"{path}/stages").collect()
    at = {}
    for name, _ in corpus_pipeline.STAGES[:4]:
        docs = spark.read.parquet(f"{path}/stages/{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        at[name] = docs.collect()

    first = {r.doc_id for r in at["language_id"]}
    assert first == {i for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    classes = {i: c for i, _, c in classes_by_hand([(i, texts[i]) for i in first])}
    second = {r.doc_id for r in at["near_duplicates"]}
    assert second == {i for i in first if classes[i] == i} and 1000 not in second
    leaked = {i for i, _ in leaks_by_hand([(i, texts[i]) for i in second], benchmark)}
    third = {r.doc_id for r in at["decontaminated"]}
    assert third == second - leaked and 1004 in leaked
    clean = {r.doc_id: r for r in at["sanitised"]}
    assert set(clean) == third
    for i, r in clean.items():
        assert r.n_chars == len(r.text) and not spans_by_hand(r.text)
        if not spans_by_hand(texts[i]):
            assert r.text == texts[i]
    for i, r in clean.items():
        assert sum(p.length for p in pieces if p.doc_id == i) == len(tokenizer().encode(r.text, add_special_tokens=False).ids) + 1
    assert len({(p.sequence_id, p.offset) for p in pieces}) == len(pieces) and {p.doc_id for p in pieces} == third


def test_extra_columns_and_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1)).withColumn("sid", F.lit(0))
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, folder[0]).columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder[0]).count() == 0


def test_repeated_rows(spark, documents):
    docs = documents((1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None), (3, None), (None, "a b c d e f"))
    assert sorted((str(r.doc_id) for r in jaccard.one_of_each(docs).collect())) == ["1", "3", "3", "None"]
