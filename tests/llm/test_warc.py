import gzip
import hashlib
import zlib

import pytest

from faultframe.llm import warc

PAGES = [
    (1, "http://a/1", "x" * 1000), (2, "http://a/2", "x" * 1000), (5, "http://a/5", "x" * 1000), (3, None, "short"), (4, "http://a/\r\nX: y", "short"),
    (6, "u", None), (7, "u", ""), (8, "u", "é" * 500), (9, "u", "é" * 500), (10, "u", "é" * 499), (11, "u", "é" * 499), (None, "u", "x" * 1000),
    (12, "u", "a\r\n\r\nb" * 100_000), (13, "u", "twice" * 300), (13, "u", "twice" * 300), (12 + 2**40, "u", "a\r\n\r\nb"),
]


@pytest.fixture
def archive(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    warc.write(warc.page_records(pages), f"file://{tmp_path}/w")
    return f"file://{tmp_path}/w"


def expected():
    for i, _, html in PAGES:
        data = (html or "").encode()
        ids = [j for j, _, h in PAGES if (h or "").encode() == data and j is not None]
        again = i is not None and len(data) >= 1000 and i < max(ids)
        yield i, "revisit" if again else "response", max(ids) if again else None, len(data), hashlib.sha1(data).hexdigest(), None if again else data


def test_round_trip(spark, archive):
    number = lambda s: int(s.rsplit(":", 1)[1]) if s else None
    got = [(number(r.record_id), r.record_type, number(r.refers_to), r.payload_length, r.payload_digest[5:], None if r.payload is None else bytes(r.payload)) for r in warc.read(spark, archive).collect()]
    assert sorted(got, key=str) == sorted(expected(), key=str)


def test_predicates_are_pushed_down_and_payloads_stay_unread(spark, archive, monkeypatch):
    frame = warc.read(spark, archive, "record_type string, record_id string").where("record_type = 'revisit'")
    assert sorted(r.record_id for r in frame.collect()) == ["urn:page:1", "urn:page:2", "urn:page:8"]
    from pyspark.sql.datasource import EqualTo, GreaterThan
    from pyspark.sql.types import StructType

    reader = warc.WarcReader(StructType.fromDDL("record_type string, payload binary"), archive, 1 << 20)
    other = GreaterThan(("payload_length",), 5)
    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit"), other])) == [other]

    def untouched(self):
        raise AssertionError("a payload was decoded")

    monkeypatch.setattr(warc.Member, "content", untouched)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(rows) == 3


def test_every_member_is_a_gzip_file_of_its_own(spark, archive, tmp_path):
    names = [p for p in (tmp_path / "w").iterdir() if p.suffix == ".gz"]
    assert sum(gzip.decompress(p.read_bytes()).count(b"WARC/1.1\r\nWARC-Type") for p in names) == len(PAGES)


@pytest.mark.parametrize("kind", ["plain", "gzip"])
def test_foreign_archives(spark, tmp_path, kind):
    records = [warc.record_bytes({"record_id": f"r{k}", "record_type": t, "payload": b"p" * k * 5000}, "d") for k, t in enumerate(["warcinfo", "response", "metadata"])]
    data = b"".join(records) if kind == "plain" else b"".join(gzip.compress(r) for r in records)
    (tmp_path / ("a.warc" if kind == "plain" else "a.warc.gz")).write_bytes(data)
    rows = warc.read(spark, str(tmp_path)).collect()
    assert [(r.record_id, len(r.payload)) for r in rows] == [("r0", 0), ("r1", 5000), ("r2", 10_000)]
    assert [r.record_id for r in warc.read(spark, str(tmp_path), "record_id string, record_type string").where("record_type in ('response', 'metadata')").collect()] == ["r1", "r2"]


def test_empty_table_and_uncommitted_files(spark, archive, tmp_path):
    (tmp_path / "w" / "part-lost.warc.gz").write_bytes(warc.member(warc.record_bytes({"record_id": "lost"}, "d")))
    assert warc.read(spark, archive).count() == len(PAGES)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(warc.page_records(none), f"file://{tmp_path}/none")
    assert warc.read(spark, f"file://{tmp_path}/none").count() == 0


def test_member_lengths():
    m = warc.member(b"abc" * 999)
    assert zlib.decompress(m, 31) == b"abc" * 999 and int.from_bytes(m[16:20], "little") == len(m)


FOREIGN = (
    b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:a>\r\ncontent-length: 5\r\nCONTENT-type: text/plain\r\n"
    b"WARC-Concurrent-To: <urn:x>\r\nWARC-Concurrent-To: <urn:y>\r\nX-Long: one\r\n two\r\n\r\nhello\r\n\r\n"
    b"WARC/1.0\r\nWARC-TYPE: request\r\nwarc-record-id: <urn:b>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
)


@pytest.mark.parametrize("packed", [False, True])
def test_field_names_have_no_case_and_repeated_fields_stay(spark, tmp_path, packed):
    parts = FOREIGN.partition(b"hello\r\n\r\n")
    data = gzip.compress(parts[0] + parts[1]) + gzip.compress(parts[2]) if packed else FOREIGN
    (tmp_path / ("a.warc.gz" if packed else "a.warc")).write_bytes(data)
    got = sorted(warc.read(spark, f"file://{tmp_path}").collect(), key=lambda r: r.record_id)
    assert [(r.record_type, r.record_id, r.content_type, bytes(r.payload)) for r in got] == [
        ("response", "<urn:a>", "text/plain", b"hello"), ("request", "<urn:b>", None, b"abc"),
    ]
    assert got[0].headers["warc-concurrent-to"] == "<urn:x>\n<urn:y>" and got[0].headers["x-long"] == "one two"
    assert [r.record_id for r in warc.read(spark, f"file://{tmp_path}").where("record_type = 'request'").collect()] == ["<urn:b>"]


@pytest.mark.parametrize("header", [b"Content-Length: x", b"Content-Length: -1", b"Other: 5", b"Content-Length: 5\r\ncut"])
def test_bad_lengths_are_an_error(spark, tmp_path, header):
    end = b"" if header.endswith(b"cut") else b"\r\n\r\nhello\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: response\r\n" + header + end)
    with pytest.raises(Exception, match="Content-Length|ends inside"):
        warc.read(spark, f"file://{tmp_path}").collect()


def test_clashing_columns(spark, tmp_path):
    pages = spark.createDataFrame(PAGES[:4], "page_id long, url string, html string").selectExpr("*", "'x' AS digest", "1 AS kept", "2 AS bytes", "3 AS n", "4 AS payload")
    warc.write(warc.page_records(pages), f"file://{tmp_path}/w")
    assert warc.read(spark, f"file://{tmp_path}/w").count() == 4
