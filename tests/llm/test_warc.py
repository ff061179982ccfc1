"""Archives written and read back, foreign archives, predicates and damage."""

import gzip

import pytest

from tallyforge.llm import warc


def test_round_trip_against_the_oracle(spark, sf):
    from oracles import same_rows

    from tallyforge.llm import queries

    same_rows(queries.QUERIES["op9_warc"](spark, sf), queries.ORACLES["op9_warc"], sf)


@pytest.fixture
def archive(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "<p>é</p>", "x"), (2, "http://b\r\nX: y", "<p>é</p>", "x"), (3, None, None, "x"), (4, "", "", "x"), (5, "http://c", "z" * 300_000, "x"), (6, "http://d", "only", "x")], "page_id long, url string, html string, payload string").repartition(3)
    warc.write_pages(pages, str(tmp_path / "w"))
    return str(tmp_path / "w")


def test_records(spark, archive):
    rows = {r.record_id: r for r in warc.read(spark, archive).collect()}
    assert {k[-1]: (r.record_type, r.refers_to and r.refers_to[-1], r.payload_length) for k, r in rows.items()} == {"1": ("revisit", "2", 9), "2": ("response", None, 9), "3": ("revisit", "4", 0), "4": ("response", None, 0), "5": ("response", None, 300_000), "6": ("response", None, 4)}
    assert bytes(rows["urn:x-page:2"].payload) == "<p>é</p>".encode() and rows["urn:x-page:1"].payload is None
    assert rows["urn:x-page:2"].target_uri == "http://b X: y" and rows["urn:x-page:3"].target_uri is None
    assert rows["urn:x-page:1"].payload_digest == rows["urn:x-page:2"].payload_digest == warc.digest("<p>é</p>".encode())


def test_predicates_are_pushed_down(spark, archive):
    rows = warc.read(spark, archive)
    reader = warc.WarcReader({"path": archive})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), In(("target_uri",), ("http://d",)), GreaterThan(("payload_length",), 1), EqualTo(("headers",), 1)]))
    assert len(left) == 2
    assert [r["record_id"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()] == ["urn:x-page:6"]
    assert rows.where("record_type = 'revisit'").count() == 2
    assert rows.where("target_uri LIKE 'http://%' AND record_type IN ('response')").count() == 3
    assert all(r.payload is None for r in warc.read(spark, archive, "false").collect())


def test_unwanted_payloads_are_not_inflated(archive, monkeypatch):
    seen = []
    monkeypatch.setattr(warc, "digest", lambda b: seen.append(len(b)) or "")
    reader = warc.WarcReader({"path": archive, "payload": "false"})
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 6 and seen == []


def test_splits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SPLIT_BYTES", 1)
    writer = warc.WarcWriter({"path": str(tmp_path)})
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"record_id": ["a", "b", "c"], "record_type": ["response"] * 3, "target_uri": ["u"] * 3, "payload": [b"1", b"22", b"333"], "refers_to": [None] * 3}, pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload", pa.binary()), ("refers_to", pa.string())]))
    writer.commit([writer.write(iter([batch]))])
    writer.write(iter([batch]))  # a task that failed later: its file is in no manifest
    reader = warc.WarcReader({"path": str(tmp_path)})
    assert len(reader.partitions()) == 3
    assert [r["payload_length"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()] == [1, 2, 3]


def long_head(n):
    """A record whose HTTP head is longer than a first look."""
    http = b"HTTP/1.1 200 OK\r\nX-Long: " + b"x" * 9000 + b"\r\nContent-Length: %d\r\n\r\n" % n
    return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:4>\r\nWARC-Target-URI: http://z\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % (len(http) + n) + http + b"r" * n + b"\r\n\r\n"


@pytest.mark.parametrize("name", ["x.warc", "x.warc.gz"])
def test_foreign_archives(spark, tmp_path, name):
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:1>\r\nContent-Type: text/plain\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    records = [info, warc.record("urn:2", "response", "http://x", b"q" * 100_000), warc.record("urn:3", "revisit", "http://y", b"q", "urn:2")]
    (tmp_path / name).write_bytes(b"".join(gzip.compress(r) if name.endswith("gz") else r for r in records))
    rows = sorted((r.record_id, r.record_type, r.payload_length, r.payload and len(r.payload)) for r in warc.read(spark, str(tmp_path)).collect())
    assert rows == [("urn:1", "warcinfo", 5, 5), ("urn:2", "response", 100_000, 100_000), ("urn:3", "revisit", 1, None)]
    (tmp_path / f"long-{name}").write_bytes(b"".join(gzip.compress(r) if name.endswith("gz") else r for r in [long_head(3_000_000), *records]))
    both = warc.read(spark, str(tmp_path))
    assert both.count() == 7 and both.where("record_type = 'response' AND target_uri = 'http://x'").count() == 2
    assert [(r.payload_length, len(r.payload)) for r in both.where("record_id = 'urn:4'").collect()] == [(3_000_000, 3_000_000)], "a long HTTP head, and a payload beyond a window"


def test_damage_is_an_error(spark, tmp_path):
    bad = warc.record("urn:2", "response", "http://x", b"payload").replace(b"payload", b"paylaad")
    (tmp_path / "x.warc").write_bytes(bad)
    assert warc.read(spark, str(tmp_path), "false").count() == 1
    with pytest.raises(Exception, match="damaged"):
        warc.read(spark, str(tmp_path)).collect()


def test_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(none).count() == 0


def test_least_size(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, "u", "long"), (4, "u", "long")], "page_id long, url string, html string")
    assert sorted(tuple(r) for r in warc.revisits(pages, 2).collect()) == [(3, 4)]
