"""Archives: round trip, index by the records' lengths, coalesced reads, equal payloads."""

import hashlib

import compare
import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from loopsight.llm import queries, warc

LONG = "<p>" + "ä\r\n\r\nWARC/1.1\r\n" * 80 + "</p>"
PAGES = [(1, "http://a/1", LONG), (7, "http://a/7", LONG), (7, "http://b/7 x\r\ny", LONG), (None, None, LONG), (3, "", "short"), (4, "http://a/4", "short"), (5, "http://a/5", None), (6, None, ""), (None, "http://n", "x" * 2000), (None, "http://n", "x" * 2000), (8, "http://e", "y" * 999 + "z"), (9, "http://e", "y" * 999 + "z"), (10, "u", "y" * 999), (11, "u", "y" * 999)]
SCHEMA = "page_id long, url string, html string, digest string, bytes string"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "d", "b") for p in PAGES], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def archived(spark, pages, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('warc')}/archive"
    warc.archive(pages, path)
    return path


def test_index_covers_the_files_and_names_the_records(spark, archived):
    rows = warc.index(spark, archived).collect()
    assert len(rows) == len(PAGES)
    by_file = {}
    for r in rows:
        by_file.setdefault(r["file"], []).append(r)
    for file, own in by_file.items():
        data, at = open(file.removeprefix("file:"), "rb").read(), 0
        for r in sorted(own, key=lambda r: r["offset"]):
            record = data[r["offset"] : r["offset"] + r["length"]]
            assert r["offset"] == at and record.startswith(b"WARC/1.1\r\nWARC-Type: ") and record.endswith(b"\r\n\r\n")
            at += r["length"]
        assert at == len(data)
    assert sorted(str(r["url"]) for r in rows) == sorted(str(u or None).replace(" ", "%20").replace("\r", "%0D").replace("\n", "%0A") for _, u, _ in PAGES)


def test_payloads_come_back_whole(spark, archived):
    rows = warc.read(warc.index(spark, archived)).collect()
    texts = {r["record_id"]: r["payload"] for r in rows if r["record_type"] == "response"}
    got = sorted((str(r["page_id"]), bytes(texts[r["refers_to_id"] or r["record_id"]])) for r in rows)
    assert got == sorted((str(i), (h or "").encode()) for i, _, h in PAGES)


def test_selected_records_only(spark, archived):
    some = warc.read(warc.index(spark, archived).filter("page_id in (3, 10)"), gap=0, most=1).collect()
    assert sorted((r["page_id"], bytes(r["payload"])) for r in some) == [(3, b"short"), (10, b"y" * 999)]


def test_types_equal_sql(spark, pages, archived, tmp_path):
    pq.write_table(pages.toArrow(), tmp_path / "pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet')")
    found = warc.resolved(warc.read(warc.index(spark, archived)))
    assert not compare.differences(found, con, queries.oracle_sql()["op12_warc"])
    of = {}
    for r in found.collect():
        of.setdefault(r["page_id"], []).append((r["record_type"], r["refers_to"]))
    assert of[1] == [("revisit", 7)] and of[7] == [("response", None)] * 2 and sorted(of[None], key=str) == [("response", None), ("response", None), ("revisit", 7)]
    assert of[8] == [("revisit", 9)] and of[10] == of[11] == [("response", None)]


def test_ranges_are_joined_within_gap_and_size():
    spans = [(0, 10), (10, 20), (25, 30), (100, 110), (110, 400), (405, 406)]
    assert list(warc.coalesced(iter(spans), gap=5, most=50)) == [(0, 30, 3), (100, 110, 1), (110, 400, 1), (405, 406, 1)]
    assert list(warc.coalesced(iter(spans), gap=0, most=1000)) == [(0, 20, 2), (25, 30, 1), (100, 400, 2), (405, 406, 1)]
    assert list(warc.coalesced(iter([]))) == []


def test_a_cut_file_and_a_changed_payload_are_errors(spark, archived, tmp_path):
    row = next(r for r in warc.index(spark, archived).collect() if r["page_id"] == 10)
    data = bytearray(open(row["file"].removeprefix("file:"), "rb").read())
    data[row["payload_at"]] ^= 1
    (tmp_path / "x.warc").write_bytes(data)
    changed = spark.createDataFrame([{**row.asDict(), "file": f"file://{tmp_path}/x.warc"}], warc.INDEX)
    with pytest.raises(Exception, match="isn't what the index says"):
        warc.read(changed).collect()
    with pytest.raises(ValueError, match="no record"):
        list(warc.walk(pa.BufferReader(b"WARC/1.1\r\nno end")))


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    warc.archive(spark.createDataFrame([], SCHEMA), path)
    assert warc.resolved(warc.read(warc.index(spark, path))).collect() == []
    assert hashlib.sha1(b"").hexdigest() == "da39a3ee5e6b4b0d3255bfef95601890afd80709"
