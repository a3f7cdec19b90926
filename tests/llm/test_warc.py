import gzip
import hashlib

import pytest

from seedweave.llm import warc

LONG = "<html>" + "long page " * 20 + "</html>"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")


def trip(spark, rows, folder, **options):
    path = str(folder / "archive")
    warc.write_archive(pages(spark, rows), path, **options)
    return path, warc.resolve_revisits(warc.assemble(warc.read_archive(spark, path)))


ROWS = [
    (5, "http://a/5", LONG), (2, "http://a/2", LONG), (9, "http://a/9", LONG), (3, "http://a/3", "short"), (4, "http://a/4", "short"),
    (6, None, None), (7, "http://a/7 x\r\nWARC-Type: metadata", ""), (8, "http://é/8", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\nx\r\n\r\nWARC/1.1\r\n" + "é" * 60),
    (10, "u", "x" * 100), (11, "u", "x" * 100), (12, "u", "y" * 99), (13, "u", "y" * 99),
]


@pytest.mark.parametrize("size", [warc.ARCHIVE_BYTES, 300])
def test_round_trip(spark, tmp_path, size):
    _, captures = trip(spark, ROWS, tmp_path, archive_bytes=size)
    got = {r["page_id"]: r for r in captures.collect()}
    assert len(got) == len(ROWS)
    first = {}
    for page, _, html in sorted(ROWS, key=lambda r: r[0]):
        first.setdefault(html or "", page)
    for page, _, html in ROWS:
        body, row = (html or "").encode(), got[page]
        again = len(body) >= 100 and first[html or ""] != page
        assert row["capture"]["record_type"] == ("revisit" if again else "response")
        assert (row["original"]["page_id"], row["original"]["payload_bytes"]) == (first[html or ""] if again else page, len(body))
        assert row["original"]["payload_sha256"] == hashlib.sha256(body).hexdigest() == row["capture"]["payload_digest"][7:]
        assert row["n_requests"] == row["n_metadata"] == 1 and row["request"]["record_id"] != row["metadata"]["record_id"]
        if not again:
            assert bytes(row["capture"]["payload"]) == body


def test_files_are_plain_warc(spark, tmp_path):
    path, _ = trip(spark, ROWS[:3], tmp_path)
    data = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "archive").glob("*.gz"))
    kinds = [r["warc-type"] for r in warc.parse_records(data)]
    assert sorted(kinds) == ["metadata"] * 3 + ["request"] * 3 + ["response"] + ["revisit"] * 2


def test_repeated_rows_and_rows_without_id(spark, tmp_path):
    _, captures = trip(spark, [(1, "u", LONG), (1, "u", LONG), (None, "u", LONG), (1, "u", "other")], tmp_path)
    rows = sorted((str(r["page_id"]), r["capture"]["record_type"], str(r["original"]["page_id"])) for r in captures.collect())
    assert rows == [("1", "response", "1"), ("1", "response", "1"), ("1", "revisit", "1"), ("None", "response", "None")]


def test_empty_table(spark, tmp_path):
    assert trip(spark, [], tmp_path)[1].count() == 0


def test_damage_is_an_error():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    assert [r["content"] for r in warc.parse_records(record * 2)] == [b"hello"] * 2
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse_records(record[:-8]))
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.parse_records(b"x" + record))


def test_transactions_with_missing_and_several_records(spark):
    rows = [
        ("response", "r1", None), ("request", "q1", "r1"), ("request", "q0", "r1"), ("metadata", "m9", "gone"), ("response", "r2", None),
    ]
    blank = [None] * 9
    records = spark.createDataFrame([(k, i, c, *blank) for k, i, c in rows], warc.RECORD_SCHEMA)
    got = {r["capture_id"]: r for r in warc.assemble(records).collect()}
    assert set(got) == {"r1", "r2"}
    assert got["r1"]["request"]["record_id"] == "q0" and got["r1"]["n_requests"] == 2 and got["r1"]["metadata"] is None
    assert got["r2"]["request"] is None
