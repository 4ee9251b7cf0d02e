"""Archives: what is written comes back, whole and by offset."""

import gzip
import hashlib
import os

import pytest

from tidemark.llm import queries, warc
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
LONG = "é" * 600


def pages(spark):
    rows = [
        (1, "http://a/\r\nX: y", LONG, 1), (2, None, LONG, 1), (9, "http://b", LONG, 1), (4, "u", "short", 2),
        (5, "u", "short", 2), (6, "u", None, 3), (7, "u", "", 3), (None, "u", "<p>\r\n\r\nWARC/1.1\r\n\r\n</p>" * 90, 4),
        (8, "u", "x" * 3_000_000, 5),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload int")


def test_round_trip_and_revisits(spark):
    index = warc.archived(pages(spark), archive_bytes=200)
    back = {r.page_id: r for r in warc.read_records(index, 3).collect()}
    assert len(back) == 9
    assert [(i, back[i].record_type, back[i].refers_to) for i in (1, 2, 9)] == [(1, "revisit", 9), (2, "revisit", 9), (9, "response", None)]
    assert back[1].payload is None and back[1].payload_bytes == 1200 and back[1].url == "http://a/X: y"
    assert back[9].payload == LONG and back[8].payload == "x" * 3_000_000 and back[6].payload == ""
    assert back[None].payload.startswith("<p>\r\n\r\nWARC")
    assert {back[i].record_type for i in (4, 5, 6, 7, 8, None)} == {"response"}
    assert back[2].payload_digest == hashlib.sha1(LONG.encode()).hexdigest()


def test_each_record_is_a_member_and_the_index_stands_beside(spark):
    index = warc.archived(pages(spark)).orderBy("archive", "offset").collect()
    for row in index:
        path = row.archive.removeprefix("file://")
        with open(path, "rb") as file:
            file.seek(row.offset)
            assert gzip.decompress(file.read(row.length)).startswith(b"WARC/1.1\r\nWARC-Type: " + row.record_type.encode())
        assert os.path.getsize(path) >= row.offset + row.length
        with open(path + ".idx") as file:
            assert any(line.startswith(f"{row.offset}\t{row.length}\t{row.record_type}\t") for line in file)


def test_streams_of_one_and_many_members():
    records = [warc.record_bytes((i, "u", "x" * i, i, "d", None)) for i in range(50)]
    one = gzip.compress(b"".join(records))
    many = b"".join(map(gzip.compress, records))

    class Source:
        def __init__(self, data):
            self.data = data

        def read(self, n):
            out, self.data = self.data[:7], self.data[7:]
            return out

    for data in (one, many):
        got = [fields["warc-record-id"] for fields, _ in warc.parsed(warc.inflated(Source(data)))]
        assert got == [f"<urn:page:{i}>" for i in range(50)]
    with pytest.raises(ValueError):
        list(warc.parsed(iter([records[3][:-10]])))


def test_empty_table(spark):
    assert warc.read_records(warc.archived(pages(spark).limit(0))).count() == 0


def test_query_matches_sql(spark):
    df = queries.op8_warc(spark, SF_DIR)
    result = connect(SF_DIR).execute(queries.OP8_SQL)
    columns = [d[0] for d in result.description]
    assert compare([tuple(r) for r in df.collect()], df.columns, result.fetchall(), columns) is None
