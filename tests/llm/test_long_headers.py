"""WARC records whose header is longer than any fixed prefix, first in a file or in a range."""

import random

import pytest

from marginalia.llm import warc


def urls():
    rng = random.Random(3)
    return ["http://a/" + "x" * 70_000, "http://b/" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(60_000)), "http://c/" + "".join(rng.choice("0123456789abcdef") for _ in range(900_000))]


@pytest.mark.parametrize("split", [1000, 1 << 24])
def test_long_urls_are_found(spark, split):
    pages = spark.createDataFrame([(i, u, f"page {i}") for i, u in enumerate(urls())], "page_id long, url string, html string").repartition(3)
    assert sorted(r.page_id for r in warc.archive(pages, split).collect()) == [0, 1, 2]


def test_header_is_read_to_its_end():
    for u in urls():
        made = warc.member(warc.record(1, u, b"payload", None))
        assert warc._header(made).endswith(b"Content-Length: %d" % (len(b"payload") + len(b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: 7\r\n\r\n")))
        assert warc._header(made[: len(made) // 2]) is None


@pytest.mark.parametrize("split", [64, 4096, 1 << 24])
def test_long_urls_first_in_a_file_and_among_large_records(spark, split):
    rng = random.Random(4)
    large = "".join(rng.choice("abcdefghijklmnop") for _ in range(700_000))
    data = [(0, urls()[0], "short"), (1, "u", large), (2, urls()[1], large[::-1]), (3, "u", ""), (4, urls()[0], large)]
    pages = spark.createDataFrame(data if split > 64 else data[:1] + data[3:4], "page_id long, url string, html string").coalesce(1)
    assert sorted(r.page_id for r in warc.archive(pages, split).collect()) == sorted(r.page_id for r in pages.collect())


def test_members_that_hold_no_record_are_passed_over():
    import pyarrow as pa

    good = [warc.member(warc.record(i, "u", b"x" * 50, None)) for i in range(3)]
    data = good[0] + warc.member(b"no record") + good[1] + warc.member(b"WARC/1.1\r\nno length\r\n\r\n") + good[2]
    found = list(warc.scan(pa.BufferReader(data), len(data), 0, len(data)))
    assert [warc.parse(c)[0]["warc-record-id"] for _, c in found] == [f"<urn:page:{i}>" for i in range(3)]


def test_archives_stay_where_they_are_asked_for(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "one"), (2, "v", None)], "page_id long, url string, html string")
    assert warc.archive(pages, folder=f"file://{tmp_path}/out").count() == 2
    assert list((tmp_path / "out").glob("*.warc.gz"))


def test_s3a_is_arrow_s_s3():
    pytest.importorskip("pyarrow._s3fs")
    assert warc._files("s3a://bucket/a/b.warc.gz?region=us-east-1")[1] == "bucket/a/b.warc.gz"
