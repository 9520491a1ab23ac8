"""Archives read back through the index, against the table itself."""

import hashlib

import pytest
from pyspark.sql import functions as F

from stepfall.llm import warc

LONG, LONGER = "x" * 1000, "é" * 700


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h{i % 7}.example.org/{i % 3}", f"<p>{i % 40}</p>" + "y" * (i % 40) * 60)
            for i in range(400)]
    rows += [(1000, "https://A.example.org:8080/x?q=1", LONG), (1001, None, LONG),
             (1002, "http://a.example.org/", LONG[1:]), (1003, "http://a.example.org/", LONG[1:]),
             (1004, "", LONGER), (1005, "bad://[", LONGER), (1006, "http://n.example", None),
             (1007, "http://n.example", ""), (None, "http://n.example", LONG),
             (1008, "http://n.example/\r\nX-Page-Id: 5", "z"), (-5, "http://n.example", "neg"),
             (1009, "http://n.example", LONGER), (1009, "http://n.example", LONGER)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)


def expected(rows):
    keeper = {}
    for r in rows:
        html = r["html"] or ""
        if r["page_id"] is not None:
            keeper[html] = max(keeper.get(html, r["page_id"]), r["page_id"])
    out = []
    for r in rows:
        data = (r["html"] or "").encode()
        to = keeper.get(r["html"] or "")
        revisit = len(data) >= 1000 and r["page_id"] is not None and r["page_id"] != to
        out.append((r["page_id"], len(data), hashlib.sha1(data).hexdigest(),
                    "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [3, 512])
def test_every_record_comes_back(spark, pages, block):
    archive = warc.write_archive(pages.withColumn("key", F.lit(1)), block=block)
    got = warc.lookup(spark, archive, pages)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == expected(pages.collect())


def test_lookup_of_some_and_of_unknown(spark, pages):
    archive = warc.write_archive(pages, block=4)
    asked = spark.createDataFrame([("http://h1.example.org/1", 1), ("http://h1.example.org/1", 2),
                                   ("http://zz.example", 1), ("http://n.example", 1009)],
                                  "url string, page_id long")
    assert sorted(r.page_id for r in warc.lookup(spark, archive, asked).collect()) == [1, 1009, 1009]


def test_records_are_read_back_in_tasks_of_bounded_size(spark, pages, monkeypatch):
    archive = warc.write_archive(pages.withColumn("capture", F.lit("a column of the caller")))
    for most in (1 << 30, archive.record_bytes // 5):
        monkeypatch.setattr(warc, "READ_BYTES", most)
        tasks = -(-archive.record_bytes // most)
        got = warc.lookup(spark, archive, pages)
        assert got.rdd.getNumPartitions() == tasks
        assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == expected(pages.collect())


def test_empty_table(spark, pages):
    archive = warc.write_archive(pages.limit(0))
    assert archive.files == [] and warc.lookup(spark, archive, pages).count() == 0


def test_key_order():
    assert warc.reversed_host_key("http://www.Example.com:80/a?b#c") == b"com,example,www)/a?b"
    assert warc.reversed_host_key("http://example.com:81") == b"com,example:81)/"


def test_damaged_record_is_noticed():
    import gzip
    digest = hashlib.sha1(b"abc").hexdigest()
    raw = gzip.decompress(warc.record_bytes(1, "u", "abc", None, 3, digest))
    with pytest.raises(ValueError):
        warc.parse_record(gzip.compress(raw.replace(b"abc", b"abd")))
