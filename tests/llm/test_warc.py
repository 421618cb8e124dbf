import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from codeloom.llm import warc
from codeloom.llm.shared import shared_folder

LONG = "<p>" + "long page " * 200
PAGES = [(1, "http://a/1", LONG), (2, "http://a/2", LONG), (3, None, LONG + "é日😀"), (4, "http://a/4", None), (5, "http://a/5", ""), (6, "", "short"),
         (7, "http://a/7\r\nX: y", "short"), (9, "http://a/9", LONG), (9, "http://a/9", LONG), (None, "http://a/n", LONG), (10, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 100)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("file", F.lit("x")).withColumn("digest", F.lit("y"))


def test_round_trip(spark, pages):
    found = sorted([tuple(r) for r in warc.archived(pages).collect()], key=repr)
    want = []
    for page, _, html in PAGES:
        data = (html or "").encode()
        last = max(p for p, _, h in PAGES if h == html and p is not None)
        again = len(data) >= 1000 and page != last
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last if again else None))
    assert found == sorted(want, key=repr)


def test_archives_and_index(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 600)
    folder = shared_folder(spark, "archives-test")
    index = warc.write_archives(pages.repartition(2), folder)
    rows = index.collect()
    root = Path(folder.removeprefix("file:"))
    assert len(rows) == len(PAGES) and len({r["file"] for r in rows}) > 2
    for r in rows:
        data = (root / r["file"]).read_bytes()[r["offset"]:r["offset"] + r["length"]]
        record = gzip.decompress(data)
        assert record.startswith(b"WARC/1.1\r\nWARC-Type: " + r["record_type"].encode()) and record.endswith(b"\r\n\r\n")
    for file in {r["file"] for r in rows}:
        assert gzip.decompress((root / file).read_bytes()).count(b"WARC-Record-ID: ") == sum(r["file"] == file for r in rows)
    some = warc.read_records(index.where("row_id in ('3', '5', '10')"), folder).collect()
    assert {r["row_id"]: bytes(r["payload"]).decode() for r in some} == {"3": PAGES[2][2], "5": "", "10": PAGES[10][2]}


@pytest.mark.parametrize("gap, most", [(0, 1), (1 << 20, 1 << 20)])
def test_ranges(spark, pages, monkeypatch, gap, most):
    monkeypatch.setattr(warc, "GAP", gap)
    monkeypatch.setattr(warc, "READ_BYTES", most)
    folder = shared_folder(spark, "archives-test")
    index = warc.write_archives(pages.coalesce(1), folder)
    assert warc.read_records(index, folder).count() == len(PAGES)


def test_no_pages(pages):
    assert warc.archived(pages.limit(0)).count() == 0
