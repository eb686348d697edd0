import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from tessaline.llm import warc
from tessaline.llm.base import new_path


def b32(text: str) -> str:
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


PAGES = [
    (1, "http://a/1", "same"),
    (2, "http://a/2", "WARC/1.0\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.0\r\n"),
    (3, None, None),
    (4, "http://a/4", "same"),
    (5, "http://a b\r\n/5", "é" * 3000 + "\r\n\r\n" + "WARC/1.0\r\n" * 3),
    (6, "x", ""),
    (7, "x", "same"),
    (8, "x", "tail\r\n\r\n"),
    (9, "x", "WARC/1.0\r\n" + "z" * 200 + "\r\n\r\n"),
]


@pytest.mark.parametrize("split", ["128m", "700"])
def test_round_trip_with_magic_in_payloads(spark, split):
    path = new_path(spark, "warc")
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("file", F.lit("clash")).coalesce(2)
    warc.write_archive(pages, path)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = {warc_id(r.id): r for r in warc.read_archive(spark, path).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert set(rows) == {p[0] for p in PAGES}
    for page_id, _, html in PAGES:
        r, text = rows[page_id], html or ""
        assert r.digest == b32(text)
        last = max(p[0] for p in PAGES if (p[2] or "") == text)
        if page_id == last:
            assert (r.type, r.payload, r.own, r.own_bytes, r.refers_to) == ("response", text, b32(text), len(text.encode()), None)
        else:
            assert (r.type, r.length, warc_id(r.refers_to)) == ("revisit", 0, last)


def warc_id(name: str) -> int:
    return int(name.removeprefix("<urn:page:").removesuffix(">"))


def test_empty_table(spark):
    path = new_path(spark, "warc")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archive(spark, path).count() == 0


def test_query_over_pages_with_nulls(spark, tmp_path):
    spark.createDataFrame([*PAGES, (None, "n", "no id"), (10, "u", "same")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = {r.page_id: r for r in warc.op3_warc(spark, str(tmp_path)).collect()}
    assert len(rows) == 11
    assert rows[None].record_type == "response" and rows[10].record_type == "response"
    assert {rows[k].refers_to for k in (1, 4, 7)} == {10}
    assert all(rows[k].payload_bytes == 4 and rows[k].payload_digest == b32("same") for k in (1, 4, 7, 10))
    assert rows[3].refers_to == 6
