import gzip
import hashlib
import random
import zlib
from pathlib import Path

import tests_support
from pyspark.sql import functions as F

from daytable.llm import warc


def test_round_trip_with_revisits_nulls_and_odd_payloads(spark, tmp_path):
    same, odd = "x" * 1000, "WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n" + "é " * 700
    rows = [
        (1, "http://a/1", same), (2, "http://a/2", same), (9, None, same), (3, "http://b\r\nEvil: 1", odd), (4, "u", odd),
        (5, "u", None), (60, "u", ""), (7, "", "z" * 1500), (6, "", "z" * 1500), (70, "u", "x" * 999), (8, "u", "x" * 999), (None, "u", same), (10, "u", "\r\n\r\n"),
    ]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")
    path = f"{tmp_path}/warc"
    warc.write_archives(warc.resolve(pages), path, archive_bytes=300, date="2020-01-02T03:04:05Z")
    found = {r["page_id"]: r for r in warc.revisits_resolved(warc.read_archives(spark, path)).collect()}
    assert len(found) == len(rows)
    for page, _, html in rows:
        body = (html or "").encode()
        assert found[page]["payload_bytes"] == len(body)
        assert found[page]["payload_digest"] == hashlib.sha1(body).hexdigest()
    assert {p: r["refers_to"] for p, r in found.items() if r["record_type"] == "revisit"} == {1: 9, 2: 9, 3: 4, 6: 7}
    files = [f for f in Path(path).glob("part-*") if f.stat().st_size]
    assert len(files) > 4
    records = [r for f in files for r in warc.parse([gzip.decompress(f.read_bytes())])]
    assert all(b"WARC-Date: 2020-01-02T03:04:05Z" in gzip.decompress(f.read_bytes()) for f in files)
    assert len({r["record_id"] for r in records}) == len(rows)
    by_page = {r["page_id"]: r for r in records}
    assert by_page[4]["payload"].decode() == odd
    assert by_page[3]["payload"] == b"" and by_page[3]["refers_to_id"] == by_page[4]["record_id"]


def test_rows_that_share_the_largest_id_and_an_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([(5, "a", "y" * 2000), (5, "a", "y" * 2000), (4, "b", "y" * 2000)], "page_id long, url string, html string")
    warc.write_archives(warc.resolve(pages), f"{tmp_path}/a")
    rows = warc.revisits_resolved(warc.read_archives(spark, f"{tmp_path}/a")).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in rows) == [(4, "revisit", 5), (5, "response", None), (5, "response", None)]
    assert len({r["record_id"] for r in rows}) == 3
    warc.write_archives(warc.resolve(pages.limit(0)), f"{tmp_path}/b")
    (tmp_path / "b").mkdir(exist_ok=True)
    assert warc.read_archives(spark, f"{tmp_path}/b").count() == 0


def test_very_long_payloads_are_whole_in_archives_bounded_by_bytes(spark, tmp_path):
    rng = random.Random(1)
    long = [rng.randbytes(10_000_000).hex() for _ in range(2)]
    rows = [(k, "u", long[k % 2]) for k in range(3)] + [(10 + k, "u", rng.randbytes(600).hex()) for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = f"{tmp_path}/warc"
    warc.write_archives(warc.resolve(pages), path, archive_bytes=20_000)
    files = [f for f in Path(path).glob("part-*") if f.stat().st_size]
    sizes = sorted(f.stat().st_size for f in files)
    assert sizes[-3] < 25_000 and sizes[-1] > 9_000_000
    read = warc.read_archives(spark, path).collect()
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in read} == {k: "" if k == 0 else h for k, _, h in rows}
    assert [r["record_type"] for r in read if r["page_id"] == 0] == ["revisit"]


def test_each_record_is_a_gzip_member(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", f"<p>{k}</p>") for k in range(5)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(warc.resolve(pages), f"{tmp_path}/a")
    (data,) = [f.read_bytes() for f in Path(f"{tmp_path}/a").glob("part-*") if f.stat().st_size]
    found = []
    while data:
        press = zlib.decompressobj(31)
        found += warc.parse([press.decompress(data)])
        data = press.unused_data
    assert sorted(r["payload"] for r in found) == [f"<p>{k}</p>".encode() for k in range(5)]


def test_headers_of_pages_beyond_a_broadcast_meet_in_a_join_that_is_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "small_join", lambda df, small, on, how="inner": df.join(small, on, how))
    rows = [(k, "u", ("same" if k % 3 else str(k)) * 500) for k in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(warc.resolve(pages), f"{tmp_path}/a")
    found = {r["page_id"]: r["refers_to"] for r in warc.revisits_resolved(warc.read_archives(spark, f"{tmp_path}/a")).collect()}
    assert found == {k: 398 if k % 3 and k != 398 else None for k in range(400)}


def test_the_pages_of_a_hot_payload_are_split(spark, monkeypatch):
    monkeypatch.setattr(warc, "small_join", lambda df, small, on, how="inner": df.join(small, on, how))
    pages = spark.range(20_000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.when(F.col("id") % 3 > 0, "same").otherwise(F.col("id").cast("string")), 400).alias("html"))
    assert "skew=true" in tests_support.final_plan(warc.resolve(pages))
