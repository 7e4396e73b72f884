"""Rows repeated whole, bytes that are not UTF-8, and workers that cannot import the library."""

import os
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from daytable.llm import packing, quality, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen. "


@pytest.fixture(scope="module")
def often(spark):
    """A row of 10 kB that is there 3,000 times, without an id, and two documents beside it."""
    text = LINE * 120
    many = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(10).cast("long").alias("n_chars"))
    return many.union(spark.createDataFrame([(5, text, "en", "t", 1), (9, text + " x", "en", "t", 1), (9, text + " x", "en", "t", 1)], many.schema)).repartition(6)


def test_substring_dedup_holds_a_repeated_row_once(often):
    rows = substrings.once(often.select(F.col("doc_id").alias("doc"), "text")).collect()
    assert Counter({(r["doc"], r["copies"]): 1 for r in rows}) == Counter([(None, 3000), (5, 1), (9, 2)])
    found = Counter((r["doc"], r["n_words"], r["n_removed"]) for r in substrings.repeats(often).collect())
    assert found == Counter({(None, 1680, 0): 3000, (5, 1680, 0): 1, (9, 1681, 1680): 2})


def test_mixing_deals_the_copies_of_a_repeated_row_out_task_by_task(spark, often):
    mixed = p.source_mix(spark, often, "")
    assert mixed.columns == often.columns
    n = Counter(r["doc_id"] for r in mixed.collect())
    assert n[5] <= 2 and n[9] <= 4
    assert abs(n[None] - 1.5 * 3000) <= 30  # the targets are 1.5 times all, and that source is nearly all


def test_every_stage_takes_repeated_rows_long_texts_and_no_rows(spark, often):
    long = spark.createDataFrame([(7, " ".join(f"word{k}" for k in range(30_000)), None, None, 0), (8, "", "en", "s", 0), (8, None, "en", "s", 0)], SCHEMA)
    docs = often.filter("doc_id is not null").union(long)
    for name, stage in p.STAGES:
        out = stage(spark, docs, "")
        if name != "slack_packing":
            assert out.columns == docs.columns, name
        assert out.count() > 0 and stage(spark, docs.limit(0), "").count() == 0, name
    pieces = packing.pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"] for r in pieces} == {5, 7, 8, 9} and all(r["n"] > 0 for r in pieces)


def test_bytes_that_are_not_utf8(spark):
    docs = spark.createDataFrame([(1, b"a\xff b\xe2\x82 " * 20), (2, "é日 x".encode())], "doc_id long, text binary").withColumn("text", F.col("text").cast("string"))
    kept = {r["doc"]: r["kept"] for r in substrings.repeats(docs).select("doc", F.hex("kept").alias("kept")).collect()}
    assert bytes.fromhex(kept[1]) == b" ".join([b"a\xff", b"b\xe2\x82"] * 20)
    chars = {r["doc_id"]: r["n"] for r in quality.ledger(docs).select("doc_id", F.col("ledger.word_chars").alias("n")).collect()}
    assert chars == {1: 20 * 4, 2: 3}  # bytes that begin a character
    assert packing.pack(docs).count() == 2


def test_ablations_read_the_written_ledger_alone(spark):
    plan = quality.quality_ablations(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan


def test_token_counts_run_where_workers_cannot_import_the_library(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {p.__file__.rsplit("/", 1)[0]!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from daytable.llm import counts
docs = spark.createDataFrame([("ab abc x",)], "text string")
print("FOUND", docs.select(counts.token_counts(F.col("text"), spark, [b" ", b"ab", b"c"]).alias("t")).first()["t"]["n_tokens"])
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=200, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable})
    assert "FOUND 6" in done.stdout, done.stderr[-1500:]
