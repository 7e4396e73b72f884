import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from daytable.llm import mix
from daytable.llm.common import word_count


def levels(sizes: dict, weights=(3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> dict:
    """The excess of sources that stop, shared again by weight until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        above = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not above:
            return target | {s: level * w[s] for s in open_}
        target |= {s: most * sizes[s] for s in above}
        left -= sum(target[s] for s in above)
        open_ -= above
    return target


def test_all_documents(spark):
    rows = mix.op10_systematic_mix(spark, "/root/testdata/sf0.01").collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        source = docs[r["doc_id"]]["source"]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r["doc_id"]]["text"]))
        assert r["taken"] <= 2 * r["size"]
        sizes[source] += r["size"]
        taken[source] += r["taken"]
        largest[source] = max(largest[source], r["size"])
    want = levels(sizes)
    for r in rows:
        source = docs[r["doc_id"]]["source"]
        assert r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(want[source])
    assert all(abs(taken[s] - want[s]) <= 1.05 * largest[s] + 1 for s in sizes)
    again = {(r["doc_id"], r["taken"]) for r in mix.op10_systematic_mix(spark, "/root/testdata/sf0.01").collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}


def test_targets_with_sources_that_stop(spark):
    sizes = {"a": 10, "b": 1000, "c": 1, None: 500, "Z": 0, "é": 77}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r["source"]: r["target"] for r in mix.targets(df).collect()}
    assert found == pytest.approx(levels(sizes))


def test_nulls_empty_tables_ties_and_clashing_columns(spark):
    rows = [(None, None, 4), (None, None, 4), (1, "a", 3), (1, "a", 3), (2, "a", None), (3, "", 0), (4, "b", 0)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, n long, copies string")
    out = mix.systematic_mix(docs, "n")
    assert out.columns[:3] == ["doc_id", "source", "n"]
    got = out.collect()
    assert len(got) == len(rows)
    assert all(0 <= r["copies"] <= 2 for r in got)
    assert all(r["target"] == 0 for r in got if r["source"] in ("", "b"))
    assert mix.systematic_mix(docs.limit(0), "n").count() == 0
    none = mix.systematic_mix(docs.withColumn("n", F.lit(0)), "n").agg(F.sum("copies")).first()[0]
    assert none == 0


def test_words_are_split_at_ascii_white_space_only(spark):
    texts = ["", None, " \t\n", "a", " a  b\x0bc\f", "a b \x1c c", "\r\na\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(word_count(F.col("t"))).collect()] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_very_long_texts_and_many_sources(spark):
    docs = [(k, f"host{k}", 1) for k in range(300)] + [(1000, "host7", 3_000_000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n long").withColumn("text", F.repeat(F.lit("w "), F.col("n").cast("int")))
    rows = mix.systematic_mix(df.select("doc_id", "source", word_count(F.col("text")).alias("n")), "n").collect()
    assert {r["doc_id"]: r["n"] for r in rows} == {d: n for d, _, n in docs}
    sizes = defaultdict(int)
    for _, s, n in docs:
        sizes[s] += n
    want = levels(sizes)
    assert all(r["target"] == pytest.approx(want[r["source"]]) for r in rows)
