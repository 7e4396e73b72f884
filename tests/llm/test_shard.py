import zlib
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from daytable.llm import shard
from daytable.llm.common import dealt, numbered


def longs(*values: tuple[int, int]) -> int:
    """Spark's xxhash64 of numbers, each (value, bytes)."""
    h = 42
    for value, width in values:
        h = xxhash.xxh64_intdigest(value.to_bytes(width, "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def feistel(x: int, n: int, seed: int) -> tuple[int, int]:
    """(row x under the permutation of 0 .. n - 1, the steps that it was outside)."""
    a, b = shard.halves(n)
    walk = -1
    while True:
        left, right = divmod(x, b)
        for r in range(shard.ROUNDS):
            if r % 2:
                right = (right + longs((seed, 4), (r, 4), (left, 8)) % b) % b
            else:
                left = (left + longs((seed, 4), (r, 4), (right, 8)) % a) % a
        x, walk = left * b + right, walk + 1
        if x < n:
            return x, walk


SIZES = [*range(301), *range(1226, 1258)]


@pytest.mark.parametrize("seed", [20, 7])
def test_permutation_of_every_number_against_plain_python(spark, seed):
    want = {n: [feistel(x, n, seed) for x in range(n)] for n in SIZES}
    assert all(sorted(p for p, _ in pairs) == list(range(n)) for n, pairs in want.items())
    rows = [(x, n, *shard.halves(n), p, w) for n, pairs in want.items() for x, (p, w) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "x long, n long, a long, b long, p long, walk int")
    step = lambda y: shard.once(y, F.col("a"), F.col("b"), seed)
    at = F.aggregate(F.sequence(F.lit(0), F.col("walk")), F.col("x"), lambda y, _: step(y))
    assert df.filter(at != F.col("p")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 7, 65, 197, 208, 1000, 1226, 1257])
def test_longest_walk(spark, n):
    walk = shard.longest_walk(spark, n, 20)
    pairs = [feistel(x, n, 20) for x in range(n)]
    assert walk == max((w for _, w in pairs), default=0)
    found = spark.range(n).select("id", shard.permuted(F.col("id"), n, 20, walk).alias("p")).collect()
    assert [r["p"] for r in sorted(found, key=lambda r: r["id"])] == [p for p, _ in pairs]


def test_all_documents(spark):
    rows = shard.op4_feistel_shards(spark, "/root/testdata/sf0.01").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    slots = defaultdict(list)
    for r in rows:
        body = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(body) + 1, zlib.crc32(body))
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(8))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = shard.op4_feistel_shards(spark, "/root/testdata/sf0.01").repartition(3).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in rows} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}


def test_nulls_repeated_rows_and_clashing_columns(spark):
    rows = [(None, None, 1), (None, None, 1), (1, "a", 2), (1, "a", 2), (1, "b", 3), (2, "", 4), (3, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int")
    out = shard.feistel_shards(docs, shards=3).collect()
    places = sorted((r["shard"], r["slot"]) for r in out)
    assert places == sorted((p % 3, p // 3) for p in range(7))
    assert shard.feistel_shards(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 3, 5, 200])
def test_tables_of_sizes_whose_outside_numbers_form_cycles(spark, n):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    out = shard.feistel_shards(docs, shards=3).collect()
    assert sorted((r["shard"], r["slot"]) for r in out) == sorted((p % 3, p // 3) for p in range(n))


def test_a_row_repeated_very_often_is_numbered_by_several_tasks(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("doc_id"), F.lit("x").alias("text"), "id").repartition(6, "id")
    rows = dealt(docs)
    out = numbered(rows.withColumn("cell", F.lit(0)), [], ["cell"], ["doc_id", "text"], "row")
    assert sorted(r["row"] for r in out.collect()) == list(range(3000))
    copies = rows.filter("doc_id = 1").groupBy("__task").count().collect()
    assert len(copies) == 6
    shards = shard.feistel_shards(docs, shards=3)
    assert sorted((r["shard"], r["slot"]) for r in shards.collect()) == sorted((p % 3, p // 3) for p in range(3000))
    other = shard.feistel_shards(docs.repartition(2), shards=3)
    places = lambda df: sorted((r["doc_id"], r["shard"], r["slot"]) for r in df.collect())
    assert places(other) == places(shards)
