import math

import numpy as np
from pyspark.sql import functions as F

from daytable.llm import vectors


def brute(rows: list[tuple], k: int, asks) -> list[tuple]:
    whole = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(256 * float(x)) for x in v]
        whole[i] = min(whole.get(i, w), w)
    out = []
    for q in filter(asks, whole):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_all_vectors(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    found = vectors.op2_va_file(spark, "/root/testdata/sf0.01").collect()
    assert sorted(tuple(r) for r in found) == brute(rows, 5, lambda i: i % 50 == 0)


def test_ties_nulls_repeats_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vectors, "DATA_BLOCK", 20)
    monkeypatch.setattr(vectors, "BLOCKS_PER_TASK", 2)
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(120)]
    rows += [(i, [0.5] * 6) for i in range(200, 260)]  # a very common vector
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [0.5] * 6)]
    rows += [(5, rows[5][1]), (6, [0.0] * 6), (400, [1.0, 2.0]), (401, [3.0, 4.0]), (402, []), (403, [1e6] * 6)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, v int")
    found = vectors.top_k(df, F.col("vec_id") % 4 == 0)
    assert sorted(tuple(r) for r in found.collect()) == brute([(i, v) for i, v in rows], 5, lambda i: i % 4 == 0)
    assert vectors.top_k(df.limit(0), F.lit(True)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(2)
    for most in (300, 1 << 40, 1 << 53):
        q, x = rng.integers(-most, most, (20, 16)), rng.integers(-most, most, (90, 16))
        low, high = vectors.bounds((np.arange(1000, 1020), q.astype(float)), (np.arange(90), (x // vectors.CELL).astype(float)))
        for i in range(20):
            for j in range(90):
                real = sum(int(a) * int(b) for a, b in zip(q[i], x[j], strict=True))
                assert low[i, j] <= real <= high[i, j]


def test_huge_components(spark):
    most, end = 1 << 53, (1 << 63) - 1
    rows = [(1, [1e17, 1.0]), (2, [-1e17, 1.0]), (3, [1e30, 1e30]), (4, [2.0, 3.0]), (5, [0.5, -3e38]), (6, [1e6, 1e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [min(max(math.floor(256 * x), -most), most) for x in v] for i, v in rows}
    want = []
    for q in whole:
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)
        want += [(q, r + 1, i, min(max(-s, -end - 1), end)) for r, (s, i) in enumerate(scores[:3])]
    assert sorted(tuple(r) for r in vectors.top_k(df, F.lit(True), 3).collect()) == sorted(want)


def test_candidates_of_a_query_do_not_grow_with_the_blocks(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=16)]) for i in range(3000)], "vec_id long, embedding array<double>")
    whole = vectors.whole_vectors(rows, "vec_id", "embedding").cache()
    asked = whole.filter("vec_id % 50 = 0")
    found = []
    for block in (100, 3000):
        queries, data = vectors.in_blocks(asked, 100, 60, 1), vectors.in_blocks(whole, block, 3000, vectors.CELL)
        reach = vectors.reaches(vectors.meetings(queries, data, 1, 3), 5)
        met = vectors.meetings(vectors.with_reaches(queries, reach), data, 1, 3)
        found.append(sorted((r["query_id"], r["vec_id"]) for r in vectors.candidates(met).collect()))
    assert found[0] == found[1]
    assert 60 * 5 <= len(found[0]) < 60 * 12
