"""Moments and co-moments that tasks merge, against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from daytable.operators import correlate, moments
from daytable.plans import jobs


def table(spark, x, parts):
    names = [f"v{k:02d}" for k in range(x.shape[1])]
    return spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names)).repartition(parts), names


@pytest.mark.parametrize("parts", [1, 7])
def test_large_offsets_cost_no_digits(spark, parts):
    rng = np.random.default_rng(5)
    z = rng.normal(size=(900, 4))
    z[:, 1] += z[:, 0]
    z[:, 3] = 0.1
    offset = np.array([1e9, -3e9, 0.0, 1e9])
    x = z + offset
    df, names = table(spark, x, parts)
    exact = x - offset  # what the doubles hold beyond the offset
    base = {r["x"]: r for r in moments.base_stats(df, names).collect()}
    for k, n in enumerate(names):
        assert base[n]["var"] == pytest.approx(exact[:, k].var(), rel=1e-9)
    assert base["v03"]["var"] == 0.0
    found = {(r["x"], r["y"]): r for r in correlate.correlations(df, names).collect()}
    assert len(found) == 6
    for (a, b), r in found.items():
        i, j = names.index(a), names.index(b)
        if 3 in (i, j):
            assert r["r"] is None
        else:
            assert r["r"] == pytest.approx(np.corrcoef(exact[:, i], exact[:, j])[0, 1], rel=1e-9, abs=1e-12)


def test_many_batches_merge_alike(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(400, 3)) * 10)
    df, names = table(spark, x, 3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        small = {(r["x"], r["y"]): r.asDict() for r in moments.co_moments(df, names).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    large = {(r["x"], r["y"]): r.asDict() for r in moments.co_moments(df.coalesce(1), names).collect()}
    assert small.keys() == large.keys() and len(small) == 6
    for key, r in small.items():
        i, j = (names.index(n) for n in key)
        assert {c: r[c] for c in ("n", "sx", "sy", "sxy", "nonzero", "low", "high", "on")} == {c: large[key][c] for c in ("n", "sx", "sy", "sxy", "nonzero", "low", "high", "on")}
        assert (r["n"], r["sxy"], r["nonzero"]) == (400, x[:, i] @ x[:, j], ((x[:, i] != 0) & (x[:, j] != 0)).sum())
        assert r["cxy"] == pytest.approx(((x[:, i] - x[:, i].mean()) * (x[:, j] - x[:, j].mean())).sum())


def test_one_variable_no_rows_missing_values_and_nan(spark):
    df = spark.createDataFrame([(1.0, 5), (None, 5), (float("nan"), 5), (-2.0, 5)], "a double, b int")
    base = {r["x"]: r for r in moments.base_stats(df, ["a", "b"]).collect()}
    assert (base["a"]["cnt"], base["a"]["zero"], base["a"]["min"]) == (4, 1, -2.0)
    assert math.isnan(base["a"]["max"]) and math.isnan(base["a"]["sum"])
    assert (base["b"]["var"], base["b"]["min"], base["b"]["max"]) == (0.0, 5.0, 5.0)
    one = moments.co_moments(df, ["b"]).collect()
    assert [(r["x"], r["y"], r["sxy"], r["cxx"]) for r in one] == [("b", "b", 100.0, 0.0)]
    for none in (moments.base_stats, moments.pair_products, correlate.correlations):
        assert none(df.limit(0), ["a", "b"]).count() == 0


def test_statistics_read_their_rows_once(spark, tmp_path):
    spark.range(50).select(F.col("id").cast("double").alias("a"), (F.col("id") % 7).alias("b"), F.lit(1).alias("c")).write.parquet(f"{tmp_path}/t")
    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for batch in rows:
            seen.add(batch.num_rows)
            yield batch

    df = spark.read.parquet(f"{tmp_path}/t").mapInArrow(count, "a double, b long, c int")
    for found in jobs.stats(df).values():
        assert found.count() > 0
    assert seen.value == 50
