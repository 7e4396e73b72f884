"""Sums and means that no order of rows changes."""

import datetime
import random
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from daytable.operators import daily
from daytable.plans.queries import QUERIES
from daytable.plans.sql import SQL

DAY = datetime.date(2001, 2, 3)


def numbers(n=400):
    rng = random.Random(8)
    out = [rng.choice([0.01, -0.07, 1e-9, 12345.67, -3.0, 1e13, 7e14, -7e14, 0.1]) * rng.randint(-1000, 1000) for _ in range(n)]
    return out + [1e18, 1.0, -1e18, None, 0.0, -0.0]


def test_sums_are_those_of_fractions(spark):
    for values in (numbers(), [0.1] * 10, [1e18, 1.0, -1e18], [2.0**-60, 2.0**-70], [], [-(2.0**-30)]):
        df = spark.createDataFrame([(DAY, v) for v in values], "day date, x double")
        sums = df.groupBy("day").agg(F.count(F.lit(1)).alias("n"), *daily.exact_sums(df, "x"))
        found = [r[0] for r in sums.select(daily.total(sums, "x")).collect()]
        assert found == ([float(sum(map(Fraction, (v or 0.0 for v in values))))] if values else [])


def test_what_has_no_digits_is_added_beside(spark):
    df = spark.createDataFrame([(DAY, float("inf"), 1), (DAY, 1.5, 2)], "day date, x double, n int").withColumn("d", F.lit("0.10").cast("decimal(10,2)"))
    (row,) = daily.daily_means(df, ["x", "d"], ["n"]).collect()
    assert tuple(row) == (DAY, float("inf"), 0.1, 1)


def test_rows_in_any_order_and_partitioning_give_equal_bits(spark):
    rows = [(DAY + datetime.timedelta(k % 3), float(v or 0), k % 5, "p" * (k % 2)) for k, v in enumerate(numbers() * 3)]
    seen = set()
    for seed in range(10):
        random.Random(seed).shuffle(rows)
        spark.conf.set("spark.sql.shuffle.partitions", str(1 + seed % 4))
        df = spark.createDataFrame(rows, "day date, x double, condition int, main string").repartition(1 + seed)
        parts = daily.daily_parts(df, ["x"], [], "condition", ["main"])
        for found in (daily.means_of(parts, ["x"], []), daily.daily_means(df, ["x"], [])):
            seen.add(tuple(sorted((r["day"], r["x"].hex()) for r in found.collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(seen) == 1


@pytest.mark.parametrize("name", ["daily_means", "merged_csw", "merged_cw", "job_weather", "job_merge"])
def test_means_that_lie_on_a_half(spark, name):
    """Against DuckDB where many means do, by 9 digits and whatever the number of partitions."""
    sf, con = "/root/testdata/sf0.01", duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    theirs = con.execute(SQL[name])
    columns = sorted(c[0] for c in theirs.description)
    plain = lambda names, rows: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in (dict(zip(names, r, strict=True))[c] for c in columns)) for r in rows), key=repr)
    want = plain([c[0] for c in theirs.description], theirs.fetchall())
    for parts in ("3", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        mine = QUERIES[name](spark, sf)
        assert [repr(r) for r in plain(mine.columns, mine.collect())] == [repr(r) for r in want]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
