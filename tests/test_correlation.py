"""The correlation of one pair: constants in many tasks, missing values, large and small numbers, and its query against DuckDB."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from daytable.operators import correlate
from daytable.plans.queries import QUERIES
from daytable.plans.sql import SQL


def r_of(df, x="x", y="y"):
    return df.agg(correlate.correlation(*(F.col(c) if isinstance(c, str) else F.lit(c) for c in (x, y)))).first()[0]


@pytest.mark.parametrize("rows, parts", [(49 * 4, 4), (1000, 7), (98, 2)])
def test_a_constant_in_many_tasks_has_no_r(spark, rows, parts):
    df = spark.range(0, rows, 1, parts).select(F.col("id").cast("double").alias("x"), F.lit(0.1).alias("y"))
    assert [r_of(df, "x", 1.0), r_of(df, 1.0, "x"), r_of(df, "x", "y"), r_of(df, "y", "x"), r_of(df, "y", "y")] == [None] * 5
    assert r_of(df, "x", "x") == pytest.approx(1)


def test_rows_that_lack_a_value_take_no_part(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 5.0), (3.0, 4.0), (None, 100.0), (50.0, None), (None, None)], "x double, y double")
    assert r_of(df) == pytest.approx(0.7205766921228921)
    assert r_of(df.filter("x is null or y is null or x = 1")) is None
    assert r_of(df.limit(0)) is None


@pytest.mark.parametrize("size", [1e-100, 1.0, 1e100])
def test_large_and_small_numbers_neither_overflow_nor_vanish(spark, size):
    df = spark.createDataFrame([(1 * size, 1 * size), (2 * size, 5 * size), (3 * size, 4 * size)], "x double, y double")
    assert r_of(df) == pytest.approx(0.7205766921228921)


def test_the_query_on_odd_rows_agrees_with_its_sql(spark, tmp_path):
    k = F.col("id")
    flag = F.when(k < 4, F.lit("one")).when(k % 5 == 0, "A").when(k % 5 == 1, "same").when(k % 5 == 2, "none").when(k % 5 == 3, "nan")
    x = F.when((flag == "none") & (k % 2 == 0) | (k % 11 == 0), F.lit(None)).when((flag == "nan") & (k == 8), float("nan")).when(flag == "same", 7.0).otherwise(k % 50 + 1)
    y = F.when((flag == "none") & (k % 2 == 1) | (k % 13 == 0), F.lit(None)).otherwise(k * 7919 % 10007 / 100 + k % 50 * 3)
    odd = spark.range(3, 2003, 1, 7).select(
        flag.alias("l_returnflag"), F.lit("O").alias("l_linestatus"), x.cast("double").alias("l_quantity"), y.cast("double").alias("l_extendedprice"),
        F.lit(0.0).alias("l_discount"), F.lit(0.0).alias("l_tax"), F.lit(1).alias("l_linenumber"), F.lit("1997-01-01").cast("timestamp_ntz").alias("l_shipdate"),
    )
    odd.write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    # repr tells NaN from null
    plain = lambda found: sorted(repr((main, r if r is None or math.isnan(r) else round(r, 6), constant)) for main, r, constant in found)
    mine = QUERIES["correlation_one_pair"](spark, str(tmp_path)).select("main", "r", "constant").collect()
    theirs = con.execute(SQL["correlation_one_pair"]).fetchall()
    assert len(theirs) == 6 and plain(mine) == plain(theirs)
