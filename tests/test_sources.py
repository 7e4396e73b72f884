import datetime

import pytest
from pyspark.sql import functions as F

from daytable.functions import scalars
from daytable.sources import codec, delimited, tables

DAY = datetime.date


def test_incident_files_with_comments_short_rows_and_odd_dates(spark, tmp_path):
    head = ";".join(f"h{i}" for i in range(22))
    row = lambda date, n=22: ";".join(["1", "c", date, "b", "i", "THEFT", "D", "L", "", "", "", "", "", "", "06", *["z"] * (n - 15)])
    lines = [head, row("01/01/2001 11:59:00 pm"), "#" + row("01/02/2001 01:00:00 AM"), row("01/03/2001 12:00:00 AM", 15), "1;c;01/04/2001 01:00:00 AM;b;i;T;D;L;;;;;;;;;;", row("bad")]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    good, bad = delimited.read_delimited(spark, f"{tmp_path}/a.csv", delimited.INCIDENTS)
    assert sorted((str(r["day"]), r["fbicode"]) for r in good.collect()) == [("2001-01-01", "06"), ("2001-01-03", "06"), ("None", "06")]
    assert bad.count() == 1
    again, worse = delimited.split_rows(spark.createDataFrame([(x,) for x in lines[1:]], "line string"), delimited.INCIDENTS)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, good.collect()), key=str)
    assert worse.count() == 1


def test_bars_of_several_series(spark, tmp_path):
    for name in ("DJI", "IXIC"):
        (tmp_path / f"{name}.csv").write_text("Date,Open,High,Low,Close,Adj Close,Volume\n2001-01-02,1,2,0.5,1.5,1.5,253300000\n2001-01-03,x,,1,1,1,7.0\n")
    bars = delimited.read_bars(spark, {n: f"{tmp_path}/{n}.csv" for n in ("DJI", "IXIC")})
    scaled = scalars.apply_factors(bars, {"volume": 1e6, "nothing": 3})
    assert sorted((str(r["day"]), r["id"], r["open"], r["volume"]) for r in scaled.collect())[:2] == [("2001-01-02", "DJI", 1.0, 253.3), ("2001-01-02", "IXIC", 1.0, 253.3)]
    assert bars.filter("day = '2001-01-03'").first()["open"] == 0.0


def test_many_files_are_one_scan(spark, tmp_path):
    head = "Date,Open,High,Low,Close,Adj Close,Volume\n"
    odd = ["a b", "c+d", "e%20f", "g[1]", "h{x}", "ü"]
    paths = {}
    for k, name in enumerate([*odd, *(f"s{k}" for k in range(60))]):
        (tmp_path / f"{name}.csv").write_text(head + "".join(f"2001-01-{d:02d},{k},1,1,1,1,{d}\n" for d in range(1, 4)) + "2001-01-09,short\n")
        paths[f"S{k}"] = str(tmp_path / f"{name}.csv") if name not in ("g[1]", "h{x}") else str(tmp_path / name.replace("[", "?").replace("]", "?").replace("{", "?").replace("}", "?")) + ".csv"
    (tmp_path / "folder").mkdir()
    for d in (1, 2):
        (tmp_path / "folder" / f"{d}.csv").write_text(head + f"2002-01-0{d},7,1,1,1,1,1\n")
    paths["F"] = f"{tmp_path}/folder"
    bars = delimited.read_bars(spark, paths)
    assert bars.columns == ["day", "open", "high", "low", "close", "adjclose", "volume", "id"]
    rows = bars.collect()
    assert len(rows) == 3 * 66 + 2
    assert all(r["open"] == (7.0 if r["id"] == "F" else float(r["id"][1:])) for r in rows)
    assert bars._jdf.queryExecution().sparkPlan().toString().count("FileScan csv") == 1
    for bad in ({"A": paths["S0"], "B": paths["S0"]}, {"A": f"{tmp_path}/none.csv"}, {"A": f"{tmp_path}/none*.csv"}):
        with pytest.raises(ValueError):
            delimited.read_bars(spark, bad)


def test_reads_count_their_lines_in_the_same_scan(spark, tmp_path):
    head = ";".join(f"h{i}" for i in range(22))
    row = lambda date, n=22: ";".join(["1", "c", date, *["z"] * (n - 3)])
    (tmp_path / "a.csv").write_text("\n".join([head, row("01/01/2001 11:59:00 pm"), "#" + row("x"), row("01/02/2001 01:00:00 AM", 9), row("bad"), row("", 9)]) + "\n")
    (tmp_path / "none.csv").write_text(head + "\n")
    rows, counts = delimited.read_counted(spark, f"{tmp_path}/a.csv", delimited.INCIDENTS)
    assert sorted(str(r["day"]) for r in rows.collect()) == ["2001-01-01", "None"]
    assert counts.get == {"lines": 4, "rejects": 2, "undated": 1}
    assert rows._jdf.queryExecution().sparkPlan().toString().count("FileScan csv") == 1
    rows, counts = delimited.read_counted(spark, f"{tmp_path}/none.csv", delimited.INCIDENTS)
    assert rows.count() == 0 and counts.get == {"lines": 0, "rejects": 0, "undated": 0}


def test_numbers_and_days(spark):
    df = spark.createDataFrame([("7.0",), ("7",), ("",), (None,), ("x1",), (" -3 ",), ("1e3",)], "t string")
    out = [(r[0], r[1]) for r in df.select(scalars.num0(F.col("t"), "int"), scalars.num0(F.col("t"), "double")).collect()]
    assert out == [(0, 7.0), (7, 7.0), (0, 0.0), (0, 0.0), (0, 0.0), (-3, -3.0), (0, 1000.0)]
    days = spark.createDataFrame([("2001-01-01 23:00:00 +0000 UTC",), ("20010101",)], "t string").select(scalars.parse_day(F.col("t")))
    assert [r[0] for r in days.collect()] == [DAY(2001, 1, 1), None]


def test_date_ranges(spark):
    df = spark.createDataFrame([(DAY(2001, 1, d),) for d in range(1, 6)] + [(None,)], "day date")
    assert scalars.in_range(df, "2001-01-02", "2001-01-04").count() == 3
    assert scalars.in_range(df, start="2001-01-05").count() == 1
    assert scalars.in_range(df).count() == 6
    for bad in (("2001-13-01", None), ("2001-01-02", "2001-01-01")):
        with pytest.raises(ValueError):
            scalars.in_range(df, *bad)
    with pytest.raises(ValueError):
        scalars.window_inside(("2001-01-01", "2001-03-01"), ("2001-01-01", "2001-02-01"))


def test_tables_tags_and_catalogue(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, "a")], "n long, x double, s string")
    for _ in range(2):
        tables.write_table(df, str(tmp_path), "t", files=1)
    assert tables.read_table(spark, str(tmp_path), "t").count() == 1
    assert [tuple(r) for r in tables.check_catalogue(tables.catalogue(df, {"x": "bars"})).collect()] == [("n", "bigint", ""), ("s", "string", ""), ("x", "double", "bars")]
    with pytest.raises(ValueError):
        tables.check_catalogue(tables.catalogue(df.withColumn("b", F.lit(True))))
    tags = tables.tags(spark, "2001-01-01", "2001-02-28", {"volume": 1e6})
    tables.check_tags(tags, "2001-01-01", "2001-02-28", {"volume": 1e6})
    tables.check_tags(tags, "2001-01-01", "2001-02-28", mode="dates")
    tables.check_tags(tags, "2001-01-05", "2001-02-01", mode="within")
    for args in (("2001-01-01", "2001-02-28", {}, "exact"), ("2001-01-02", "2001-02-28", None, "dates"), ("2000-12-31", "2001-02-01", None, "within")):
        with pytest.raises(ValueError):
            tables.check_tags(tags, *args)


def test_lines_of_pairs(spark):
    df = spark.createDataFrame([(DAY(2001, 1, 1), 3, 1.5, None)], "day date, b long, a double, c long")
    line = codec.to_kv_line(df, F.col("day"), ["b", "a", "c"])
    assert df.select(line).first()[0] == "2001-01-01\ta:1.5,b:3"
    read = codec.from_kv_line(spark.createDataFrame([("k\ta:1, b:2 ,a:3,odd,x:y:z",)], "line string"), "line", {"a": "int", "b": "int", "d": "int"})
    assert tuple(read.first()) == ("k", 3, 2, None)


def test_statistic_names(spark):
    rows = [("x", None, "value", "SUM", "x-SUM"), ("x", None, "SQ", "MEAN", "x-SQ-MEAN"), ("x", "y", "PRD", "CNT", "x+y-PRD-CNT")]
    df = spark.createDataFrame(rows, "x string, y string, kind string, stat string, want string")
    named = df.withColumn("name", scalars.stat_name(F.col("x"), F.col("y"), F.col("kind"), F.col("stat")))
    assert all(r["name"] == r["want"] for r in named.collect())
    assert [tuple(r[0]) for r in named.select(scalars.split_stat_name(F.col("name"))).collect()] == [r[:4] for r in rows]
