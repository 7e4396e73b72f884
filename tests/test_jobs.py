import datetime

import pytest

from daytable.operators import regress
from daytable.plans import jobs


def test_the_jobs_in_their_usual_order(spark, tmp_path):
    day = lambda k: datetime.date(2001, 1, 1) + datetime.timedelta(k)
    incidents = spark.createDataFrame([(day(k), c) for k in range(40) for c in "AB" * (1 + k % 5)], "day date, fbicode string")
    readings = spark.createDataFrame([(day(k), float(k % 7), 1000 + h, 800 + h, "Main", "desc") for k in range(40) for h in range(3)], "day date, temp float, pressure int, weather_id int, weather_main string, weather_description string")
    bars = spark.createDataFrame([(day(k), i, 1.0 + k, 2.0e6) for k in range(2, 40) if k % 7 < 5 for i in jobs.IDS], "day date, id string, close double, volume double")
    s = jobs.Settings("2001-01-01", "2001-02-05", {"volume": 1e6})
    how = {"floats": ["temp"], "ints": ["pressure"], "fields": ["close", "volume"], "values": ["A", "B"]}
    tables = jobs.merged(incidents, readings, bars, s, **how)
    with pytest.warns(UserWarning, match="table csw has 36 days of 40"):  # the range leaves out four days
        jobs.write_merged(tables, str(tmp_path), s, {"incidents": incidents, "readings": readings, "bars": bars})
    csw = jobs.read_merged(spark, str(tmp_path), "csw", s)
    assert csw.count() == 36 and csw.filter("dji_close is null").count() == 0
    assert csw.agg({"dji_volume": "max"}).first()[0] == 2.0
    assert {tuple(r) for r in tables["types"].collect()} >= {("total", "bigint", "incidents"), ("temp", "double", "readings"), ("dji_close", "double", "bars")}
    found = jobs.stats(csw, focus="total")
    assert found["base"].count() == found["matrix"].count()
    normal = jobs.normalised({n: tables[n] for n in ("csw", "cw", "cs")}, found["base"], ["temp", "total", "dji_close"])
    assert normal.groupBy("dataset").count().count() == 3
    one = normal.filter("dataset = 'csw'")
    model, history, why = jobs.linear_regression(one, ["temp", "dji_close"], "total", ("2001-01-01", "2001-01-25"), s, 0.1, regress.StopRules(20, rises=5))
    assert why == "epochs" and history[-1][1] < history[0][1]
    rows, summary = jobs.verify_regression(one, model, "total", ("2001-01-26", "2001-02-05"))
    assert rows.count() == 11 and summary.first()["n"] == 11


def test_histories_are_appended_run_by_run(spark, tmp_path):
    s = jobs.Settings("2001-01-01", "2001-02-28", {"volume": 1e6})
    for rate in (0.1, 0.2):
        history = [(k, 1.0 / k, 0.5, {"a": float(k)}) for k in (1, 2, 3)]
        jobs.append_history(spark, str(tmp_path), history, ["b", "a"], "y", ("2001-01-01", "2001-01-31"), s, rate, "epochs")
    rows = spark.read.parquet(f"{tmp_path}/history").orderBy("rate", "epoch").collect()
    assert [(r["rate"], r["epoch"], r["why"]) for r in rows] == [(x, k, "epochs" if k == 3 else None) for x in (0.1, 0.2) for k in (1, 2, 3)]
    assert {(r["start"], r["end"], r["factors"], r["window_start"], r["window_end"], r["x"], r["y"]) for r in rows} == {("2001-01-01", "2001-02-28", "volume:1e+06", "2001-01-01", "2001-01-31", "a,b", "y")}
    assert rows[0]["run_ts"] < rows[-1]["run_ts"]


def test_each_normalised_dataset_has_its_folder(spark, tmp_path):
    df = spark.createDataFrame([("csw", 1.0), ("cw", 2.0), ("cw", 3.0)], "dataset string, a double")
    jobs.write_normalised(df, str(tmp_path))
    assert {f.name for f in (tmp_path / "normalised").iterdir() if f.is_dir()} == {"dataset=csw", "dataset=cw"}
    assert sorted(r["a"] for r in spark.read.parquet(f"{tmp_path}/normalised/dataset=cw").collect()) == [2.0, 3.0]
