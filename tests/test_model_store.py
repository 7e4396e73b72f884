"""Trainings under one set of rules, stored models, and tables that carry where they came from."""

import datetime

import pytest
from pyspark.sql import functions as F

from daytable.operators import regress
from daytable.plans import jobs
from daytable.sources.tables import read_table


def test_rules_serve_any_number_of_trainings(spark):
    df = spark.createDataFrame([(float(k), 2.0 * k) for k in range(10)], "x double, y double")
    rules = regress.StopRules(30, steady=(3, 2), rises=1)
    runs = [regress.train(df, ["x"], "y", 0.01, rules) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0][1]) > 3
    with pytest.raises(AttributeError):
        rules.epochs = 3


def test_the_time_limit_starts_with_the_training(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0)], "x double, y double")
    now = [0.0]

    def clock():
        now[0] += 30
        return now[0]

    for _ in range(2):  # the clock reads 30 more each time; two minutes are over at the fifth look after the start
        _, history, why = regress.train(df, ["x"], "y", 0.01, regress.StopRules(99, minutes=2), clock=clock)
        assert (len(history), why) == (4, "time")


@pytest.fixture
def stored(spark, tmp_path):
    day = lambda k: datetime.date(2001, 1, 1) + datetime.timedelta(k)
    csw = spark.createDataFrame([(day(k), k % 5, float(k % 7), 3.0 * (k % 5) + 1) for k in range(40)], "day date, a int, b double, total double")
    s = jobs.Settings("2001-01-01", "2001-02-09", {"volume": 1e6})
    merged, root = f"{tmp_path}/merged", f"{tmp_path}/normalised"
    types = spark.createDataFrame([("a", "int", "incidents"), ("b", "double", "readings"), ("total", "double", "incidents")], "name string, type string, source string")
    jobs.write_merged({"csw": csw, "cw": csw.drop("b"), "cs": csw, "types": types}, merged, s)
    jobs.normalising_job(spark, merged, root, s)
    return merged, root, f"{tmp_path}/models", s


def test_a_normalised_table_carries_its_lineage(spark, stored):
    merged, root, _, s = stored
    assert {tuple(r) for r in read_table(spark, root, "types").collect()} == {("a", "double", "int", "incidents"), ("b", "double", "double", "readings"), ("total", "double", "double", "incidents")}
    old, new = (read_table(spark, x, "tags").first() for x in (merged, root))
    assert (old["start"], old["end"], old["factors"]) == (new["start"], new["end"], new["factors"]) and old["run_ts"] < new["run_ts"]
    for other in (("2001-01-02", s.end), (None, s.end)):
        with pytest.raises(ValueError, match="made for"):
            jobs.normalising_job(spark, merged, f"{root}2", jobs.Settings(*other))


def test_verification_reads_what_training_stored(spark, stored):
    _, root, models, s = stored
    train = lambda run, epochs, window=("2001-01-01", "2001-01-25"): jobs.training_job(spark, root, models, ["a", "b"], "total", window, s, 0.5, regress.StopRules(epochs, rises=9), run=run)
    with pytest.raises(ValueError, match="made for"):
        train("outside", 5, ("2001-01-01", "2001-03-01"))
    train("first", 2)
    train("second", 40)
    regress.model_rows(spark, "failed", jobs.utc_now(), regress.Model({"a": 9.0, "b": 9.0}, 9.0), "total", 1).write.mode("append").parquet(f"{models}/models")
    stored_models = read_table(spark, models, "models")
    run, y, model = regress.stored_model(stored_models)
    assert (run, y, set(model.weights)) == ("second", "total", {"a", "b"})
    assert regress.stored_model(stored_models, "first")[2] != model
    for missing in ("failed", "outside"):
        with pytest.raises(ValueError, match=f"no committed model of run {missing}"):
            regress.stored_model(stored_models, missing)
    with pytest.raises(ValueError, match="no committed model"):
        regress.stored_model(stored_models.filter("run = 'failed'"))
    held = ("2001-01-26", "2001-02-09")
    days = read_table(spark, root, "normalised").filter("dataset = 'csw'")
    assert jobs.verification_job(spark, root, models, held)[1].first() == jobs.verify_regression(days, model, "total", held)[1].first()
    history = read_table(spark, models, "history")
    assert {(r["run"], r["epoch"]) for r in regress.best_epoch(history).collect()} == {("first", 2), ("second", 40)}
    runs = regress.history_runs(history).groupBy("run").agg(F.count("*").alias("n"), F.max("flat_run").alias("flat"))
    assert {tuple(r) for r in runs.collect()} == {("first", 2, 0), ("second", 40, 0)}
