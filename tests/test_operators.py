import datetime
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from daytable.operators import correlate, daily, fill, matrix, merge, moments, normalise, regress
from daytable.plans import jobs

DAY = datetime.date
#: The counts of one real day; they add up to 1819.
GOLDEN = {"01A": 2, "02": 87, "03": 41, "04A": 28, "04B": 44, "05": 66, "06": 413, "07": 60, "08A": 43, "08B": 252, "10": 12, "11": 73, "12": 7, "14": 233, "15": 32, "16": 5, "17": 68, "18": 89, "19": 2, "20": 44, "22": 3, "24": 4, "26": 211}


def test_categories_of_a_known_day(spark):
    rows = [(DAY(2001, 1, 1), c) for c, n in GOLDEN.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "day date, category string")
    row = daily.daily_categories_wide(df).first().asDict()
    assert row["total"] == 1819 == sum(GOLDEN.values())
    assert row["c_06"] == 413 and row["c_08b"] == 252
    assert daily.daily_categories_wide(df.limit(0), values=["06"]).count() == 0


def test_means_cut_off_toward_zero_and_count_missing_as_zero(spark):
    d = DAY(2001, 1, 1)
    df = spark.createDataFrame([(d, 1.0, -3), (d, None, None), (d, 2.0, -4)], "day date, x float, n int")
    assert tuple(daily.daily_means(df, ["x"], ["n"]).first()) == (d, 1.0, -2)


def test_mode_ties(spark):
    d = DAY(2001, 1, 1)
    rows = [(d, 800, "Clear", "a"), (d, 800, "Clear", "b"), (d, 500, "Rain", "x"), (d, 500, "Rain", "y"), (d, 900, "Odd", "z")]
    df = spark.createDataFrame(rows, "day date, id int, main string, description string")
    pick = lambda **k: tuple(daily.mode_per_group(df, ["day"], "id", ["main", "description"], **k).first())[1:]
    assert pick() == (500, 2, "Rain", "y")
    assert pick(tie="high") == (800, 2, "Clear", "b")
    assert pick(which="lowest") == (900, 1, "Odd", "z")
    ordinals = daily.ordinal_map(df, "id")
    assert [tuple(r) for r in ordinals.orderBy("id").collect()] == [(500, 0), (800, 1), (900, 2)]
    unknown = spark.createDataFrame([(800,), (1,)], "id int")
    assert sorted(str(r[0]) for r in daily.apply_ordinal(unknown, ordinals, "id").collect()) == ["1", "None"]


def brute_fill(rows: list[tuple], gap: str) -> dict:
    """day -> record, handing on from day to day."""
    out, state, last = {}, None, None
    first = next(r for _, r in rows if r is not None)
    for day, record in rows:
        if gap == "break" and last is not None and (day - last).days > 1:
            state = None
        state = record if record is not None else state
        out[day] = state or first
        last = day
    return out


@pytest.mark.parametrize(("gap", "bucket"), list(itertools.product(["break", "carry"], [None, "month", "year"])))
def test_fill_against_brute_force(spark, gap, bucket):
    rng = random.Random(1)
    days = [DAY(2001, 1, 1) + datetime.timedelta(k) for k in range(200) if rng.random() < 0.8 and not 40 < k < 110]
    rows = [(d, (float(k), None if rng.random() < 0.3 else float(-k)) if rng.random() < 0.3 else None) for k, d in enumerate(days)]
    df = spark.createDataFrame([(s, d, *((r or (None, None)))) for s in ("p", "q") for d, r in rows], "s string, day date, a double, b double")
    want = brute_fill(rows, gap)
    got = fill.fill_forward(df, ["a", "b"], by=("s",), gap=gap, bucket=bucket)
    assert {(r["s"], r["day"]): (r["a"], r["b"]) for r in got.collect()} == {(s, d): w for s in ("p", "q") for d, w in want.items()}
    one = fill.fill_forward(df.filter("s = 'p'").drop("s"), ["a", "b"], gap=gap, bucket=bucket)
    assert {r["day"]: (r["a"], r["b"]) for r in one.collect()} == want


def test_merge_of_days_that_sources_lack(spark):
    day = lambda k: DAY(2001, 1, k)
    incidents = spark.createDataFrame([(day(1), 5, 5), (day(2), 1, 1)], "day date, c_x long, total long")
    readings = spark.createDataFrame([(day(1), 1.0), (day(3), 3.0)], "day date, temp double")
    bars = spark.createDataFrame([(day(2), 10.0)], "day date, dji_close double")
    out = merge.merge_daily(incidents, readings, bars)
    assert sorted(map(tuple, out["csw"].collect())) == [(day(1), 5, 5, 1.0, 10.0), (day(2), 1, 1, None, 10.0), (day(3), 0, 0, 3.0, 10.0)]
    assert out["cw"].columns == ["day", "c_x", "total", "temp"] and out["cs"].columns == ["day", "c_x", "total", "dji_close"]
    assert all(r["agrees"] and r["days"] == 3 for r in merge.reconcile({"a": incidents, "b": readings, "c": bars}, out).collect())
    counted = merge.reconcile_counts({"a": incidents, "b": readings, "c": bars}, {"csw": 3, "cw": 2})
    assert sorted(map(tuple, counted.collect())) == [("csw", 3, 3, True), ("cw", 2, 3, False)]


def _numbers(spark):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), None if k % 9 == 0 else int(c), -5.0 - float(abs(a)), 7) for k, (a, b, c) in enumerate(rng.normal(size=(60, 3)) * [1, 1e4, 10] + [0, 1e4, 0])]
    return spark.createDataFrame(rows, "a double, b double, n int, low double, same int"), np.array([[0.0 if x is None else x for x in r] for r in rows], float)


def test_moments_and_products_against_numpy(spark):
    df, x = _numbers(spark)
    names = ["a", "b", "n", "low", "same"]
    base = {r["x"]: r for r in moments.base_stats(df, names).collect()}
    for k, c in enumerate(names):
        v = x[:, k]
        r = base[c]
        assert (r["cnt"], r["zero"], r["sq_zero"]) == (60, (v == 0).sum(), (v == 0).sum())
        assert [r[s] for s in ("sum", "mean", "min", "max", "sq_sum", "var", "stddev")] == pytest.approx([v.sum(), v.mean(), v.min(), v.max(), (v * v).sum(), v.var(), v.std()])
    assert base["low"]["max"] < 0  # a column of negative numbers has a negative maximum
    for r in moments.pair_products(df, names).collect():
        p = x[:, names.index(r["x"])] * x[:, names.index(r["y"])]
        assert (r["prd_cnt"], r["prd_zero"]) == (60, (p == 0).sum())
        assert (r["prd_sum"], r["prd_mean"]) == pytest.approx((p.sum(), p.mean()))
    assert moments.pair_products(df.limit(0), names).count() == 0


def test_correlations_matrix_and_tiers(spark):
    df, x = _numbers(spark)
    names = ["a", "b", "n", "low", "same"]
    found = correlate.correlations(df, names)
    for r in found.collect():
        if "same" in (r["x"], r["y"]):
            assert r["r"] is None
        else:
            assert r["r"] == pytest.approx(np.corrcoef(x[:, names.index(r["x"])], x[:, names.index(r["y"])])[0, 1])
    square = {r["x"]: r for r in correlate.correlation_matrix(found, names).collect()}
    assert square["a"]["a"] is None and square["a"]["b"] == square["b"]["a"]
    rows = [("a", "b", 0.95), ("a", "c", -0.85), ("b", "c", 0.5), ("b", "d", 0.1), ("c", "d", None), ("a", "total", 1.0005), ("d", "total", 1.5)]
    tiers = correlate.correlation_tiers(spark.createDataFrame(rows, "x string, y string, r double"))
    assert {(r["x"], r["y"]): r["tier"] for r in tiers.collect()} == {("a", "b"): "0.9-1.0", ("a", "c"): "0.8-0.9", ("b", "c"): "0.5-0.6", ("b", "d"): "0.0-0.5", ("c", "d"): "anomaly", ("a", "total"): "0.9-1.0", ("d", "total"): "anomaly"}
    assert correlate.correlation_tiers(spark.createDataFrame(rows, "x string, y string, r double"), "total").count() == 2


def test_normalise(spark):
    df = spark.createDataFrame([(1.0, 5, "s"), (3.0, 5, None), (None, 5, "t")], "a double, same int, s string")
    stats = spark.createDataFrame([("a", 1.0, 3.0), ("same", 5.0, 5.0), ("gone", 0.0, 2.0), ("s", 0.0, 1.0)], "x string, min double, max double")
    rows = [tuple(r) for r in normalise.normalise(df, stats, ["a", "same", "gone", "s"]).collect()]
    assert rows == [(0.0, 5.0, "s", 0.0), (1.0, 5.0, None, 0.0), (0.0, 5.0, "t", 0.0)]


def test_training_equals_single_steps(spark):
    rng = np.random.default_rng(4)
    x = rng.random((50, 2))
    df = spark.createDataFrame([(*map(float, r), float(r @ [2, -1] + 0.5)) for r in x], "p double, q double, y double")
    model, history, why = regress.train(df, ["q", "p"], "y", 0.3, regress.StopRules(4, rises=5), {"p": 0.1, "q": 0.2}, 0.05)
    step = regress.first_model(["p", "q"], {"p": 0.1, "q": 0.2}, 0.05)
    for epoch, cost, bias, weights in history:
        step, before = regress.gd_step(df, "y", step, 0.3)
        assert cost == pytest.approx(before) and bias == pytest.approx(step.bias) and weights == pytest.approx(step.weights)
    assert (why, len(history), model.weights) == ("epochs", 4, history[-1][3])
    rows, summary = regress.verify(df, model, "y")
    got, y = summary.first(), x @ [2, -1] + 0.5
    yhat = x @ [model.weights["p"], model.weights["q"]] + model.bias
    sst = ((y - y.mean()) ** 2).sum()
    assert got["r_squared"] == pytest.approx(((yhat - y.mean()) ** 2).sum() / sst)
    assert got["r2_residual"] == pytest.approx(1 - ((y - yhat) ** 2).sum() / sst)
    assert got["regression_std_err"] == pytest.approx(np.sqrt(((y - yhat) ** 2).sum() / 47))
    assert rows.count() == 50
    assert regress.verify(df.limit(3), model, "y")[1].first()["r_bar_squared"] is None


def test_names_and_rules_that_do_not_fit(spark):
    with pytest.raises(ValueError):
        regress.first_model(["a"], {"b": 1.0})
    with pytest.raises(ValueError):
        regress.predict(spark.range(1), regress.Model({"a": 1.0}))
    with pytest.raises(ValueError):
        regress.StopRules(0)


def run_rules(costs: list[float], **how) -> tuple[int, str]:
    rules, state = regress.Watch(regress.StopRules(**({"epochs": 99, "target_cost": -1.0} | how))), None
    for epoch, cost in enumerate(costs, 1):
        if why := rules.before(state):
            return epoch - 1, why
        state = [cost]
        if why := rules.after(epoch, cost):
            return epoch, why
    return len(costs), rules.before(state) or "none"


def test_stop_rules():
    assert run_rules([5, 4, 3, 2], epochs=3) == (3, "epochs")
    assert run_rules([5, 4, 3], target_cost=4) == (2, "cost")
    assert run_rules([5, 4, 6, 7, 8], rises=2) == (5, "rising")  # the first rise after falls is not counted
    assert run_rules([5, 4, 6, 7], rises=0) == (4, "rising")
    assert run_rules([3.14159, 3.14158, 3.14157, 2.0], steady=(2, 2)) == (3, "steady")
    assert run_rules([3, 2, 1], steady=(2, 2))[1] == "none"


def test_history_runs(spark):
    history = regress.history_table(spark, [(k, float(c), 0.0, {"a": 1.0}) for k, c in enumerate([5, 4, 4, 4, 6, 3], 1)])
    rows = [tuple(r) for r in regress.history_runs(history).orderBy("epoch").collect()]
    assert [r[2:] for r in rows] == [(5, True, 0, 0), (4, True, 0, 0), (4, False, 1, 1), (4, False, 2, 2), (4, False, 0, 3), (3, True, 0, 0)]
    assert tuple(regress.best_epoch(history).first()) == (6, 3.0)


def test_products_of_matrices(spark, tmp_path):
    a, b = np.arange(6.0).reshape(2, 3) - 2, np.arange(12.0).reshape(3, 4)
    for name, m in (("a", a), ("b", b)):
        (tmp_path / name).write_text("# comment\n\n" + "\n".join(", ".join(map(str, r)) for r in m) + "\n")
    want = {(i, j): v for (i, j), v in np.ndenumerate(a @ b)}
    got = jobs.matrix_multiply(spark, (f"{tmp_path}/a", (2, 3)), (f"{tmp_path}/b", (3, 4)))
    assert {(r["i"], r["j"]): r["v"] for r in got.collect()} == want
    m = [matrix.read_matrix(spark, f"{tmp_path}/{n}", s) for n, s in (("a", (2, 3)), ("b", (3, 4)))]
    blocks = matrix.matmul_blocks(*m, size=2)
    assert {(r["i"], r["j"]): r["v"] for r in blocks.collect()} == {k: v for k, v in want.items() if v}
    with pytest.raises(ValueError):
        matrix.read_matrix(spark, f"{tmp_path}/a", (3, 3))
    with pytest.raises(ValueError):
        jobs.matrix_multiply(spark, ("a", (2, 3)), ("b", (2, 4)))


def test_categories_whose_columns_would_share_a_name_and_those_left_out(spark):
    d = DAY(2001, 1, 1)
    df = spark.createDataFrame([(d, c) for c in ["A-B", "A B", "a b", "A B", "z", None]], "day date, category string")
    row = daily.daily_categories_wide(df, values=["A-B", "A B", "a b"]).first().asDict()
    assert row == {"day": d, "c_a_b": 2, "c_a_b_2": 1, "c_a_b_3": 1, "total": 6}
    assert daily.daily_categories_wide(df).first()["total"] == 6


def test_parts_give_means_and_modes(spark):
    d = DAY(2001, 1, 1)
    rows = [(d, 1.0, -3, 8, "x"), (d, None, None, 8, "y"), (d, 2.0, -4, 5, "z"), (DAY(2001, 1, 2), 5.0, 1, None, "n")]
    df = spark.createDataFrame(rows, "day date, x float, n int, id int, text string").withColumnRenamed("n", "k")
    parts = daily.daily_parts(df, ["x"], ["k"], "id", ["text"])
    by_day = lambda df: sorted(map(tuple, df.collect()))
    assert by_day(daily.means_of(parts, ["x"], ["k"])) == by_day(daily.daily_means(df, ["x"], ["k"]))
    assert by_day(daily.top_of(parts, ["day"], "id", ["text"])) == by_day(daily.mode_per_group(df, ["day"], "id", ["text"]))
    lacks = daily.unknown_keys(df, spark.createDataFrame([(5, 0)], "id int, ordinal int"), "id")
    assert {tuple(r) for r in lacks.collect()} == {(8, 2), (None, 1)}


def test_matrix_files_of_several_blocks_keep_their_order(spark, tmp_path):
    n = 4000
    (tmp_path / "m.txt").write_text("# head\n" + "".join(f"{k},{-k}\n" + ("\n#\n" if k % 7 == 0 else "") for k in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5k")
    try:
        found = matrix.read_matrix(spark, f"{tmp_path}/m.txt", (n, 2))
        assert spark.read.text(f"{tmp_path}/m.txt").select("_metadata.file_block_start").distinct().count() > 3
        assert {(r["i"], r["j"], r["v"]) for r in found.collect()} == {(k, j, float(k if j == 0 else -k)) for k in range(n) for j in (0, 1)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("shape", [(37, 5, 70), (3, 900, 4)])
def test_products_of_dense_blocks(spark, shape, monkeypatch):
    monkeypatch.setattr(matrix, "ROWS_PER_DEAL", 2)
    rng = np.random.default_rng(0)
    a, b = rng.integers(-3, 4, shape[:2]), rng.integers(-3, 4, shape[1:])
    table = lambda m: spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(m)], "i long, j long, v double")
    got = np.zeros((shape[0], shape[2]))
    for r in matrix.matmul_blocks(table(a), table(b), size=8).collect():
        got[r["i"], r["j"]] += r["v"]
    assert (got == a @ b).all()
