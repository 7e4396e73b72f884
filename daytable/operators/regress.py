"""Linear regression of several variables by batch gradient descent."""

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daytable.operators.moments import as_double, co_moments, ratio

HISTORY = "epoch long, cost double, bias double, weights map<string,double>"


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float = 0.0


def first_model(names: list[str], start: float | dict[str, float] = 0.0, bias: float = 0.0) -> Model:
    """Weights from one number for all, or from a number for each; ValueError unless they are exactly those of names."""
    weights = {c: float(start) for c in names} if not isinstance(start, dict) else {c: float(v) for c, v in start.items()}
    check_names(names, weights)
    return Model(weights, bias)


def check_names(names: list[str], weights: dict[str, float]) -> None:
    if set(names) != set(weights):
        raise ValueError(f"without a weight: {sorted(set(names) - set(weights))}; without a variable: {sorted(set(weights) - set(names))}")


def predicted(model: Model) -> Column:
    return sum((F.lit(w) * F.col(c) for c, w in sorted(model.weights.items())), F.lit(model.bias))


def predict(df: DataFrame, model: Model, into: str = "yhat") -> DataFrame:
    """df with the model's prediction; ValueError where df lacks one of its variables."""
    if missing := sorted(set(model.weights) - set(df.columns)):
        raise ValueError(f"no such variables: {missing}")
    return df.withColumn(into, predicted(model))


def gd_step(df: DataFrame, y: str, model: Model, rate: float) -> tuple[Model, float]:
    """One step of descent over all rows, and the cost of the model before it: sum of squared errors / 2N, each row once.

    All partial derivatives and the cost are sums of one aggregation."""
    names = sorted(model.weights)
    rows = as_double(df, [*names, y]).withColumn("__e", predicted(model) - F.col(y))
    e = F.col("__e")
    row = rows.agg(F.count(F.lit(1)).alias("__n"), F.sum(e * e).alias("__ee"), F.sum(e).alias("__b"), *(F.sum(F.col(c) * e).alias(c) for c in names)).first()
    n = row["__n"]
    if not n:
        raise ValueError("no rows to train on")
    return Model({c: model.weights[c] - rate * row[c] / n for c in names}, model.bias - rate * row["__b"] / n), row["__ee"] / (2 * n)


@dataclass(frozen=True)
class StopRules:
    """When training ends. Before an epoch: `steady` (decimals, epochs) says that weights, bias and cost were equal to so
    many decimals so often running; then `minutes` from the training's start. After it: the cost was no new minimum for `rises`
    epochs running, where the first one after a fall does not count and 0 means the first that does; then the cost reached the
    target; then the number of epochs. Rules are limits only and serve any number of trainings (see Watch)."""

    epochs: int
    target_cost: float = 0.0
    steady: tuple[int, int] | None = None
    rises: int = 0
    minutes: float | None = None

    def __post_init__(self):
        if self.epochs < 1:
            raise ValueError("training needs a limit of epochs")


class Watch:
    """What one training has seen, held against its rules. The clock, in seconds, starts with it."""

    def __init__(self, rules: StopRules, clock: Callable[[], float] = time.monotonic):
        self.rules, self.clock = rules, clock
        self.until = clock() + 60 * rules.minutes if rules.minutes else None
        self.least, self.run, self.same, self.seen = float("inf"), 0, 0, None

    def before(self, state: list[float] | None) -> str | None:
        steady = self.rules.steady
        if steady and state is not None:
            cut = [int(x * 10 ** steady[0]) if np.isfinite(x) else x for x in state]
            self.same = self.same + 1 if cut == self.seen else 0
            self.seen = cut
            if self.same == steady[1]:
                return "steady"
        return "time" if self.until is not None and self.clock() > self.until else None

    def after(self, epoch: int, cost: float) -> str | None:
        if cost < self.least:
            self.least = cost
            self.run = 0 if self.run > 0 else self.run - 1
        elif self.run < 0:
            self.run = 0
        else:
            self.run += 1
            if self.run >= self.rules.rises:
                return "rising"
        if cost <= self.rules.target_cost:
            return "cost"
        return "epochs" if epoch >= self.rules.epochs else None


def train(df: DataFrame, names: list[str], y: str, rate: float, rules: StopRules, start: float | dict[str, float] = 0.0, bias: float = 0.0, clock: Callable[[], float] = time.monotonic) -> tuple[Model, list[tuple], str]:
    """(last model, history, why it ended). History: epoch, the cost of the weights before its update, bias and weights
    after it.

    The squared loss of all rows is a quadratic form, so one pass over df for the sums of products gives every epoch
    exactly; the epochs themselves are arithmetic on (k + 1) x (k + 1) numbers. Missing values are 0."""
    names, watch = sorted(names), Watch(rules, clock)
    model = first_model(names, start, bias)
    order = [*names, y]
    g, s, n = np.zeros((len(order), len(order))), np.zeros(len(order)), 0
    at = {c: i for i, c in enumerate(order)}
    for r in co_moments(df, order).collect():  # (k + 1)(k + 2) / 2 rows
        i, j, n = at[r["x"]], at[r["y"]], r["n"]
        g[i, j] = g[j, i] = r["sxy"]
        s[i], s[j] = r["sx"], r["sy"]
    if not n:
        raise ValueError("no rows to train on")
    a = np.block([[g[:-1, :-1], s[:-1, None]], [s[None, :-1], np.array([[float(n)]])]])
    c, yy = np.append(g[:-1, -1], s[-1]), g[-1, -1]
    w = np.array([*(model.weights[k] for k in names), model.bias])
    history, epoch, state = [], 0, None
    while True:
        if why := watch.before(state):
            break
        epoch += 1
        cost = float(w @ a @ w - 2 * w @ c + yy) / (2 * n)
        w = w - rate * (a @ w - c) / n
        history.append((epoch, cost, float(w[-1]), dict(zip(names, w[:-1].tolist(), strict=True))))
        state = [*w.tolist(), cost]
        if why := watch.after(epoch, cost):
            break
    return Model(history[-1][3], history[-1][2]) if history else model, history, why


def history_table(spark: SparkSession, history: list[tuple]) -> DataFrame:
    return spark.createDataFrame(history, HISTORY)


def run_of(history: DataFrame) -> list[str]:
    """The column that tells the runs of a history apart, where it has one."""
    return ["run"] if "run" in history.columns else []


def history_runs(history: DataFrame, decimals: int = 10) -> DataFrame:
    """(run, epoch, cost, least, improved, steady_run, flat_run): for each epoch of a run the least cost so far, whether this one
    brought it, for how many epochs running the cost was the same to `decimals`, and for how many it brought no new minimum.
    A history without a column `run` is one run."""
    run = run_of(history)
    order = Window.partitionBy(*run).orderBy("epoch")
    rows = history.select(*run, "epoch", "cost", F.floor(F.col("cost") * F.lit(10.0**decimals)).alias("cut"))
    rows = rows.withColumns({"least": F.min("cost").over(order.rowsBetween(Window.unboundedPreceding, 0)), "before": F.min("cost").over(order.rowsBetween(Window.unboundedPreceding, -1))})
    rows = rows.withColumns({"improved": F.coalesce(F.col("cost") < F.col("before"), F.lit(True)), "same": F.coalesce(F.col("cut") == F.lag("cut").over(order), F.lit(False))})
    begun = lambda flag: F.sum(F.when(flag, F.lit(0)).otherwise(F.lit(1))).over(order)
    rows = rows.withColumns({"island": begun(F.col("same")), "stretch": begun(~F.col("improved"))})
    count = lambda flag, by: F.sum(flag.cast("long")).over(Window.partitionBy(*run, by).orderBy("epoch"))
    return rows.select(*run, "epoch", "cost", "least", "improved", count(F.col("same"), "island").alias("steady_run"), count(~F.col("improved"), "stretch").alias("flat_run"))


def best_epoch(history: DataFrame) -> DataFrame:
    """(run, epoch, cost) of least cost in each run; without a column `run` of all epochs."""
    return history.groupBy(*run_of(history)).agg(F.min_by("epoch", F.struct("cost", "epoch")).alias("epoch"), F.min("cost").alias("cost"))


MODELS = "run string, written_ts timestamp_ntz, y string, epoch long, committed boolean, name string, weight double"


def model_rows(spark: SparkSession, run: str, now, model: Model, y: str, epoch: int) -> DataFrame:
    """A model as rows to append to a table of models: a weight each, the bias under the name null. None of them counts until the
    run's last row, of commit_row, is there too."""
    rows = [(run, now, y, epoch, False, name, weight) for name, weight in sorted(model.weights.items())]
    return spark.createDataFrame([*rows, (run, now, y, epoch, False, None, model.bias)], MODELS)


def commit_row(spark: SparkSession, run: str, now, y: str, epoch: int) -> DataFrame:
    return spark.createDataFrame([(run, now, y, epoch, True, None, None)], MODELS)


def stored_model(models: DataFrame, run: str | None = None) -> tuple[str, str, Model]:
    """(run, y, model) of the run that was committed last, or of the one named; ValueError where there is none. Rows of runs that
    failed before they were committed don't count."""
    committed = models.filter("committed")
    last = (committed.filter(F.col("run") == run) if run else committed).orderBy(F.col("written_ts").desc(), F.col("run").desc()).select("run", "y").first()
    if last is None:
        raise ValueError(f"no committed model of run {run}" if run else "no committed model")
    rows = models.filter((F.col("run") == last["run"]) & ~F.col("committed")).collect()  # a row for each variable
    weights = {r["name"]: r["weight"] for r in rows if r["name"] is not None}
    return last["run"], last["y"], Model(weights, next(r["weight"] for r in rows if r["name"] is None))


def verify(df: DataFrame, model: Model, y: str) -> tuple[DataFrame, DataFrame]:
    """(rows, summary) of a hold-out: y, yhat, ssr, sse and sst for each row; n, r_squared (SSR / SST, which can pass 1),
    r_bar_squared, regression_std_err, and r2_residual (1 - SSE / SST). The mean is the hold-out's. Measures without degrees
    of freedom are null."""
    held = as_double(df, [*sorted(model.weights), y])
    mean = held.agg(F.avg(y).alias("__mean"))
    scored = predict(held, model).join(F.broadcast(mean)).select(F.col(y).alias("y"), "yhat", "__mean")
    square = lambda a, b: (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
    rows = scored.select("y", "yhat", square("yhat", "__mean").alias("ssr"), square("y", "yhat").alias("sse"), square("y", "__mean").alias("sst"))
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in ("ssr", "sse", "sst")))
    free = F.col("n") - len(model.weights) - 1
    r2 = ratio(F.col("ssr"), F.col("sst"))
    some = F.when(free > 0, free)
    bar = 1 - ratio(F.col("n") - 1, some) * (1 - r2)
    return rows, sums.select("n", r2.alias("r_squared"), bar.alias("r_bar_squared"), F.sqrt(ratio(F.col("sse"), some)).alias("regression_std_err"), (1 - ratio(F.col("sse"), F.col("sst"))).alias("r2_residual"))
