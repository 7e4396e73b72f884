"""The jobs: sources to day tables, day tables to statistics and models."""

import datetime
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from daytable.functions.scalars import apply_factors, in_range, select_vars, window_inside
from daytable.operators import correlate, daily, matrix, merge, moments, normalise, regress
from daytable.sources.shared import cut
from daytable.sources.tables import catalogue, check_tags, factor_text, inherited_catalogue, read_table, tags, write_table

FLOATS = ["temp", "feels_like", "temp_min", "temp_max", "wind_speed", "rain_1h", "rain_3h", "snow_1h", "snow_3h"]
INTS = ["pressure", "humidity", "wind_deg", "clouds_all"]
MODE = ("weather_id", ["weather_main", "weather_description"])
IDS = ["IXIC", "DJI", "GSPC"]
BAR = ["open", "high", "low", "close", "adjclose", "volume"]


@dataclass(frozen=True)
class Settings:
    """Date range (both bounds included, None for none) and the factors that columns are divided by."""

    start: str | None = None
    end: str | None = None
    factors: dict[str, float] = field(default_factory=dict)


def weather(readings: DataFrame, s: Settings, floats: list[str] = FLOATS, ints: list[str] = INTS, mode: tuple[str, list[str]] = MODE) -> tuple[DataFrame, DataFrame]:
    """(daily readings, ordinals of the conditions within the date range). One row a day: means, and the most frequent
    condition with what describes it. Readings are read once, into counts and sums by day and condition."""
    rows = in_range(apply_factors(readings, s.factors), s.start, s.end)
    key, payload = mode
    parts = cut(daily.daily_parts(rows, floats, ints, key, payload))
    days = daily.means_of(parts, floats, ints).join(daily.top_of(parts, ["day"], key, payload).drop("n"), "day")
    return days, daily.ordinal_map(parts, key)


def stocks(bars: DataFrame, s: Settings, ids: list[str] = IDS, fields: list[str] = BAR) -> DataFrame:
    """One row a day with <id>_<field> for each series."""
    return daily.bars_wide(in_range(apply_factors(bars, s.factors), s.start, s.end), ids, fields)


def crime(incidents: DataFrame, s: Settings, category: str = "fbicode", values: list[str] | None = None) -> DataFrame:
    """One row a day with a count for each category and their total."""
    return daily.daily_categories_wide(in_range(incidents, s.start, s.end), category=category, values=values)


def merge_inputs(incidents: DataFrame, readings: DataFrame, bars: DataFrame, s: Settings, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three day tables that are merged, cut."""
    pick = lambda *names: {n: how[n] for n in names if n in how}
    days, ordinals = weather(readings, s, **pick("floats", "ints", "mode"))
    days = daily.apply_ordinal(days, ordinals, how.get("mode", MODE)[0])
    return cut(crime(incidents, s, **pick("category", "values"))), cut(days), cut(stocks(bars, s, **pick("ids", "fields")))


def merged(incidents: DataFrame, readings: DataFrame, bars: DataFrame, s: Settings, **how) -> dict[str, DataFrame]:
    """csw, cw, cs and their catalogue `types`, from rows as the sources have them; how: category, values, floats, ints, mode,
    ids, fields, gap. Each source is read once: its day table is cut before it is merged and filled."""
    pick = lambda *names: {n: how[n] for n in names if n in how}
    counts, days, wide = merge_inputs(incidents, readings, bars, s, **pick("category", "values", "floats", "ints", "mode", "ids", "fields"))
    out = merge.merge_daily(counts, days, wide, **pick("gap"))
    of = {c: n for n, df in (("incidents", counts), ("readings", days), ("bars", wide)) for c in df.columns if c != "day"}
    return out | {"types": catalogue(out["csw"], of)}


def write_merged(tables: dict[str, DataFrame], root: str, s: Settings, inputs: dict[str, DataFrame] | None = None) -> None:
    """The tables of merged() with their tags. Given the inputs, each table's days, which have a row each and are counted while they are
    written, are held against theirs, with a warning where they differ."""
    seen = {name: Observation() for name, df in tables.items() if inputs and "day" in df.columns}
    for name, df in tables.items():
        write_table(df.observe(seen[name], F.count("day").alias("days")) if name in seen else df, root, name)
    spark = next(iter(tables.values())).sparkSession
    write_table(tags(spark, s.start, s.end, s.factors), root, "tags")
    if inputs:
        merge.warn_unless_reconciled(merge.reconcile_counts(inputs, {name: found.get["days"] for name, found in seen.items()}))


def read_merged(spark, root: str, name: str, s: Settings, mode: str = "exact") -> DataFrame:
    """A table of an earlier job, after its tags have been checked against the settings."""
    check_tags(read_table(spark, root, "tags"), s.start, s.end, s.factors, mode)
    return read_table(spark, root, name)


def stats(df: DataFrame, variables: str | list[str] = "numeric", focus: str | None = None) -> dict[str, DataFrame]:
    """base, pairs, correlations, matrix and tiers of a day table, which is read once."""
    names = select_vars(df, variables)
    sums = cut(moments.co_moments(df, names))
    pairs = correlate.correlations_of(sums)
    return {
        "base": moments.base_of(sums),
        "pairs": moments.products_of(sums),
        "correlations": pairs,
        "matrix": correlate.correlation_matrix(pairs, names),
        "tiers": correlate.correlation_tiers(pairs, focus),
    }


def normalised(tables: dict[str, DataFrame], base: DataFrame, names: list[str]) -> DataFrame:
    """csw, cw and cs, each normalised by the statistics of csw, one under the other with their name as `dataset`; a table
    takes part in the variables that it has. Written with partitionBy("dataset"), each can be read alone."""
    each = [normalise.normalise(df, base, [n for n in names if n in df.columns]).withColumn("dataset", F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each)


def write_normalised(table: DataFrame, root: str, name: str = "normalised", lineage: str | None = None) -> None:
    """The datasets of normalised(), a folder for each, so that a model reads its own alone. With `lineage`, the folder of the job that
    wrote what was normalised, its tags are carried on and its catalogue with the types as they are now."""
    write_table(table, root, name, partition_by=["dataset"])
    if lineage:
        spark = table.sparkSession
        write_table(inherited_catalogue(read_table(spark, lineage, "types"), table, leave=("day", "dataset")), root, "types")
        write_table(read_table(spark, lineage, "tags").withColumn("run_ts", F.lit(utc_now()).cast("timestamp_ntz")), root, "tags")


def linear_regression(df: DataFrame, x: list[str], y: str, window: tuple[str, str], s: Settings, rate: float, rules: regress.StopRules, **start) -> tuple[regress.Model, list[tuple], str]:
    """Training on the days of the window, which lies inside the settings' range."""
    window_inside(window, (s.start, s.end))
    return regress.train(in_range(df, *window), x, y, rate, rules, **start)


def verify_regression(df: DataFrame, model: regress.Model, y: str, window: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """The model on the days of a hold-out window."""
    return regress.verify(in_range(df, *window), model, y)


def utc_now() -> datetime.datetime:
    return datetime.datetime.now(datetime.UTC).replace(tzinfo=None)


def append_history(spark: SparkSession, root: str, history: list[tuple], x: list[str], y: str, window: tuple[str, str], s: Settings, rate: float, why: str, name: str = "history", run: str | None = None) -> None:
    """A run's epochs at the end of the history table under root, after those of earlier runs: its id, when it ran, its settings
    (range, factors, window, variables, rate), then each epoch, and why the last one was."""
    now = utc_now()
    about = {"run": F.lit(run or uuid.uuid4().hex), "run_ts": F.lit(now).cast("timestamp_ntz"), "start": F.lit(s.start).cast("string"), "end": F.lit(s.end).cast("string"), "factors": F.lit(factor_text(s.factors)), "window_start": F.lit(window[0]), "window_end": F.lit(window[1]), "x": F.lit(",".join(sorted(x))), "y": F.lit(y), "rate": F.lit(float(rate))}
    rows = regress.history_table(spark, history)
    ended = F.when(F.col("epoch") == len(history), F.lit(why)).alias("why")
    rows.select(*(c.alias(n) for n, c in about.items()), *rows.columns, ended).coalesce(1).write.mode("append").parquet(f"{root}/{name}")


def training_job(spark: SparkSession, root: str, to: str, x: list[str], y: str, window: tuple[str, str], s: Settings, rate: float, rules: regress.StopRules, dataset: str = "csw", run: str | None = None, **start) -> str:
    """Trains on a dataset that write_normalised wrote under root, whose tags must hold the window, and appends to the tables under
    `to`: the run's history, then its model, then the row that commits it. Returns the run's id. A run that fails before that row
    leaves models as they were to all who read them."""
    check_tags(read_table(spark, root, "tags"), *window, mode="within")
    run = run or uuid.uuid4().hex
    model, history, why = linear_regression(read_table(spark, root, "normalised").filter(F.col("dataset") == dataset), x, y, window, s, rate, rules, **start)
    append_history(spark, to, history, x, y, window, s, rate, why, run=run)
    put = lambda rows: rows.coalesce(1).write.mode("append").parquet(f"{to}/models")
    put(regress.model_rows(spark, run, utc_now(), model, y, len(history)))
    put(regress.commit_row(spark, run, utc_now(), y, len(history)))
    return run


def verification_job(spark: SparkSession, root: str, models: str, window: tuple[str, str], dataset: str = "csw", run: str | None = None) -> tuple[DataFrame, DataFrame]:
    """verify_regression with a model that a training job stored under `models`: the one committed last, or that of a run."""
    _, y, model = regress.stored_model(read_table(spark, models, "models"), run)
    return verify_regression(read_table(spark, root, "normalised").filter(F.col("dataset") == dataset), model, y, window)


def normalising_job(spark: SparkSession, root: str, to: str, s: Settings, variables: str | list[str] = "numeric") -> None:
    """Normalises csw, cw and cs as a merge job wrote them under root, whose tags must have the settings' dates, and writes them
    under `to` with their catalogue and the tags they inherit."""
    check_tags(read_table(spark, root, "tags"), s.start, s.end, mode="dates")
    tables = {name: read_table(spark, root, name) for name in ("csw", "cw", "cs")}
    names = select_vars(tables["csw"], variables)
    write_normalised(normalised(tables, moments.base_stats(tables["csw"], names), names), to, lineage=root)


def matrix_multiply(spark, left: tuple[str, tuple[int, int]], right: tuple[str, tuple[int, int]]) -> DataFrame:
    """The product of two matrices in text files, given with their shapes."""
    matrix.check_shapes(left[1], right[1])
    return matrix.matmul(matrix.read_matrix(spark, *left), matrix.read_matrix(spark, *right))
