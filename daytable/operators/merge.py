"""The daily merge of incidents, readings and price bars."""

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytable.operators.fill import fill_forward


def merge_daily(incidents: DataFrame, readings: DataFrame, bars: DataFrame, day: str = "day", gap: str = "break", bucket: str | None = "month") -> dict[str, DataFrame]:
    """The tables csw, cw and cs: each day seen in any source, with its counts and its readings, bars, or both.

    All three come rolled up to a row per day. Counts of days without incidents are 0; days without bars are filled (see
    fill_forward); days without readings have null readings."""
    counts, filled = ([c for c in df.columns if c != day] for df in (incidents, bars))
    met = incidents.join(readings, day, "full_outer").join(bars, day, "full_outer").na.fill(0, counts)
    csw = fill_forward(met, filled, day, gap=gap, bucket=bucket)
    read = [c for c in readings.columns if c != day]
    return {"csw": csw, "cw": met.select(day, *counts, *read), "cs": csw.select(day, *counts, *filled)}


def record_counts(sources: dict[str, DataFrame], days: dict[str, DataFrame], tables: dict[str, DataFrame], day: str = "day") -> DataFrame:
    """(stage, name, rows, days): what each source read, what it was rolled up to, and what each table came to."""
    out = None
    for stage, of in (("source", sources), ("day", days), ("table", tables)):
        for name, df in of.items():
            row = df.agg(F.lit(stage).alias("stage"), F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), F.count_distinct(day).alias("days"))
            out = row if out is None else out.union(row)
    return out


def warn_unless_reconciled(found: DataFrame) -> None:
    """A warning for each table of reconcile() whose days don't agree with those that came in."""
    for r in found.filter(~F.col("agrees")).collect():  # a row for each table
        warnings.warn(f"table {r['table']} has {r['days']} days of {r['expected']}", stacklevel=2)


def expected_days(inputs: dict[str, DataFrame], day: str = "day") -> DataFrame:
    """(expected): how many distinct days all inputs have."""
    days = None
    for df in inputs.values():
        days = df.select(day) if days is None else days.union(df.select(day))
    return days.distinct().agg(F.count(day).alias("expected"))


def reconcile_counts(inputs: dict[str, DataFrame], counts: dict[str, int], day: str = "day") -> DataFrame:
    """reconcile() of tables whose days were counted already, while they were written."""
    expected = expected_days(inputs, day)
    rows = expected.sparkSession.createDataFrame(list(counts.items()), "table string, days long")
    return rows.crossJoin(F.broadcast(expected)).withColumn("agrees", F.col("days") == F.col("expected"))


def reconcile(inputs: dict[str, DataFrame], outputs: dict[str, DataFrame], day: str = "day") -> DataFrame:
    """(table, days, expected, agrees): each output's days against the distinct days of all inputs."""
    out = None
    for name, df in outputs.items():
        row = df.agg(F.lit(name).alias("table"), F.count_distinct(day).alias("days"))
        out = row if out is None else out.union(row)
    return out.crossJoin(F.broadcast(expected_days(inputs, day))).withColumn("agrees", F.col("days") == F.col("expected"))
