"""Filling days that have no record from the days before."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_forward(df: DataFrame, cols: list[str], day: str = "day", by: tuple[str, ...] = (), gap: str = "break", bucket: str | None = "month") -> DataFrame:
    """df with cols of rows where all of them are null taken from the record before, or else from the first record.

    cols are one record: a row that has some of them is not topped up. With gap="break" a record is handed on from day to
    day as long as no calendar day is missing; what comes after a missing day starts without one and, like days before the
    first record, takes the earliest record of all. gap="carry" hands on across missing days.

    A long series is not sorted in one task: rows are filled inside buckets (year or month). One aggregation says of each
    bucket when it begins and ends, what it ends with and which record comes first; these few rows are filled along the
    series, and each bucket takes what its predecessors hand on. bucket=None does it in one.
    """
    names = list(by)
    record = F.struct(*cols)
    has = F.coalesce(*(F.col(c) for c in cols)).isNotNull()
    part = Window.partitionBy(*names, "__part").orderBy(day)
    broken = F.coalesce(F.datediff(F.col(day), F.lag(day).over(part)) > 1, F.lit(False)) if gap == "break" else F.lit(False)
    # a state is a record, or nothing after a missing day; null where a day changes nothing
    rows = df.withColumn("__part", F.lit(0) if bucket is None else F.trunc(day, bucket))
    rows = rows.withColumn("__state", F.when(has, F.struct(record.alias("record"))).when(broken, F.struct(F.when(has, record).alias("record"))))
    state = F.col("__state")
    of_bucket = rows.groupBy(*names, "__part").agg(
        F.min(day).alias("begin"), F.max(day).alias("end"), F.max_by(state, F.when(state.isNotNull(), F.col(day))).alias("state"),
        F.min_by(record, F.when(has, F.col(day))).alias("first"),
    )
    series = Window.partitionBy(*names).orderBy("__part")
    late = F.datediff("begin", F.lag("end").over(series)) > 1 if gap == "break" else F.lit(False)
    ends = of_bucket.withColumn("late", F.coalesce(late, F.lit(False)))
    nothing = F.struct(F.lit(None).cast(df.select(record).schema[0].dataType).alias("record"))
    ends = ends.withColumn("out", F.coalesce("state", F.when(F.col("late"), nothing)))
    handed = F.last("out", True).over(series.rowsBetween(Window.unboundedPreceding, -1))
    whole = series.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = ends.select(*names, "__part", F.when(F.col("late"), nothing).otherwise(handed).alias("__handed"), F.first("first", True).over(whole).alias("__first"))
    met = _joined(rows, known, [*names, "__part"])
    within = F.last("__state", True).over(part.rowsBetween(Window.unboundedPreceding, 0))
    met = met.withColumn("__taken", F.coalesce(F.coalesce(within, "__handed")["record"], F.col("__first")))
    return met.withColumns({c: F.when(has, F.col(c)).otherwise(F.col("__taken")[c]) for c in cols}).select(*df.columns)


def _joined(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    renamed = small.select(*(F.col(c).alias(f"__on_{c}") for c in on), *(c for c in small.columns if c not in on))
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"__on_{c}"))
    return rows.join(renamed, same, "left").drop(*(f"__on_{c}" for c in on))
