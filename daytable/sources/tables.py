"""Named output tables, their catalogue and the tags that say what they were made from."""

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Types that a catalogue may hold.
TYPES = ("int", "bigint", "float", "double", "string", "date")


def write_table(df: DataFrame, root: str, name: str, partition_by: list[str] | None = None, files: int | None = None) -> None:
    """df as the table `name` under root, in place of what was there; `files` for day tables that would be many small ones."""
    (df.coalesce(files) if files else df).write.mode("overwrite").parquet(f"{root}/{name}", partitionBy=partition_by)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def catalogue(df: DataFrame, sources: dict[str, str] | None = None, default: str = "", leave: tuple[str, ...] = ("day",)) -> DataFrame:
    """(name, type, source) of df's columns, sorted by name."""
    rows = sorted((n, kind, (sources or {}).get(n, default)) for n, kind in df.dtypes if n not in leave)
    return df.sparkSession.createDataFrame(rows, "name string, type string, source string")


def inherited_catalogue(types: DataFrame, df: DataFrame, leave: tuple[str, ...] = ("day",)) -> DataFrame:
    """(name, type, was, source) of the columns that df took from a table with the catalogue `types`: what they are now, what they were,
    and where they came from. A column that the catalogue lacks was nothing and comes from nowhere."""
    now = catalogue(df, leave=leave).select("name", "type")
    return now.join(types.select("name", F.col("type").alias("was"), "source"), "name", "left")


def measured_catalogue(df: DataFrame, types: DataFrame, day: str = "day") -> DataFrame:
    """types with what df's columns hold, in one aggregation: rows, filled ones, and the first and last day with a value."""
    names = [c for c in df.columns if c != day]
    of = lambda c: F.struct(F.lit(c).alias("name"), F.count(F.lit(1)).alias("rows"), F.count(c).alias("filled"), F.min(F.when(F.col(c).isNotNull(), F.col(day))).alias("first_day"), F.max(F.when(F.col(c).isNotNull(), F.col(day))).alias("last_day"))
    held = df.agg(F.array(*map(of, names)).alias("all")).select(F.inline("all"))
    return types.join(held, "name")


def check_catalogue(types: DataFrame) -> DataFrame:
    """types, or ValueError where it has a type that no table may hold."""
    if other := [tuple(r) for r in types.filter(~F.col("type").isin(*TYPES)).limit(5).collect()]:
        raise ValueError(f"unknown types: {other}")
    return types


def factor_text(factors: dict[str, float] | None) -> str:
    return ",".join(f"{k}:{v:g}" for k, v in sorted((factors or {}).items()))


def tags(spark: SparkSession, start: str | None, end: str | None, factors: dict[str, float] | None = None) -> DataFrame:
    """One row: the date range, the factors as name:value, and now."""
    row = (start, end, factor_text(factors), datetime.datetime.now(datetime.UTC).replace(tzinfo=None))
    return spark.createDataFrame([row], "start string, end string, factors string, run_ts timestamp_ntz")


def check_tags(found: DataFrame, start: str | None, end: str | None, factors: dict[str, float] | None = None, mode: str = "exact") -> None:
    """ValueError unless a table's tags agree with the job's settings: dates and factors (exact), dates (dates), or a date
    range inside that of the table (within)."""
    row = found.first()
    if row is None:
        raise ValueError("the table has no tags")
    if mode == "within":
        before = start is None or start < row["start"] if row["start"] else False
        after = end is None or end > row["end"] if row["end"] else False
        good = not before and not after
    else:
        good = (row["start"], row["end"]) == (start, end)
    if mode == "exact":
        good = good and row["factors"] == tags(found.sparkSession, start, end, factors).first()["factors"]
    if not good:
        raise ValueError(f"made for {row['start']} to {row['end']}, factors '{row['factors']}'; asked for {start} to {end}")
