"""Lenient parsing, scaling, date ranges and the names of statistics."""

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


WHOLE = r"^[+-]?\d+$"
REAL = r"^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?[dDfF]?|(?i:nan|inf|infinity))$"


def num0(text: Column, kind: str) -> Column:
    """Text as a number; empty and malformed text is 0. "7.0" is malformed as an int.

    A pattern comes before the cast, which throws and catches an error for each value that it can't read."""
    clean = F.trim(text)
    good = clean.rlike(WHOLE if kind in ("int", "bigint") else REAL)
    return F.coalesce(F.when(good, clean.try_cast(kind)), F.lit(0).cast(kind))


def parse_day(text: Column, pattern: str | None = None) -> Column:
    """The date of a timestamp in text; null where it doesn't parse.

    Without a pattern the text starts with yyyy-MM-dd and that is the day, as written: a zone further on shifts nothing.
    """
    if pattern is None:
        day = F.substring(F.trim(text), 1, 10)
        return F.when(day.rlike(r"^\d{4}-\d\d-\d\d$"), day.try_cast("date"))
    return F.try_to_timestamp(F.upper(F.trim(text)), F.lit(pattern)).cast("date")


def date_bounds(start: str | None, end: str | None) -> tuple[datetime.date | None, datetime.date | None]:
    """Both bounds as dates; ValueError unless they are ISO dates in order."""
    a, b = (None if x is None else datetime.date.fromisoformat(x) for x in (start, end))
    if a and b and a > b:
        raise ValueError(f"start {a} is after end {b}")
    return a, b


def in_range(df: DataFrame, start: str | None = None, end: str | None = None, day: str = "day") -> DataFrame:
    """Rows from start to end, both included. A bound that is absent doesn't limit; without bounds all rows stay, also those
    without a day, which any bound drops."""
    a, b = date_bounds(start, end)
    if a:
        df = df.filter(F.col(day) >= F.lit(a))
    return df.filter(F.col(day) <= F.lit(b)) if b else df


def window_inside(train: tuple[str, str], whole: tuple[str | None, str | None]) -> None:
    """ValueError unless the training window lies inside the filter window."""
    a, b = date_bounds(*train)
    c, d = date_bounds(*whole)
    if a is None or b is None or (c and a < c) or (d and b > d):
        raise ValueError(f"window {train} is not inside {whole}")


def apply_factors(df: DataFrame, factors: dict[str, float]) -> DataFrame:
    """Named columns divided by their factors; names that df lacks are ignored."""
    return df.withColumns({c: F.col(c) / F.lit(float(f)) for c, f in factors.items() if c in df.columns})


def select_vars(df: DataFrame, spec: str | list[str], leave: tuple[str, ...] = ("day",)) -> list[str]:
    """The variables `numeric`, `all`, or a list of names means, sorted by name."""
    if spec == "numeric":
        return sorted(c for c, kind in df.dtypes if (kind in NUMERIC or kind.startswith("decimal")) and c not in leave)
    if spec == "all":
        return sorted(c for c in df.columns if c not in leave)
    if missing := [c for c in spec if c not in df.columns]:
        raise ValueError(f"no such variables: {missing}")
    return sorted(spec)


def stat_name(x: Column, y: Column, kind: Column, stat: Column) -> Column:
    """x-SUM, x-SQ-SUM or x+y-PRD-SUM."""
    return F.when(kind == "value", F.concat_ws("-", x, stat)).otherwise(F.concat_ws("-", F.concat_ws("+", x, y), kind, stat))


def split_stat_name(name: Column) -> Column:
    """A struct (x, y, kind, stat) of a statistic's name; variable names hold neither - nor +."""
    head, stat = F.split_part(name, F.lit("-"), F.lit(1)), F.split_part(name, F.lit("-"), F.lit(-1))
    middle = F.split_part(name, F.lit("-"), F.lit(2))
    pair = F.instr(head, "+") > 0
    return F.struct(
        F.split_part(head, F.lit("+"), F.lit(1)).alias("x"),
        F.when(pair, F.split_part(head, F.lit("+"), F.lit(2))).alias("y"),
        F.when(middle.isin("SQ", "PRD"), middle).otherwise(F.lit("value")).alias("kind"),
        stat.alias("stat"),
    )
