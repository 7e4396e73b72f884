"""Min-max normalisation."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytable.functions.scalars import NUMERIC


def normalise(df: DataFrame, stats: DataFrame, names: list[str]) -> DataFrame:
    """df with each variable of `names` as (x - min) / (max - min), by the minima and maxima of stats (x, min, max).

    A variable whose minimum and maximum are equal stays as it is, in double. One that df lacks, or that is null in a row,
    is 0.0 if stats knows it as a number. Other columns stay. The statistics of a wide table are two numbers a column and
    become literals."""
    known = {r["x"]: (r["min"], r["max"]) for r in stats.filter(F.col("x").isin(names)).select("x", "min", "max").collect()}
    kinds, out = dict(df.dtypes), {}
    for c in names:
        if c not in known:
            continue
        if c not in kinds or not (kinds[c] in NUMERIC or kinds[c].startswith("decimal")):
            if c not in kinds:
                out[c] = F.lit(0.0)
            continue
        low, high = known[c]
        x = F.col(c).cast("double")
        out[c] = F.coalesce(x if low == high else (x - F.lit(low)) / F.lit(high - low), F.lit(0.0))
    return df.withColumns(out)
