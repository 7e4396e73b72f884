"""Pearson correlations of all pairs of variables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytable.operators.moments import co_moments, ratio

#: Lower bounds of the tiers of |r|, and their names.
TIERS = [(0.9, "0.9-1.0"), (0.8, "0.8-0.9"), (0.7, "0.7-0.8"), (0.6, "0.6-0.7"), (0.5, "0.5-0.6"), (0.0, "0.0-0.5")]
ANOMALY = "anomaly"


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r of two columns as an aggregate, over the rows that have both; null where one is constant. Smallest and largest
    values tell that: merged means of a constant are off by a digit for some counts of rows, and then it seems to vary."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, ratio(F.covar_pop(x, y), F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))))


def correlations_of(sums: DataFrame) -> DataFrame:
    """correlations from co_moments."""
    spread = F.sqrt(F.col("cxx")) * F.sqrt(F.col("cyy"))
    r = ratio(F.col("cxy"), F.when(spread > 0, spread))
    return sums.filter("x < y").select("x", "y", r.alias("r"), "n", "sx", "sy", "cxx", "cyy", "cxy", "sxy")


def correlations(df: DataFrame, names: list[str]) -> DataFrame:
    """(x, y, r, n, sx, sy, cxx, cyy, cxy, sxy) for each unordered pair x < y, in one pass over df: sums of values, of squares and
    products of deviations from the means, and of products. A constant column's r is null."""
    return correlations_of(co_moments(df, names))


def correlation_matrix(pairs: DataFrame, names: list[str]) -> DataFrame:
    """A row for each variable x and a column of r for each; the diagonal is null."""
    both = pairs.select("x", "y", "r").union(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"), "r"))
    return both.groupBy("x").pivot("y", sorted(names)).agg(F.first("r"))


def correlation_tiers(pairs: DataFrame, focus: str | None = None) -> DataFrame:
    """(tier, x, y, r), by tier and then r from high to low; with a focus, pairs in whose names it occurs. |r| of up to
    1.001 counts as 1; beyond, or without r, a pair is an anomaly."""
    size = F.abs("r")
    tier = F.when(size.isNull() | (size >= 1.001), F.lit(ANOMALY))
    for least, name in TIERS:
        tier = tier.when(size >= least, F.lit(name))
    found = pairs.filter(F.col("x").contains(focus) | F.col("y").contains(focus)) if focus else pairs
    return found.select(tier.alias("tier"), "x", "y", "r").orderBy(F.col("tier").desc(), F.col("r").desc_nulls_last(), "x", "y")
