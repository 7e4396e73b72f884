"""Moments of numeric columns and of their products, in double throughout."""

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a task, and then all of them, know of a pair of variables: rows, sums of values and of their product; means, as a number near
#: them (mx) and what lacks to it (ex); sums of squares and products of deviations from them; rows whose product isn't zero; of x alone, minimum, maximum and rows where it isn't zero.
PAIR = "x string, y string, n long, sx double, sy double, sxy double, mx double, my double, ex double, ey double, cxx double, cyy double, cxy double, nonzero long, low double, high double, on long"
NAMES = [c.split()[0] for c in PAIR.split(", ")]


def as_double(df: DataFrame, names: list[str]) -> DataFrame:
    """names as doubles, missing values as 0."""
    return df.select(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names))


def co_moments(df: DataFrame, names: list[str], pairs: bool = True) -> DataFrame:
    """PAIR's row for each unordered pair x <= y of variables (only x = y without `pairs`), in one pass over df; none for no rows.

    Each task multiplies its batches' matrices, of values less the batch's means, and merges them around its own means; tasks are merged
    around the total means, as they come in, so that neither large offsets nor many rows cost digits. A constant column deviates
    by exactly 0. NaN is the largest number, as in Spark: it is a maximum, no minimum, and makes sums NaN. A task holds
    k x k matrices and hands on k * (k + 1) / 2 rows; no product is ever a row of its own."""
    names = sorted(names)
    k = len(names)
    i, j = np.triu_indices(k) if pairs else (np.arange(k), np.arange(k))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) for b in batches if b.num_rows)
        known = merged_all((of_rows(x, i, j) for x in rows), ["i", "j"])
        if known is not None:
            at = np.array(names, object)
            yield as_batch(known.assign(x=at[known["i"]], y=at[known["j"]]))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = merged_all((b.to_pandas() for b in batches if b.num_rows), ["x", "y"])
        if known is not None:
            yield as_batch(known)

    parts = as_double(df, names).mapInArrow(partial, PAIR)
    return parts.repartition("x", "y").mapInArrow(whole, PAIR)


def of_rows(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    """PAIR's numbers of a matrix of rows, for the pairs of columns (i, j)."""
    n, low, high = len(x), np.fmin.reduce(x, axis=0), x.max(0)
    near = np.clip(x.sum(0) / n, low, high)  # a constant column's own value
    d = x - near
    off = d.sum(0)  # what rounding left of the mean
    on = (x != 0).astype(float)
    own = np.maximum((d * d).sum(0) - off * off / n, 0.0)
    if len(i) > x.shape[1]:
        sxy, cxy, nonzero = (x.T @ x)[i, j], (d.T @ d - np.outer(off, off) / n)[i, j], (on.T @ on)[i, j]
    else:
        sxy, cxy, nonzero = (x * x).sum(0), own, on.sum(0)
    sums, rest = x.sum(0), off / n
    return pd.DataFrame({"i": i, "j": j, "n": n, "sx": sums[i], "sy": sums[j], "sxy": sxy, "mx": near[i], "my": near[j], "ex": rest[i], "ey": rest[j], "cxx": own[i], "cyy": own[j], "cxy": cxy,
                         "nonzero": nonzero.astype(np.int64), "low": low[i], "high": high[i], "on": on.sum(0).astype(np.int64)[i]})


def as_batch(rows: pd.DataFrame) -> pa.RecordBatch:
    """Rows of PAIR; NaN stays NaN."""
    return pa.RecordBatch.from_arrays([pa.array(rows[c].to_numpy()) for c in NAMES], NAMES)


def merged_all(parts: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame | None:
    """All parts merged, a few at a time; None where there are none."""
    with np.errstate(invalid="ignore", over="ignore"):
        known = None
        for few in itertools.batched(parts, 16):
            known = merged(pd.concat([*few] if known is None else [known, *few]), by)
    return known


def merged(parts: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    """Rows of PAIR's numbers, one for each pair: deviations are carried over from each part's means to those of all."""
    parts = parts.reset_index(drop=True)
    code = parts.groupby(by, sort=False).ngroup().to_numpy()
    size = code.max() + 1
    add = lambda v: np.bincount(code, v, size)
    begin = np.unique(code, return_index=True)[1]
    out = parts.iloc[begin][by].reset_index(drop=True)
    count = parts["n"].to_numpy(float)
    n = add(count)
    apart = {}
    for m, e in (("mx", "ex"), ("my", "ey")):
        v = parts[m].to_numpy()
        away = v - v[begin][code] + parts[e].to_numpy()  # from the first part's number
        out[m], out[e] = v[begin], add(count * away) / n
        apart[m] = away - out[e].to_numpy()[code]
    for c, (a, b) in {"cxx": ("mx", "mx"), "cyy": ("my", "my"), "cxy": ("mx", "my")}.items():
        out[c] = add(parts[c].to_numpy()) + add(count * apart[a] * apart[b])
    for c in ("sx", "sy", "sxy"):
        out[c] = add(parts[c].to_numpy())
    for c in ("n", "nonzero", "on"):
        whole = np.zeros(size, np.int64)
        np.add.at(whole, code, parts[c].to_numpy())
        out[c] = whole
    low, high = np.full(size, np.nan), np.full(size, -np.inf)
    np.fmin.at(low, code, parts["low"].to_numpy())
    np.maximum.at(high, code, parts["high"].to_numpy())
    return out.assign(low=low, high=high)


def base_of(sums: DataFrame) -> DataFrame:
    """base_stats from co_moments."""
    n, zero = F.col("n"), F.col("n") - F.col("on")
    var = F.col("cxx") / n
    stats = {"sum": F.col("sx"), "cnt": n, "zero": zero, "mean": F.col("sx") / n, "min": F.col("low"), "max": F.col("high"), "sq_sum": F.col("sxy"), "sq_cnt": n, "sq_zero": n - F.col("nonzero"), "sq_mean": F.col("sxy") / n, "var": var, "stddev": F.sqrt(var), "zero_pct": zero / n * 100}
    return sums.filter("x = y").select("x", *(c.alias(name) for name, c in stats.items()))


def base_stats(df: DataFrame, names: list[str]) -> DataFrame:
    """For each variable x: sum, cnt, zero, mean, min, max, the same of its square (sq_), population var and stddev, and
    zero_pct. One pass; each task hands on a row per variable."""
    return base_of(co_moments(df, names, pairs=False))


def products_of(sums: DataFrame) -> DataFrame:
    """pair_products from co_moments."""
    return sums.filter("x < y").select("x", "y", F.col("sxy").alias("prd_sum"), F.col("n").alias("prd_cnt"), (F.col("n") - F.col("nonzero")).alias("prd_zero"), (F.col("sxy") / F.col("n")).alias("prd_mean"))


def pair_products(df: DataFrame, names: list[str]) -> DataFrame:
    """For each unordered pair x < y: prd_sum, prd_cnt, prd_zero and prd_mean of the product."""
    return products_of(co_moments(df, names))


def stats_long(base: DataFrame, pairs: DataFrame) -> DataFrame:
    """(x, y, kind, stat, value): all statistics, a row each; kind is value, SQ or PRD."""
    stats = {"value": ["sum", "cnt", "zero", "mean", "min", "max"], "SQ": ["sq_sum", "sq_cnt", "sq_zero", "sq_mean"]}
    of = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.lit(c.split("_")[-1].upper()).alias("stat"), F.col(c).cast("double").alias("value"))
    one = base.select("x", F.lit(None).cast("string").alias("y"), F.explode(F.array(*(of(k, c) for k, cs in stats.items() for c in cs))).alias("s"))
    two = pairs.select("x", "y", F.explode(F.array(*(of("PRD", f"prd_{c}") for c in ("sum", "cnt", "zero", "mean")))).alias("s"))
    return one.unionByName(two).select("x", "y", "s.kind", "s.stat", "s.value")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)
