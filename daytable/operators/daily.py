"""Rows rolled up to one per day."""

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_category_counts(df: DataFrame, day: str = "day", category: str = "category") -> DataFrame:
    """(day, category, n); a null category counts as ""."""
    return df.groupBy(day, F.coalesce(F.col(category), F.lit("")).alias(category)).agg(F.count(F.lit(1)).alias("n"))


def column_name(category: str, prefix: str = "c_") -> str:
    return prefix + re.sub(r"\W+", "_", category).strip("_").lower()


def column_names(categories: list[str], prefix: str = "c_") -> dict[str, str]:
    """Each category's column; those that would share a name are numbered in their order, from _2 on."""
    names, used = {}, set()
    for category in sorted(categories):
        name, n = column_name(category, prefix), 1
        while name in used:
            n += 1
            name = f"{column_name(category, prefix)}_{n}"
        used.add(name)
        names[category] = name
    return names


def daily_categories_wide(df: DataFrame, day: str = "day", category: str = "category", values: list[str] | None = None, prefix: str = "c_") -> DataFrame:
    """day, a count for each category sorted by name, 0 where a day lacks it, and as `total` all rows of the day, those of
    categories that `values` leaves out too. See column_names for the columns.

    Rows are counted by day and category first, so the pivot and, where `values` is not given, the search for categories
    see counts only."""
    counts = daily_category_counts(df, day, category)
    if values is None:
        values = [r[0] for r in counts.select(category).distinct().collect()]
    one = lambda v, name: F.sum(F.when(F.col(category) == v, F.col("n")).otherwise(F.lit(0))).alias(name)
    return counts.groupBy(day).agg(*(one(v, name) for v, name in column_names(values, prefix).items()), F.sum("n").alias("total"))


#: Digits of a number's exact sum: BASE^1, BASE^0, ... BASE^-3.
DIGITS, BASE_BITS = 5, 26


def exact_sums(df: DataFrame, c: str) -> list[Column]:
    """Aggregates that add a column up exactly, missing values as 0, so that no order of rows and no partitioning changes a bit.

    Whole numbers and decimals are added as decimals. A double is taken apart into whole digits to the base 2^26, from 2^26 down
    to 2^-78, whose sums are whole numbers; what it has below 2^-78 is left out. NaN, infinities and numbers from 2^62 on have no
    such digits and are added up beside them. `total` puts the sums together again."""
    kind = dict(df.dtypes)[c]
    if kind not in ("float", "double"):
        wide = "decimal(28,0)" if not kind.startswith("decimal") else kind
        return [F.sum(F.coalesce(F.col(c).cast(wide), F.lit(0).cast(wide))).alias(f"{c}__0")]
    x = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    odd = F.isnan(x) | (F.abs(x) >= F.lit(float(1 << 62)))
    rest, out = F.when(odd, F.lit(0.0)).otherwise(F.abs(x)) / F.lit(float(1 << BASE_BITS)), []
    for k in range(DIGITS):
        digit = F.floor(rest)
        out.append(F.sum(F.when(x < 0, -digit).otherwise(digit)).alias(f"{c}__{k}"))
        rest = (rest - digit) * F.lit(float(1 << BASE_BITS))
    return [*out, F.sum(F.when(odd, x)).alias(f"{c}__odd")]


def sums_again(df: DataFrame, c: str) -> list[Column]:
    """The sums of exact_sums, added up further."""
    return [F.sum(n).alias(n) for n in df.columns if n.startswith(f"{c}__")]


def total(df: DataFrame, c: str) -> Column:
    """The sum of exact_sums as a double: digits are carried, so that equal sums have equal digits, and rounded."""
    if f"{c}__odd" not in df.columns:
        return F.col(f"{c}__0").cast("double")
    digits, carry = [], F.lit(0).cast("long")
    for k in range(DIGITS - 1, 0, -1):
        whole = F.col(f"{c}__{k}") + carry
        digits.append(whole.bitwiseAND(F.lit((1 << BASE_BITS) - 1)).cast("double"))
        carry = F.shiftright(whole, BASE_BITS)
    step, value = F.lit(float(1 << BASE_BITS)), F.lit(0.0)
    for d in digits[:-1]:
        value = (value + d) / step
    whole = (F.col(f"{c}__0") + carry).cast("double") * step + digits[-1]
    return whole + value + F.coalesce(F.col(f"{c}__odd"), F.lit(0.0))


def daily_means(df: DataFrame, floats: list[str], ints: list[str], day: str = "day") -> DataFrame:
    """Means per day in double, of exact sums; those of whole numbers cut off toward zero. Missing values count as 0."""
    whole = [F.sum(F.coalesce(F.col(c).cast("long"), F.lit(0))).alias(c) for c in ints]
    sums = df.groupBy(day).agg(F.count(F.lit(1)).alias("__n"), *(x for c in floats for x in exact_sums(df, c)), *whole)
    return sums.select(day, *((total(sums, c) / F.col("__n")).alias(c) for c in floats), *(F.expr(f"cast(`{c}` div __n as int)").alias(c) for c in ints))


def daily_parts(df: DataFrame, floats: list[str], ints: list[str], key: str, payload: list[str], day: str = "day") -> DataFrame:
    """(day, key, n, payload) and sums: rows counted and summed by day and key, which means, modes and ordinals all follow from."""
    whole = [F.sum(F.coalesce(F.col(c).cast("long"), F.lit(0))).alias(c) for c in ints]
    return counted(df, [day, key], payload, [*(x for c in floats for x in exact_sums(df, c)), *whole])


def counted(df: DataFrame, by: list[str], payload: list[str], sums: list[Column]) -> DataFrame:
    """(by, n, payload, sums): rows counted and summed, with the largest payload. Rows are counted with their payload first,
    by hash; only what is left of them is sorted, for the largest."""
    each = df.groupBy(*by, *(F.col(p).alias(f"__{p}") for p in payload)).agg(F.count(F.lit(1)).alias("n"), *sums)
    held = [c for c in each.columns if c not in [*by, "n", *(f"__{p}" for p in payload)]]
    return each.groupBy(*by).agg(F.sum("n").alias("n"), F.max(F.struct(*(F.col(f"__{p}").alias(p) for p in payload))).alias("payload"), *(F.sum(c).alias(c) for c in held))


def means_of(parts: DataFrame, floats: list[str], ints: list[str], day: str = "day") -> DataFrame:
    """daily_means from daily_parts."""
    sums = parts.groupBy(day).agg(F.sum("n").alias("__n"), *(x for c in floats for x in sums_again(parts, c)), *(F.sum(c).alias(c) for c in ints))
    return sums.select(day, *((total(sums, c) / F.col("__n")).alias(c) for c in floats), *(F.expr(f"cast(`{c}` div __n as int)").alias(c) for c in ints))


def top_of(counts: DataFrame, by: list[str], key: str, payload: list[str], tie: str = "low", which: str = "highest") -> DataFrame:
    """mode_per_group from counts (by, key, n, payload)."""
    n = F.col("n") if which == "highest" else -F.col("n")
    ranked = Window.partitionBy(*by).orderBy(n.desc(), F.col(key).asc() if tie == "low" else F.col(key).desc())
    top = counts.withColumn("__rank", F.row_number().over(ranked)).filter("__rank = 1")
    return top.select(*by, key, "n", *(F.col(f"payload.{p}").alias(p) for p in payload))


def mode_per_group(df: DataFrame, by: list[str], key: str, payload: list[str], tie: str = "low", which: str = "highest") -> DataFrame:
    """For each group the most (or least) frequent key, its count `n`, and the largest payload that comes with it.

    Of equally frequent keys the lowest wins, or with tie="high" the highest. Keys are counted before groups are formed."""
    return top_of(counted(df, [*by, key], payload, []), by, key, payload, tie, which)


def ordinal_map(df: DataFrame, key: str) -> DataFrame:
    """(key, ordinal): the distinct keys in ascending order, numbered from 0. For keys of a small vocabulary."""
    ids = df.select(key).filter(F.col(key).isNotNull()).distinct()
    return ids.withColumn("ordinal", F.dense_rank().over(Window.orderBy(key)) - 1)


def apply_ordinal(df: DataFrame, ordinals: DataFrame, key: str) -> DataFrame:
    """df with key replaced by its ordinal, null where the map lacks it (see unknown_keys)."""
    known = ordinals.withColumnRenamed(key, "__key")
    return df.join(known, F.col(key) == F.col("__key"), "left").withColumn(key, F.col("ordinal")).drop("__key", "ordinal")


def unknown_keys(df: DataFrame, ordinals: DataFrame, key: str) -> DataFrame:
    """(key, rows): the keys of df that the map lacks, with their number of rows; null is one of them."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    return counts.join(ordinals.select(F.col(key).alias("__key")), F.col(key) == F.col("__key"), "left_anti")


def bars_wide(bars: DataFrame, ids: list[str], fields: list[str], day: str = "day") -> DataFrame:
    """day with <id>_<field> for each series, null where a day lacks it; of several bars the largest values."""
    one = lambda i, c: F.max(F.when(F.col("id") == i, F.col(c))).alias(f"{i.lower()}_{c}")
    return bars.groupBy(day).agg(*(one(i, c) for i in ids for c in fields))


def row_sum(names: list[str]) -> Column:
    return sum((F.coalesce(F.col(n), F.lit(0)) for n in names), F.lit(0))
