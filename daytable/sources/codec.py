"""Rows as lines of text: key<TAB>name:value,name:value."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_kv_line(df: DataFrame, key: Column, names: list[str], prefix: Column | None = None) -> Column:
    """A row's line with its names sorted; null values are left out. With a prefix, `prefix>` comes before the pairs."""
    pairs = F.concat_ws(",", *(F.concat(F.lit(f"{n}:"), F.col(n).cast("string")) for n in sorted(names)))
    return F.concat_ws("\t", key.cast("string"), pairs if prefix is None else F.concat(prefix, F.lit(">"), pairs))


def from_kv_line(df: DataFrame, line: str, names: dict[str, str], key: str = "key", prefix: str | None = None) -> DataFrame:
    """df's other columns with the key, the prefix if one is named, and each of `names` as its type.

    Pairs are trimmed and split at the colon; one without exactly two parts is passed over, and of repeated names the last
    counts. A name that a line lacks, or whose value doesn't parse, is null."""
    rest = [c for c in df.columns if c != line]
    body = F.split_part(F.col(line), F.lit("\t"), F.lit(2))
    if prefix:
        body = F.regexp_replace(body, "^[^>]*>", "")
    pairs = F.filter(F.transform(F.split(body, ","), lambda p: F.split(F.trim(p), ":")), lambda p: F.size(p) == 2)
    value = lambda n: F.get(F.get(F.filter(F.col("__pairs"), lambda p: F.trim(p[0]) == n), F.size(F.filter(F.col("__pairs"), lambda p: F.trim(p[0]) == n)) - 1), F.lit(1))
    first = [F.split_part(F.col(line), F.lit("\t"), F.lit(1)).alias(key)]
    if prefix:
        first.append(F.regexp_extract(F.split_part(F.col(line), F.lit("\t"), F.lit(2)), "^([^>]*)>", 1).alias(prefix))
    return df.withColumn("__pairs", pairs).select(*rest, *first, *(F.trim(value(n)).try_cast(kind).alias(n) for n, kind in names.items()))
