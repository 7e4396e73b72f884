"""What the operators of this subpackage share."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daytable.sources.shared import cut, new_path  # noqa: F401

#: ASCII white space, [\x20\x09-\x0D]; everything between it is a word.
SPACE = " \t\n\x0b\f\r"
#: CRC-32 of a text of ASCII characters in DuckDB, bit by bit.
CRC32 = """xor(4294967295, list_reduce(list_transform(range(1, length({0}) + 1), lambda k: ascii(substr({0}, k::INTEGER, 1))::BIGINT),
  lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295::BIGINT))"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Sets a session to hand Python `rows` rows at a time at most: texts are long, and executor and worker hold a batch whole,
    several times over. Queries and stages do so, operators leave their caller's session alone."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def word_count(text: Column) -> Column:
    trimmed = F.btrim(or_empty(text), F.lit(SPACE))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def small_join(df: DataFrame, small: DataFrame, on: Column | list[str], how: str = "inner", most: int = 50_000) -> DataFrame:
    """Join with a table that is broadcast only where a count finds at most `most` rows in it; `small` is cut already."""
    return df.join(F.broadcast(small) if small.limit(most + 1).count() <= most else small, on, how)


def spread(columns: list[Column], parts: Column | int) -> Column:
    """A cell number from 0 to parts - 1 that deals rows out evenly."""
    return F.pmod(F.xxhash64(*columns), parts if isinstance(parts, Column) else F.lit(parts)).cast("int")


#: Rows in one hash cell, on average, of tables that are numbered; a task sorts cells one after the other.
CELL_ROWS, LEAST_CELLS = 50_000, 256


def cells_for(rows: int) -> int:
    """How many hash cells a table of so many rows is dealt into."""
    return max(LEAST_CELLS, -(-rows // CELL_ROWS))


def dealt(df: DataFrame) -> DataFrame:
    """df, cut, with `__task`, the task that wrote a row: it tells repeated rows apart where their content can't."""
    return cut(df.withColumn("__task", F.spark_partition_id()))


def same(a: list[str], b: list[str]) -> Column:
    """Whether columns are equal one by one, nulls included."""
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & F.col(x).eqNullSafe(F.col(y))
    return out


def numbered(df: DataFrame, group: list[str], cell: list[str], order: list[str], out: str) -> DataFrame:
    """df, from dealt(), with each row's number from 0 within its group, by cell and then by the columns `order`.

    Rows are first counted by group, cell, order and task, which combines repeated rows before the shuffle. Sums of those
    counts, of whole cells first and then inside each cell, say where each count's rows start; so no task ever holds a hot
    group or a hot row's copies: it numbers the copies that one task wrote. Numbers depend on the content of rows only,
    up to rows that are equal in all of `order`.
    """
    key = [*group, *cell, *order, "__task"]
    counts = cut(df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")))
    before = lambda by, on: Window.partitionBy(*by).orderBy(*on).rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.groupBy(*group, *cell).agg(F.sum("__n").alias("__n"))
    cells = cells.select(*(F.col(c).alias(f"__of_{c}") for c in [*group, *cell]), F.coalesce(F.sum("__n").over(before(group, cell)), F.lit(0)).alias("__first"))
    inside = counts.withColumn("__start", F.coalesce(F.sum("__n").over(before([*group, *cell], [*order, "__task"])), F.lit(0))).drop("__n")
    met = inside.join(cells, same([*group, *cell], [f"__of_{c}" for c in [*group, *cell]]))
    met = met.select(*(F.col(c).alias(f"__of_{c}") for c in key), (F.col("__first") + F.col("__start")).alias("__start"))
    rows = df.join(met, same(key, [f"__of_{c}" for c in key]))
    within = Window.partitionBy(*key).orderBy(F.lit(0))
    return rows.withColumn(out, F.col("__start") + F.row_number().over(within) - 1).drop("__start", "__task", *(f"__of_{c}" for c in key))


def squeezed(text: Column) -> Column:
    """The text in UTF-8 under zstd, for a shuffle: half of what Spark's own compression leaves. Null stays null."""

    @F.arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        import zstandard

        press = zstandard.ZstdCompressor(3).compress
        return pa.array([None if x is None else press(x) for x in texts.cast(pa.large_binary()).to_pylist()], pa.binary())

    return of(text)


def unsqueezed(body: bytes | None) -> bytes:
    import zstandard

    return b"" if body is None else zstandard.ZstdDecompressor().decompress(body)
