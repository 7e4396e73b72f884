"""Matrices as tables of entries (i, j, v), and their product."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCKS = "bi long, bk long, block binary"
#: Block rows that share a copy of the right matrix, and how many tasks' sums are added up first.
ROWS_PER_DEAL, PARTS = 16, 32


def entries(rows: DataFrame, i: str, values: str) -> DataFrame:
    """(i, j, v) of rows that hold an index and an array of numbers."""
    return rows.select(F.col(i).cast("long").alias("i"), F.posexplode(values).alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


def read_matrix(spark: SparkSession, path: str, shape: tuple[int, int], sep: str = ",") -> DataFrame:
    """(i, j, v) of a text file with a row per line; # lines and empty ones don't count. ValueError unless it has the shape.

    Rows are numbered in the order of the file: by the block of it that a task reads, then as they come in the block."""
    of = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))
    lines = spark.read.text(path).select("value", of.alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = lines.filter(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    blocks = lines.groupBy(F.col("block").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    before = blocks.select("of", F.coalesce(F.sum("n").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("block").orderBy("at")) - 1
    rows = lines.withColumn("k", number).join(before, F.col("block") == F.col("of")).select((F.col("before") + F.col("k")).alias("i"), F.split("value", sep).alias("values"))
    found = rows.agg(F.count(F.lit(1)), F.coalesce(F.min(F.size("values")), F.lit(shape[1])), F.coalesce(F.max(F.size("values")), F.lit(shape[1]))).first()
    if tuple(found) != (shape[0], shape[1], shape[1]):
        raise ValueError(f"not a {shape[0]} x {shape[1]} matrix: {found[0]} rows of {found[1]} to {found[2]}")
    return entries(rows.withColumn("values", F.transform("values", lambda x: F.trim(x).cast("double"))), "i", "values")


def check_shapes(a: tuple[int, int], b: tuple[int, int]) -> None:
    if a[1] != b[0]:
        raise ValueError(f"shapes {a} and {b} don't fit")


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) of the product of sparse matrices: entries meet at the inner index, products are summed by place.

    Shuffles what is there, not a copy per row or column; a dense inner index is split by the skew join."""
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select(F.col("i").alias("k2"), "j", F.col("v").alias("y"))
    return left.join(right, F.col("k") == F.col("k2")).groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def in_blocks(m: DataFrame, size: int, transposed: bool = False) -> DataFrame:
    """(bi, bk, block): dense size x size blocks of a matrix, by block row and inner block."""

    def gather(group: pa.Table) -> pa.Table:
        i, j = group["i"].to_numpy(), group["j"].to_numpy()
        block = np.zeros((size, size))
        np.add.at(block, (i % size, j % size), group["v"].to_numpy())
        row = {"bi": [int(i[0]) // size], "bk": [int(j[0]) // size], "block": [block.tobytes()]}
        return pa.Table.from_pydict(row, pa.schema([("bi", pa.int64()), ("bk", pa.int64()), ("block", pa.binary())]))

    m = m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v") if transposed else m
    keyed = m.withColumns({"bi": F.floor(F.col("i") / size), "bk": F.floor(F.col("j") / size)})
    return keyed.groupBy("bi", "bk").applyInArrow(gather, BLOCKS)


PARTIAL = "bi long, bj long, block binary"


def summed(rows: Iterator[tuple[int, int, np.ndarray]], most: int = 64) -> Iterator[pa.RecordBatch]:
    """PARTIAL's rows: blocks summed by place, `most` places at a time at most."""
    sums: dict[tuple, np.ndarray] = {}

    def out() -> pa.RecordBatch:
        cols = [pa.array([p[0] for p in sums], pa.int64()), pa.array([p[1] for p in sums], pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["bi", "bj", "block"])

    for bi, bj, x in rows:
        if (bi, bj) in sums:
            sums[bi, bj] += x
            continue
        if len(sums) == most:
            yield out()
            sums.clear()
        sums[bi, bj] = x
    if sums:
        yield out()


def matmul_blocks(a: DataFrame, b: DataFrame, size: int = 256) -> DataFrame:
    """(i, j, v) of the product of dense matrices. Places where the sum is 0 are left out.

    Blocks meet at the inner block index, block rows of the left matrix dealt out so that one inner block is the work of
    many tasks. Each pair is one product in numpy, and products are summed by place as blocks: inside a task, then those of
    some tasks together, then all. Only finished blocks become entries."""

    def block(c) -> np.ndarray:
        return np.frombuffer(c.as_py()).reshape(size, size).copy()

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return summed((r[0].as_py(), r[1].as_py(), block(r[2]) @ block(r[3]).T) for batch in batches for r in zip(*batch.columns, strict=True))

    def add(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches(summed((r[0].as_py(), r[1].as_py(), block(r[2])) for r in zip(group["bi"], group["bj"], group["block"], strict=True)))

    @F.arrow_udf("array<double>")
    def values(blocks: pa.Array) -> pa.Array:
        flat = [np.frombuffer(x.as_py()) for x in blocks]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * size * size, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0)))

    left, right = in_blocks(a, size), in_blocks(b, size, transposed=True)
    deals = 1 + (a.agg(F.coalesce(F.max("i"), F.lit(0))).first()[0] // size) // ROWS_PER_DEAL
    left = left.withColumn("deal", F.pmod("bi", F.lit(deals)))
    right = right.select(F.col("bi").alias("bj"), F.col("bk").alias("bk2"), F.col("block").alias("other"), F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal2"))
    met = left.join(right, (F.col("bk") == F.col("bk2")) & (F.col("deal") == F.col("deal2"))).select("bi", "bj", "block", "other")
    parts = met.mapInArrow(products, PARTIAL).withColumn("some", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    parts = parts.groupBy("bi", "bj", "some").applyInArrow(lambda group: add(group.drop_columns(["some"])), PARTIAL)
    whole = parts.groupBy("bi", "bj").applyInArrow(add, PARTIAL).select("bi", "bj", F.posexplode(values("block")).alias("at", "v")).filter("v <> 0")
    return whole.select((F.col("bi") * size + F.floor(F.col("at") / size)).alias("i"), (F.col("bj") * size + F.col("at") % size).alias("j"), "v")
