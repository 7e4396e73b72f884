"""Exact top-k search by inner product over a vector-approximation file."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytable.llm.common import cut, spread, table

#: Where components saturate; below LONG, sums of products fit a long whatever the dimension.
MOST, LONG = 1 << 53, 1 << 25

#: Components in one cell, as integers: a cell needs six to seven bits where unit vectors are scaled by 256.
CELL = 4
QUERY_BLOCK, DATA_BLOCK = 2048, 4096
#: Data blocks that one task meets with a block of queries.
BLOCKS_PER_TASK = 16
BLOCK = "dims int, block int, ids binary, parts binary"
BOUND = "query_id long, vec_id long, high double"
LOWS = "query_id long, lows array<double>"


def whole_vectors(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """(vec_id, v): components as floor(256 * x). Vectors that are null or hold null or non-finite components are left out,
    as are null ids; of rows that share an id, the smallest vector counts. Components beyond 2^53 count as 2^53."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = vectors.filter(F.col(id).isNotNull() & x.isNotNull() & finite)
    within = lambda c: F.greatest(F.least(F.lit(256.0) * c.cast("double"), F.lit(float(MOST))), F.lit(float(-MOST)))
    scaled = F.transform(x, lambda c: F.floor(within(c)).cast("long"))
    return rows.select(F.col(id).cast("long").alias("vec_id"), scaled.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def in_blocks(rows: DataFrame, rows_per_block: int, count: int, cell: int) -> DataFrame:
    """BLOCK's rows: ids, and components divided by `cell`, of up to about rows_per_block vectors of one dimension."""
    blocks = 1 + count // rows_per_block

    def gather(group: pa.Table) -> pa.Table:
        dims = group["dims"][0].as_py()
        v = group["v"].combine_chunks().flatten().to_numpy().reshape(len(group), dims)
        parts = np.floor_divide(v, cell)
        parts = parts.astype("<i2") if np.abs(parts).max(initial=0) < 1 << 15 else parts.astype("<i8")
        ids = group["vec_id"].to_numpy().astype("<i8")
        out = {"dims": [dims], "block": [group["block"][0].as_py()], "ids": [ids.tobytes()], "parts": [parts.tobytes()]}
        return pa.Table.from_pydict(out, pa.schema([("dims", pa.int32()), ("block", pa.int32()), ("ids", pa.binary()), ("parts", pa.binary())]))

    dealt = rows.select("vec_id", "v", F.size("v").alias("dims"), spread([F.col("vec_id")], blocks).alias("block"))
    return dealt.groupBy("dims", "block").applyInArrow(gather, BLOCK)


def unpacked(ids: bytes, parts: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, "<i8")
    kind = "<i2" if len(parts) == 2 * len(ids) * dims else "<i8"
    return ids, np.frombuffer(parts, kind).reshape(len(ids), dims).astype(float)


def bounds(queries: tuple, block: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Bounds (low, high) of each query's product with each vector of a block; those of a query with itself are -inf.

    Queries are known and vectors lie in cells: the product with the cells' centres is off by at most half a cell's width
    times the query's absolute sum, and by rounding, which the lengths of both bound."""
    half = (CELL - 1) / 2
    (q_ids, q), (ids, x) = queries, block
    centres = x * CELL + half
    middle = q @ centres.T
    off = half * np.abs(q).sum(1)[:, None]
    off = off + 1e-9 + 1e-15 * (q.shape[1] + 4) * np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(centres, axis=1)[None, :]
    low, high = middle - off, middle + off
    own = q_ids[:, None] == ids[None, :]
    low[own] = high[own] = -np.inf
    return low, high


def meetings(queries: DataFrame, data: DataFrame, query_blocks: int, dealt: int) -> DataFrame:
    """(q_block, dims, ids, parts, q_ids, q_parts, and reaches if queries have them): every block of queries meets every block of data.

    Data blocks are dealt into `dealt` groups; each group's copies meet each query block by an equi-join."""
    rest = [c for c in queries.columns if c == "reaches"]
    ask = queries.select(F.col("block").alias("q_block"), F.col("dims").alias("q_dims"), F.col("ids").alias("q_ids"), F.col("parts").alias("q_parts"), *rest, F.explode(F.sequence(F.lit(0), F.lit(dealt - 1))).alias("q_deal"))
    give = data.select("*", F.pmod(F.xxhash64("block", "dims"), F.lit(dealt)).cast("int").alias("deal"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("for_block"))
    met = give.join(ask, (F.col("for_block") == F.col("q_block")) & (F.col("deal") == F.col("q_deal")) & (F.col("dims") == F.col("q_dims")))
    return met.select("q_block", "dims", "ids", "parts", "q_ids", "q_parts", *rest)


def slices(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[tuple]:
    """(query block and place in it, queries, block) of 256 queries and a block of data at a time."""
    for batch in batches:
        for r in range(batch.num_rows):
            block, dims, ids, parts, q_ids, q_parts = (c[r].as_py() for c in batch.columns[:6])
            q_all, x_all = unpacked(q_ids, q_parts, dims), unpacked(ids, parts, dims)
            for a in range(0, len(q_all[0]), step):
                yield (block, dims, a), (q_all[0][a : a + step], q_all[1][a : a + step]), x_all


def reaches(met: DataFrame, k: int) -> DataFrame:
    """(query_id, reach): the k-th largest lower bound of each query over all data; -inf where there are fewer.

    First scan of the file. A task keeps k numbers for each query that it sees, whatever the blocks it meets."""

    def lows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, tuple] = {}
        for place, queries, block in slices(batches):
            low, _ = bounds(queries, block)
            if place in kept:
                low = np.concatenate([kept[place][1], low], axis=1)
            if low.shape[1] > k:
                low = np.partition(low, low.shape[1] - k, axis=1)[:, -k:]
            kept[place] = (queries[0], low)
        for ids, low in kept.values():
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * low.shape[1], pa.int32()), pa.array(low.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(ids), flat], ["query_id", "lows"])

    each = met.mapInArrow(lows, LOWS).select("query_id", F.explode("lows").alias("low"))
    top = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("low").desc()))).filter(F.col("rank") <= k)
    return top.groupBy("query_id").agg(F.min(F.when(F.col("rank") == k, F.col("low"))).alias("reach")).na.fill(float("-inf"), ["reach"])


def candidates(met: DataFrame) -> DataFrame:
    """BOUND's rows: the vectors whose upper bound reaches what their query's k-th best is sure to have. Second scan."""

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                reach = np.frombuffer(row.column(6)[0].as_py(), "<f8")
                for (_, _, a), (q_ids, q), (ids, x) in slices([row]):
                    _, high = bounds((q_ids, q), (ids, x))
                    i, j = np.nonzero((high >= reach[a : a + len(q_ids), None]) & (high > -np.inf))
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(ids[j]), pa.array(high[i, j])], ["query_id", "vec_id", "high"])

    return met.mapInArrow(reached, BOUND)


def with_reaches(queries: DataFrame, reach: DataFrame) -> DataFrame:
    """BLOCK's rows of queries with `reaches`, a number for each of their ids in order; queries that met no data have none."""
    ids = queries.select("dims", "block", F.posexplode(numbers(F.col("ids"))).alias("at", "query_id"))
    met = ids.join(reach, "query_id", "left").groupBy("dims", "block").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("reach", F.lit(float("inf"))).alias("reach")))).alias("all"))
    return queries.join(met.select("dims", "block", packed(F.col("all.reach")).alias("reaches")), ["dims", "block"])


def best(rows: DataFrame, by: Column, k: int) -> DataFrame:
    """The k rows of each query that come first by `by`, then by vec_id, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(by.desc(), "vec_id"))).filter(F.col("rank") <= k)


def numbers(ids: Column) -> Column:
    """A block's ids as an array."""

    @F.arrow_udf("array<bigint>")
    def of(blobs: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(b.as_py(), "<i8") for b in blobs], pa.list_(pa.int64()))

    return of(ids)


def packed(values: Column) -> Column:
    """An array of doubles as bytes."""

    @F.arrow_udf("binary")
    def of(lists: pa.Array) -> pa.Array:
        return pa.array([np.array(x.as_py(), "<f8").tobytes() for x in lists], pa.binary())

    return of(values)


def product(q: Column, v: Column) -> Column:
    """The inner product of integer vectors, in decimals where a long might not hold it."""
    wide = "decimal(38,0)"
    fits = F.array_max(F.transform(F.concat(q, v), lambda x: F.abs(x))) < LONG
    long = F.aggregate(F.zip_with(q, v, lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
    exact = F.aggregate(F.zip_with(q, v, lambda a, b: (a.cast("decimal(17,0)") * b.cast("decimal(17,0)")).cast(wide)), F.lit(0).cast(wide), lambda s, x: (s + x).cast(wide))
    return F.when(F.coalesce(fits, F.lit(True)), long.cast(wide)).otherwise(exact)


def exact(pairs: DataFrame, asked: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, vec_id, score) of pairs, from the vectors themselves."""
    q = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    met = pairs.select("query_id", "vec_id").join(q, "query_id").join(vectors, "vec_id")
    return met.select("query_id", "vec_id", product(F.col("q"), F.col("v")).alias("score"))


def top_k(vectors: DataFrame, asks: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `asks` holds of, the k rows of all others with the largest inner
    product of integer components, ties to the smaller id; all of them, if fewer.

    Vectors are compared with those of their own length only. See whole_vectors for null and repeated rows and for huge
    components; queries left out there give no rows, and an empty table none. A score beyond the range of a long is given as
    the range's end; ranks go by the score itself.

    The approximation file holds a cell for each component. It is scanned twice against blocks of queries: for the k-th
    largest lower bound of each query over all data, and for the vectors whose upper bound reaches it, so that what a query
    keeps does not grow with the number of blocks. Exact vectors are then read in order of their bounds: first the k most
    promising of each query, then those whose bound still reaches the k-th score so found, after which no other can be
    among the k best. Of equal vectors only the k + 1 smallest ids can be, so the others are left out of the file
    beforehand: a very common vector costs no more than k + 1.
    """
    rows = cut(whole_vectors(vectors, id, vector))
    same = Window.partitionBy("v").orderBy("vec_id")
    data = cut(rows.withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1).drop("n"))
    asked = cut(rows.filter(asks))
    counts = [x.count() for x in (asked, data)]
    query_blocks = 1 + counts[0] // QUERY_BLOCK
    dealt = 1 + counts[1] // (DATA_BLOCK * BLOCKS_PER_TASK)
    queries, file = cut(in_blocks(asked, QUERY_BLOCK, counts[0], 1)), cut(in_blocks(data, DATA_BLOCK, counts[1], CELL))
    reach = reaches(meetings(queries, file, query_blocks, dealt), k)
    left = cut(candidates(meetings(with_reaches(queries, reach), file, query_blocks, dealt)))
    first = cut(exact(best(left, F.col("high"), k), asked, data))
    sure = first.groupBy("query_id").agg(F.min("score").alias("sure"), F.count(F.lit(1)).alias("n"))
    rest = left.join(sure, "query_id").filter((F.col("n") == k) & (F.col("high") >= F.col("sure").cast("double") * (1 - 1e-12 * F.signum(F.col("sure").cast("double")))))
    rest = rest.join(first.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_anti")
    found = best(first.unionByName(exact(rest, asked, data)), F.col("score"), k)
    ends = [F.lit(e).cast("decimal(38,0)") for e in (-(1 << 63), (1 << 63) - 1)]
    return found.select("query_id", "rank", "vec_id", F.greatest(F.least("score", ends[1]), ends[0]).cast("long").alias("score"))


def op2_va_file(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
