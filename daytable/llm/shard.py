"""Sharding by a Feistel permutation of global row numbers."""

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daytable.llm.common import cells_for, cut, dealt, numbered, or_empty, spread, table

ROUNDS = 6


def once(x: Column, a: Column, b: Column, seed: int) -> Column:
    """A permutation of 0 .. a * b - 1: x = left * b + right, each half in turn shifted by a hash of the other."""
    left, right = F.floor(x / b).cast("long"), F.pmod(x, b)
    for r in range(ROUNDS):
        if r % 2:
            right = F.pmod(right + F.pmod(F.xxhash64(F.lit(seed), F.lit(r), left), b), b)
        else:
            left = F.pmod(left + F.pmod(F.xxhash64(F.lit(seed), F.lit(r), right), a), a)
    return left * b + right


def halves(n: int) -> tuple[int, int]:
    """a and b with n <= a * b < n + b: fewer than b, about the root of n, numbers lie outside the range."""
    b = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return max(1, -(-n // b)), b


def permuted(x: Column, n: int, seed: int, walk: int) -> Column:
    """Row number x under a permutation of 0 .. n - 1; `walk` more steps at most lead back into that range."""
    a, b = (F.lit(h).cast("long") for h in halves(n))
    step = lambda y: once(y, a, b, seed)
    return F.aggregate(F.sequence(F.lit(1), F.lit(walk)), step(x), lambda y, _: F.when(y < n, y).otherwise(step(y))) if walk else step(x)


def longest_walk(spark: SparkSession, n: int, seed: int) -> int:
    """How many steps a row's number that is permuted to outside 0 .. n - 1 needs at most to get back inside.

    There are fewer than b numbers outside, a Spark range. Walks enter at those of them that are no other outside number's
    image; from there all advance together until none is left outside. A cycle that holds numbers outside only is thus
    never entered, and each of the others leads back inside, so this ends for every n. No rows need no walk."""
    a, b = halves(n)
    if not n or a * b == n:
        return 0
    of = lambda y: once(y, F.lit(a).cast("long"), F.lit(b).cast("long"), seed)
    outside = cut(spark.range(n, a * b).select(F.col("id").alias("y"), of(F.col("id")).alias("next")))
    at = cut(outside.join(outside.select(F.col("next").alias("y")), "y", "left_anti").select("y"))
    steps = 0
    while not at.isEmpty():
        steps += 1
        at = cut(at.select(of(F.col("y")).alias("y")).filter(F.col("y") >= n))
    return steps


def feistel_shards(docs: DataFrame, shards: int = 8, seed: int = 20, key: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """docs with `shard` and `slot`: a reproducible shuffle in which shard and slot follow from a row's number.

    Rows are numbered from 0 in a fixed order (a hash cell of the columns `key`, then these columns), the numbers permuted,
    and number p goes to shard p mod shards, slot p div shards. So shards differ by one row at most and slots have no gaps.
    A null is a value like any other. Rows equal in `key` get neighbouring numbers, each its own; how many of them there
    are makes no task longer (see numbered). Texts of any length move as often as the row does: give a hash of them as key
    and leave them out where shards and slots are all that is asked for. Columns of docs that are named shard or slot are
    replaced. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows = dealt(docs.drop("shard", "slot").withColumn("__hash", F.xxhash64(*(F.struct(F.col(c).isNull(), F.col(c)) for c in key))))
    n = rows.count()
    rows = rows.withColumn("__cell", F.pmod("__hash", F.lit(cells_for(n))).cast("int"))
    out = numbered(rows, [], ["__cell"], list(key), "__row")
    out = out.withColumn("__p", permuted(F.col("__row"), n, seed, longest_walk(spark, n, seed)))
    return out.withColumns({"shard": F.pmod("__p", F.lit(shards)).cast("int"), "slot": F.floor(F.col("__p") / F.lit(shards)).cast("long")}).drop("__hash", "__cell", "__row", "__p")


def op4_feistel_shards(spark, sf_dir: str) -> DataFrame:
    text = F.col("text")
    whole = or_empty(text)
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), text.isNull().alias("none"), F.xxhash64(text).alias("body"), F.xxhash64(F.lit(1), text).alias("body2"))
    out = feistel_shards(sized, key=("doc_id", "none", "body", "body2"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
