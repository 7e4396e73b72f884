"""Packing tokenised documents into sequences with minimum bin slack."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytable.llm.bpe import Encoder, in_portions
from daytable.llm.common import cells_for, dealt, in_small_batches, numbered, or_empty, spread, table

CAPACITY = 1024
PIECE = "struct<start:bigint,length:bigint,ids_crc32:bigint,doc_tokens:bigint>"
PLAN = "length long, lo long, hi long, times long, first_sequence long, first_offset long"


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, at most counts[n] of each n, whose sum comes closest to room from below.

    A bitset holds the sums that can be reached; the sets before each length are kept, and the counts read back from them.
    """
    reach, before, mask = 1, [], (1 << (room + 1)) - 1
    for n in sorted(counts, reverse=True):
        if n > room or not counts[n]:
            continue
        before.append((n, reach))
        left, many = min(counts[n], room // n), 1
        while left:
            take = min(many, left)
            reach |= reach << (take * n) & mask
            left -= take
            many *= 2
        if reach >> room & 1:
            break
    best, chosen = reach.bit_length() - 1, {}
    for n, reached in reversed(before):
        c = 0
        while not reached >> (best - c * n) & 1:
            c += 1
        if c:
            chosen[n] = c
            best -= c * n
    return chosen


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: how many}) that use up all counts: each window starts with the largest length left and is filled to
    least slack; the same filling is repeated as often as the counts allow.

    A repetition ends when some length has fewer left than the filling holds of it, at most capacity / length times for
    each, so there are fewer than capacity * (1 + ln capacity) patterns whatever the number of documents.
    """
    left, out = {n: c for n, c in counts.items() if c}, []
    while left:
        first = max(left)
        rest = left | {first: left[first] - 1}
        chosen = fill(rest, capacity - first)
        chosen[first] = chosen.get(first, 0) + 1
        times = min(left[n] // c for n, c in chosen.items())
        out.append((times, chosen))
        for n, c in chosen.items():
            left[n] -= times * c
            if not left[n]:
                del left[n]
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, ...]]:
    """PLAN's rows: pieces lo <= number < hi of a length fill `times` sequences from first_sequence on, the first `times`
    of them at first_offset, the next behind those."""
    used, sequence, rows = dict.fromkeys(counts, 0), 0, []
    for times, chosen in patterns(counts, capacity):
        offset = 0
        for n, c in sorted(chosen.items(), reverse=True):
            rows.append((n, used[n], used[n] + c * times, times, sequence, offset))
            used[n] += c * times
            offset += c * n
        sequence += times
    return rows


def pieces(text: Column, path: str, capacity: int = CAPACITY) -> Column:
    """An array of PIECE: a text's ids and the closing id 0, cut each `capacity` ids."""

    task: dict = {}  # filled by each task

    @F.arrow_udf(f"array<{PIECE}>")
    def of(texts: pa.Array) -> pa.Array:
        encoder = task.get("encoder") or task.setdefault("encoder", Encoder(path))
        rows, counts = [], [0]
        whole = [x.decode("utf-8", "replace") for x in texts.cast(pa.large_binary()).to_pylist()]
        for portion in in_portions(whole):
            for ids in encoder.encode(portion):
                ids = np.append(ids, 0).astype("<u4")
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    rows.append((start, len(part), zlib.crc32(part.tobytes()), len(ids)))
                counts.append(len(rows))
        columns = np.array(rows, np.int64).reshape(len(rows), 4).T
        values = pa.StructArray.from_arrays([pa.array(c) for c in columns], ["start", "length", "ids_crc32", "doc_tokens"])
        return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), values)

    return of(text)


def pack(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece of each document.

    Ids are those of the tokenizers library and the file at `path`, then id 0. Documents are cut at multiples of capacity;
    full pieces are sequences of their own, and the remainders are packed by their lengths. Null and empty texts are one
    piece of one id. Repeated rows and null ids are documents of their own. An empty table gives an empty table.

    A text of any length is tokenised whole, by one task. Bytes that are not UTF-8 count as U+FFFD. Other columns are left out.

    Only the histogram of lengths, capacity numbers whatever the input, goes to the driver; the plan that comes back is
    bounded by capacity too (see patterns) and is broadcast. Pieces are numbered within their length by numbered, so that a
    length that a third of all documents share, or a row repeated as often, is spread over many tasks.
    """
    spark = docs.sparkSession
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    found = docs.select(F.col(id), F.explode(pieces(or_empty(F.col(text)), path, capacity)).alias("piece")).select(id, "piece.*")
    found = dealt(found)
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = spark.createDataFrame(plan(counts, capacity), PLAN)
    order = [id, "start", "ids_crc32"]
    found = found.withColumn("__part", spread([F.col(c) for c in order], cells_for(sum(counts.values()))))
    placed = numbered(found, ["length"], ["__part"], order, "__number")
    on = (F.col("length") == F.col("of")) & (F.col("__number") >= F.col("lo")) & (F.col("__number") < F.col("hi"))
    met = placed.join(F.broadcast(chosen.withColumnRenamed("length", "of")), on)
    k = F.col("__number") - F.col("lo")
    copy = F.floor(k / F.col("times"))
    return met.select(
        id, "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first_sequence") + F.pmod(k, F.col("times"))).alias("sequence_id"),
        (F.col("first_offset") + copy * F.col("length")).cast("long").alias("offset"),
    )


def op8_slack_packing(spark, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    return pack(table(spark, sf_dir, "documents"))
