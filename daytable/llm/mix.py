"""Mixing sources to target weights by systematic sampling."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytable.llm.common import CELL_ROWS, cut, dealt, numbered, small_join, table, word_count

WEIGHTS = (3.0, 1.0, 2.0)
#: Parts by hash of a source's rows of like sizes, at least.
PARTS = 16


def ranked(df: DataFrame, by: str, out: str) -> DataFrame:
    """df with each row's rank from 1 in the order of a column, nulls last: ranges of the column are sorted, each in a task,
    and what comes before each range is counted."""
    rows = cut(df.orderBy(F.col(by).asc_nulls_last()).withColumn("__range", F.spark_partition_id()))
    counts = rows.groupBy(F.col("__range").alias("__of")).agg(F.count(F.lit(1)).alias("__n"))  # as many rows as there are ranges
    before = counts.select("__of", F.coalesce(F.sum("__n").over(Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(F.col(by).asc_nulls_last()))
    return rows.join(F.broadcast(before), F.col("__range") == F.col("__of")).withColumn(out, within + F.col("__before")).drop("__range", "__of", "__before")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) with `target`, in words, for each source.

    Sources in code point order, null last, take the weights in turn and share `share` times all sizes in proportion. A
    target stops at `most` times its source's size and the excess is shared again by weight until none is above. Each time
    is one aggregation of sums, so that there may be as many sources as hosts; level * weight is a source's share.
    """
    rows = ranked(sources, "source", "__rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("__rank") - 1, F.lit(len(weights))).cast("int") + 1)
    rows = cut(rows.select("source", "source_size", weight.alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("cap")))
    level, stopped = 0.0, -1
    while True:
        stops = F.col("cap") / F.col("weight") < F.lit(level)
        total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("double")  # noqa: B023, E731
        size, held, left, n = rows.agg(total("source_size", F.lit(True)), total("cap", stops), total("weight", ~stops), F.count_if(stops)).first()
        if n == stopped or not left:
            break
        level, stopped = (share * size - held) / left, n
    reach = F.col("cap") if not left else F.least("cap", F.lit(level) * F.col("weight"))
    return rows.select("source", "source_size", reach.alias("target"))


def _size_class(size: Column) -> Column:
    """Classes of sizes within 5 % of each other."""
    return F.floor(F.log(size.cast("double") + 1) / F.log(F.lit(1.05))).cast("int")


def _hash(*columns: Column) -> Column:
    """32 bits of a text that SQL engines hash alike."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(c.cast("string") for c in columns))), 1, 8), 16, 10).cast("long")


def systematic_mix(docs: DataFrame, size: str, seed: int = 7, id: str = "doc_id", source: str = "source", ties: tuple[str, ...] = (), **how) -> DataFrame:
    """docs with source_size, target and `copies`: how often the mix takes each document.

    Every document of a source is expected target / source_size times. Documents are laid out by size within their source
    and those expectations summed up; from one random offset per source, a document is taken once for each integer
    boundary that its stretch crosses. As neighbours have like sizes, a source's taken words differ from its target by
    about its largest document. The offset is a hash of seed and source, so reruns agree. Null sources are one source; a
    null size is 0. Documents of one size come in order of their id, then of the columns `ties`. A source of size 0 has target 0 and is not taken. Repeated rows are documents of their own. The columns
    of docs stay (source_size, target and copies are replaced).

    Prefix sums are those of numbered: rows of a source are dealt into classes of like sizes, each into parts by hash, as
    many as the rows need. So a source or a size that a third of all rows share is spread over many tasks. All columns of
    docs move: give keys alone where texts are long.
    """
    docs = docs.drop("source_size", "target", "copies")
    key = [id, *ties]
    rows = docs.withColumns({"__size": F.coalesce(F.col(size), F.lit(0)).cast("long"), "__has": F.col(source).isNotNull(), "__source": F.coalesce(F.col(source), F.lit(""))})
    rows = dealt(rows.withColumns({"__class": _size_class(F.col("__size")), "__hash": _hash(*map(F.col, key))}))
    group, cell = ["__has", "__source"], ["__class", "__part"]
    sources = cut(rows.groupBy(*group).agg(F.sum("__size").alias("source_size")))
    parts = max(PARTS, -(-rows.count() // CELL_ROWS))
    rows = rows.withColumn("__part", F.pmod("__hash", F.lit(parts)).cast("int"))
    named = sources.select(F.when(F.col("__has"), F.col("__source")).alias("source"), "source_size")
    mixed = cut(targets(named, **how).select(F.col("source").isNotNull().alias("__has"), F.coalesce("source", F.lit("")).alias("__source"), "source_size", "target"))
    placed = small_join(numbered(rows, group, cell, ["__size", *key], "__row"), mixed, group)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _hash(F.lit(seed), F.col("__has"), F.col("__source")) / F.lit(float(1 << 32))
    crossed = F.floor((F.col("__row") + 1) * each + offset) - F.floor(F.col("__row") * each + offset)
    return placed.withColumn("copies", F.least(crossed, F.ceil(each)).cast("long")).drop("__size", "__class", "__hash", "__part", "__row", *group)


def op10_systematic_mix(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = systematic_mix(docs, "size")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, list_extract([3, 1, 2], ((k - 1) % 3 + 1)::INTEGER)::DOUBLE AS weight, 2 * source_size::DOUBLE AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, (SELECT max(level) FROM l WHERE level <= cap / weight) * weight) AS target FROM l),
n AS (SELECT d.*, t.source_size, t.target, row_number() OVER (PARTITION BY d.source ORDER BY floor(ln(size::DOUBLE + 1) / ln(1.05::DOUBLE)),
    ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 16, size, doc_id) - 1 AS i,
    ('0x' || substr(md5('7|' || (d.source IS NOT NULL)::VARCHAR || '|' || coalesce(d.source, '')), 1, 8))::BIGINT / 4294967296::DOUBLE AS u,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS each
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * least(floor((i + 1) * each + u) - floor(i * each + u), ceil(each)))::BIGINT AS taken FROM n
"""
