"""Line dedup: lines that many documents share stay in the first of them only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytable.llm.common import LOWER, SPACE, UPPER, cut, or_empty, table


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z in lower case."""
    key = F.btrim(line, F.lit(SPACE))
    ascii_only = F.octet_length(key) == F.length(key)
    return F.when(ascii_only, F.lower(key)).otherwise(F.translate(key, UPPER, LOWER))


def _hashes(key: Column) -> list[Column]:
    """128 bits of a key, as two numbers: chance collisions stay away at 10^12 lines."""
    return [F.xxhash64(F.lit(n), key).alias(f"h{n}") for n in (1, 2)]


def find_lines(docs: DataFrame, id: str, text: str, least_chars: int, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """(places, keep): every line long enough as (h1, h2, doc, body, pos); the hashes found in min_docs documents, with the
    smallest id of them as `first`. body tells apart rows of one id that hold different texts."""
    lines = docs.select(
        F.col(id).alias("doc"),
        F.xxhash64(F.col(text)).alias("body"),
        F.posexplode(F.split(or_empty(F.col(text)), "\n")).alias("pos", "line"),
    ).filter(F.col("doc").isNotNull())
    keyed = lines.withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= least_chars)
    places = cut(keyed.select(*_hashes(F.col("key")), "doc", "body", "pos"))
    if min_docs <= 2:  # two documents or more is the same as unequal extremes, which combine before the shuffle
        found = places.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        return places, found.filter((F.col("first") < F.col("last")) | F.lit(min_docs < 2)).drop("last")
    found = places.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.count("one").alias("n"))
    return places, found.filter(F.col("n") >= min_docs).drop("n")


def lost_places(places: DataFrame, found: DataFrame) -> DataFrame:
    """The places of find_lines where a line goes; found is cut, so that Spark may split the places of a hot line."""
    return places.join(found, ["h1", "h2"]).filter(F.col("doc") != F.col("first"))


def losses(places: DataFrame, found: DataFrame) -> DataFrame:
    """(__doc, __body, __lost): the positions that a text loses, from the tables of find_lines."""
    return cut(lost_places(places, found).groupBy(F.col("doc").alias("__doc"), F.col("body").alias("__body")).agg(F.collect_set("pos").alias("__lost")))


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", least_chars: int = 10, min_docs: int = 2, into: str = "lines") -> DataFrame:
    """docs with a struct column `into`: n_lines, n_dropped and `kept`, the text without the lines that are dropped.

    A line whose key (see line_key) has least_chars code points or more and is found in at least min_docs documents stays
    in the document with the smallest id only, there each time it occurs. Lines are split at \\n and joined by it again; a
    null or empty text is one empty line. A document whose lines all go keeps "". Rows with equal ids are one document: its
    lines stay in each of those rows. A row with a null id is no document that counts, and keeps all its lines. All rows
    come back with their columns as they were (a column itself named `into` is replaced).

    Texts are split once and their lines travel as hashes; the text is shuffled once, to meet the positions that it loses. A
    hot line is combined before the first shuffle; then its places meet one row of a table that is cut, a join whose large
    side Spark splits.
    """
    places, found = find_lines(docs, id, text, least_chars, min_docs)
    lost = losses(places, cut(found))
    rows = docs.select(F.struct("*").alias("__row"), F.col(id).alias("__id"), F.xxhash64(F.col(text)).alias("__of"))
    met = rows.join(lost, (F.col("__id") == F.col("__doc")) & (F.col("__of") == F.col("__body")), "left")
    whole, gone = or_empty(F.col(f"__row.{text}")), F.coalesce("__lost", F.array().cast("array<int>"))

    def without(found: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(found) - 1), gone)
        kept = F.array_join(F.transform(stay, lambda i: found[i]), "\n")
        return F.struct(
            F.size(found).cast("long").alias("n_lines"),
            F.size(gone).cast("long").alias("n_dropped"),
            F.when(F.col("__lost").isNull(), whole).otherwise(kept).alias("kept"),
        )

    out = F.transform(F.array(F.split(whole, "\n")), without)[0]  # split once: `found` is bound to its lines
    return met.select(F.col("__row"), out.alias("__out")).select("__row.*", F.col("__out").alias("__new")).drop(into).withColumnRenamed("__new", into)


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("lines.kept"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, i AS pos, ls[i] AS line, len(ls) AS n_lines FROM (
    SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
d AS (SELECT k.*, f.first IS NOT NULL AND k.doc_id <> f.first AS dropped FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, any_value(n_lines)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
