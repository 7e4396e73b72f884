"""A corpus pipeline: quality rules, line dedup, near-dedup, source mixing and packing, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs; all
but the last keep the columns of `documents`. The result of the last is that of packing.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daytable.llm import lines, mix, neardup, packing, quality
from daytable.llm.common import cut, dealt, in_small_batches, numbered, small_join, table, word_count
from daytable.sources.shared import dropped, new_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass version v1 of the quality policy, rows and columns as they were.

    A null or empty text has no words and goes. Repeated rows are judged alike and each come back. A text of any length is measured
    whole. No rows give no rows."""
    in_small_batches(spark)
    return quality.reject(docs, "v1")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier one holds; n_chars follows the text where lines went.

    A null text stays null, an empty one empty. Rows with one id are one document: none loses lines to the other. A text of any
    length is split whole. No rows give no rows."""
    done = lines.dedup_lines(docs, into="__lines")
    kept = F.col("__lines.kept")
    changed = F.col("__lines.n_dropped") > 0
    text = F.when(changed, kept).otherwise(F.col("text"))
    n_chars = F.when(changed, F.length(kept).cast("long")).otherwise(F.col("n_chars"))
    return done.withColumns({"text": text, "n_chars": n_chars}).drop("__lines")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, its row as it was.

    Rows with a null id, which names no class, all stay. Texts without words are like each other. Of repeated rows one stays. A text of
    any length has one signature. No rows give no rows."""
    in_small_batches(spark)
    return neardup.keep_first(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Keys and sizes are mixed; whole rows move once, to meet their copies.

    Rows equal in id, source and text share the copies that the mix takes of them all, as evenly as whole numbers allow. They are
    numbered task by task, so that a row repeated by a third of the table is no task's alone. A null source is a source; null and
    empty texts have size 0 and are taken as documents of that size are. A text of any length counts whole. No rows give no rows."""
    about = [c for name in ("doc_id", "source", "text") for c in (F.col(name).isNull(), F.col(name))]
    key = {f"__k{n}": F.xxhash64(F.lit(n), *about) for n in (1, 2)}  # of content, never null
    keys = docs.select("doc_id", "source", *(c.alias(n) for n, c in key.items()), word_count(F.col("text")).alias("words"))
    taken = mix.systematic_mix(keys, "words", ties=tuple(key)).groupBy(*key).agg(F.sum("copies").alias("__taken"), F.count(F.lit(1)).alias("__rows"))
    taken = cut(taken.filter("__taken > 0"))
    rows = docs.select(F.struct("*").alias("__row"), *(c.alias(n) for n, c in key.items()))
    out = rows.join(taken.filter("__rows = 1"), [*key]).withColumn("__copies", F.col("__taken").cast("int"))
    often = cut(taken.filter("__rows > 1"))
    if not often.isEmpty():
        many = numbered(dealt(small_join(rows, often, [*key])).withColumn("__cell", F.lit(0)), [*key], ["__cell"], [], "__k")
        upto = lambda k: F.floor(k * F.col("__taken") / F.col("__rows"))
        out = out.unionByName(many.withColumn("__copies", (upto(F.col("__k") + 1) - upto(F.col("__k"))).cast("int")).select(*out.columns))
    return out.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__copies")))).select("__row.*")


def slack_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in packed sequences.

    A null or empty text is one piece of one id. Repeated rows are documents of their own. A text of any length is cut into full pieces
    and a rest. No rows give no rows."""
    in_small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("slack_packing", slack_packing),
]

#: Near-dedup and packing have no SQL; tests compare the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again; what the one before it wrote is
    then deleted."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            dropped(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
