"""Quality rules kept as a ledger of failure bits.

Each document is measured once and every rule evaluated once on its measurements; the ledger keeps both. A policy is a
named version: a mask of the rules that count. Verdicts and ablations are bitwise arithmetic over the ledger, so that a
change of policy reads no text.
"""

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytable.llm.common import in_small_batches, new_path, table

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
SYMBOLS = b"#*$%&|<>"
GRAM = 5
#: Bytes that continue a character of UTF-8: the others are its code points, and defined where bytes are not UTF-8 too.
CONTINUED = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Rule:
    """A document fails when `fails` holds of its measurements."""

    bit: int
    name: str
    fails: Callable[[Callable[[str], Column]], Column]


#: A rule's bit is never given to another rule: ledgers written before keep their meaning.
RULES = [
    Rule(0, "few_words", lambda m: m("n_words") < 10),
    Rule(1, "repeated_words", lambda m: 100 * m("n_repeat_words") > 20 * m("n_words")),
    Rule(2, "symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule(3, "repeated_lines", lambda m: 2 * m("n_dup_lines") > m("n_lines")),
    Rule(4, "short_words", lambda m: m("word_chars") < 2 * m("n_words")),
    Rule(5, "long_words", lambda m: m("word_chars") > 20 * m("n_words")),
]
BITS = {rule.name: 1 << rule.bit for rule in RULES}
#: Versions of the policy, as masks of the rules that reject.
POLICIES = {
    "base": BITS["few_words"] | BITS["repeated_words"],
    "v1": sum(BITS[x] for x in ("few_words", "repeated_words", "symbols", "repeated_lines")),
    "v2": sum(BITS.values()),
}


def repeated_words(words: list[bytes], gram: int = GRAM) -> int:
    """How many words lie in windows of `gram` words that occur twice or more."""
    n = len(words) - gram + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    keys = np.zeros(n, np.uint64)
    for k in range(gram):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + ids[k : n + k]
        keys ^= keys >> np.uint64(31)
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    found = np.flatnonzero(np.isin(keys, twice))
    grams = [tuple(words[i : i + gram]) for i in found.tolist()]  # the words themselves decide
    seen: dict[tuple, int] = {}
    for x in grams:
        seen[x] = seen.get(x, 0) + 1
    steps = np.zeros(len(words) + 1, np.int64)
    starts = np.array([i for i, x in zip(found.tolist(), grams, strict=True) if seen[x] > 1], np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + gram, -1)
    return int((np.cumsum(steps)[:-1] > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The MEASURES of one text in UTF-8; bytes.split() splits at [\\x20\\x09-\\x0D] and nothing else."""
    words = text.split()
    joined = b"".join(words)
    lines = text.split(b"\n")
    filled = [x for x in lines if x.strip()]
    return (
        len(words),
        len(joined.translate(None, CONTINUED)),
        len(joined) - len(joined.translate(None, SYMBOLS)),
        len(filled) - len(set(filled)),
        repeated_words(words),
        len(filled),
    )


def measures(text: Column) -> Column:
    """A struct of MEASURES, all long; a null text measures as an empty one."""

    @F.arrow_udf(", ".join(f"{m} long" for m in MEASURES).join(["struct<", ">"]).replace(" long", ":bigint"))
    def of(texts: pa.Array) -> pa.Array:
        rows = [measure(x or b"") for x in texts.cast(pa.large_binary()).to_pylist()]
        columns = np.array(rows, np.int64).reshape(len(rows), len(MEASURES)).T
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], MEASURES)

    return of(text)


def ledger(docs: DataFrame, text: str = "text", into: str = "ledger") -> DataFrame:
    """docs with a struct column `into`: the measurements, and `bits` with a bit set for each rule that fails.

    Every row comes back, repeated ones too, with all its columns as they were (a column that is itself named `into` is
    replaced). A null or empty text has no words and fails few_words; a text of any length is measured whole. An empty
    table gives an empty table.
    """
    measured = docs.withColumn(into, measures(F.col(text)))
    m = lambda name: F.col(f"{into}.{name}")
    bits = sum((F.when(rule.fails(m), F.lit(1 << rule.bit)).otherwise(F.lit(0)) for rule in RULES), F.lit(0))
    return measured.withColumn(into, F.struct(*(m(x).alias(x) for x in MEASURES), bits.cast("long").alias("bits")))


def stored(kept: DataFrame) -> DataFrame:
    """The ledger of kept, without texts, as a table written to the shared folder and read again: verdicts, ablations and later policies
    read the table, and each text is measured once whatever they are."""
    path = new_path(kept.sparkSession, "ledger")
    kept.write.parquet(path)
    return kept.sparkSession.read.schema(kept.schema).parquet(path)


def passes(bits: Column, policy: str) -> Column:
    """Whether a ledger's bits pass a version of the policy."""
    return bits.bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablations(kept: DataFrame, into: str = "ledger") -> DataFrame:
    """For each policy and each of its rules: rows rejected, rows that fail the rule, rows only this rule rejects.

    The ledger is first counted by its bits (at most 2^rules rows, combined before the shuffle).
    """
    counts = kept.groupBy(F.col(f"{into}.bits").alias("bits")).agg(F.count(F.lit(1)).alias("rows"))
    pairs = [F.struct(F.lit(p).alias("policy"), F.lit(mask).cast("long").alias("mask"), F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for p, mask in POLICIES.items() for r in RULES if mask >> r.bit & 1]
    failed = F.col("bits").bitwiseAND(F.col("mask"))
    total = lambda when, name: F.sum(F.when(when, F.col("rows")).otherwise(F.lit(0))).alias(name)
    return (
        counts.withColumn("pair", F.explode(F.array(*pairs)))
        .select("bits", "rows", "pair.*")
        .groupBy("policy", "rule")
        .agg(total(failed != 0, "rejected"), total(failed.bitwiseAND(F.col("bit")) != 0, "fails_rule"), total(failed == F.col("bit"), "only_rule"))
    )


def reject(docs: DataFrame, policy: str = "v1", text: str = "text") -> DataFrame:
    """The rows of docs that pass the policy, with their columns as they were."""
    taken = "__ledger"
    return ledger(docs, text, taken).filter(passes(F.col(f"{taken}.bits"), policy)).drop(taken)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    kept = stored(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ledger"))
    return kept.select(
        "doc_id",
        *(f"ledger.{m}" for m in MEASURES[:5]),
        (~passes(F.col("ledger.bits"), "base")).alias("base_failed"),
        passes(F.col("ledger.bits"), "v1").alias("kept"),
        "ledger.bits",
    )


def quality_ablations(spark, sf_dir: str) -> DataFrame:
    """The ablations of every policy over the ledger of all documents."""
    in_small_batches(spark)
    return ablations(stored(ledger(table(spark, sf_dir, "documents").select("text")).select("ledger")))


_WS = r"[\x20\x09-\x0D]"
OP9_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, list_filter(string_split_regex(t, '{_WS}+'), lambda x: x <> '') AS ws, t FROM d),
u AS (SELECT doc_id, ws, len(ws) AS n, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT doc_id, i, CASE WHEN i + 4 <= n THEN ws[i:i+4] END AS k FROM u),
c AS (SELECT doc_id, i, k IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, k) > 1 AS twice FROM g),
v AS (SELECT doc_id, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS inside FROM c),
r AS (SELECT doc_id, count(*) FILTER (inside) AS n_repeat_words FROM v GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(length(array_to_string(ws, '')), 0) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS n_lines,
    len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_unlike,
    coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
b AS (
  SELECT *, n_lines - n_unlike AS n_dup_lines,
    CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * (n_lines - n_unlike) > n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END AS bits
  FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (bits & 3) <> 0 AS base_failed, (bits & 15) = 0 AS kept, bits::BIGINT AS bits
FROM b
"""
ABLATIONS_SQL = f"WITH led AS ({OP9_SQL}) " + " UNION ALL ".join(
    f"SELECT '{p}' AS policy, '{r.name}' AS rule, count(*) FILTER ((bits & {mask}) <> 0) AS rejected, count(*) FILTER ((bits & {1 << r.bit}) <> 0) AS fails_rule, "
    f"count(*) FILTER ((bits & {mask}) = {1 << r.bit}) AS only_rule FROM led"
    for p, mask in POLICIES.items() for r in RULES if mask >> r.bit & 1
)
