"""Periodic runs of words, as the maximal pairs of a text whose distance is not above their length.

A run of period q that starts at s and has length m is the pair of equal stretches of m - q words at s and s + q: no word
before or after them is equal, and they overlap or touch, q <= m - q. So the runs are read off the tree of the text's LCP
intervals, from the bottom up: stretches that meet at a node share as many words as the node says and no more, and each
node's places are kept in lists by the word on their left, so that only places with different ones are paired. Nothing is
extended afterwards.
"""

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytable.llm.common import CRC32, SPACE, in_small_batches, or_empty, table
from daytable.llm.words import gram_hashes, word_hashes

LEAST = 12
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def suffixes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, LCP of each suffix with the one before it), by ranks of prefixes of 1, 2, 4, ... words."""
    n, width, levels = len(ids), 1, [ids]
    while True:
        rank = levels[-1]
        second = np.zeros(n, np.int64)
        second[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        again = np.empty(n, np.int64)
        again[order] = np.cumsum(np.concatenate(([0], np.diff(key[order]) != 0)))
        if again.max() == n - 1:
            break
        levels.append(again)
        width *= 2
    lcp, one, two = np.zeros(n, np.int64), order[:-1], order[1:]
    for k in range(len(levels) - 1, -1, -1):
        a, b = one + lcp[1:], two + lcp[1:]
        inside = np.maximum(a, b) < n
        same = np.zeros(n - 1, bool)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        lcp[1:] += same.astype(np.int64) << k
    return order, lcp


class Places:
    """The places of a node in ascending order, and in lists by the word on their left."""

    def __init__(self, at: int, left: int):
        self.all, self.by_left = [at], {left: [at]}


def paired(a: Places, b: Places, shared: int, least: int, found: dict) -> Places:
    """a and b as one node, after the pairs between them: places with different words on their left whose distance is `shared`
    words at most, and makes a run of `least` words or more."""
    if len(a.all) < len(b.all):
        a, b = b, a
    near = max(1, least - shared)
    for left, places in b.by_left.items():
        for i in places:
            if bisect_left(a.all, i - shared) == bisect_right(a.all, i + shared):
                continue
            for other, theirs in a.by_left.items():
                if other == left:
                    continue
                for j in theirs[bisect_left(theirs, i - shared) : bisect_right(theirs, i + shared)]:
                    period = abs(i - j)
                    if period >= near:
                        run = min(i, j), period + shared
                        found[run] = min(period, found.get(run, period))
    for left, places in b.by_left.items():
        mine = a.by_left.setdefault(left, [])
        for i in places:
            insort(mine, i)
            insort(a.all, i)
    return a


def runs_of(words: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of `least` words or more, by start and period.

    A stretch that repeats p words has its longer periods, the multiples of p, at the same place: the shortest counts."""
    n, shortest = len(words), (least + 1) // 2
    if n < least:
        return []
    grams = np.sort(gram_hashes(word_hashes(words), shortest))
    if not (grams[1:] == grams[:-1]).any():  # no stretch that long is there twice
        return []
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    order, lcp = suffixes(ids)
    left = np.concatenate(([-1], ids[:-1])).tolist()
    found: dict[tuple[int, int], int] = {}
    places, shared = order.tolist(), np.append(lcp, 0).tolist()
    open_nodes: list[tuple[int, Places]] = []
    for k, at in enumerate(places):
        here = shared[k + 1]
        if here < shortest and not open_nodes:
            continue
        node = Places(at, left[at])
        while open_nodes and open_nodes[-1][0] > here:
            depth, before = open_nodes.pop()
            node = paired(before, node, depth, least, found)
        if here < shortest:
            continue
        if open_nodes and open_nodes[-1][0] == here:
            node = paired(open_nodes.pop()[1], node, here, least, found)
        open_nodes.append((here, node))
    return sorted(((s, m, q) for (s, m), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those that a run holds after its first period, joined by one space."""
    steps = np.zeros(len(words) + 1, np.int64)
    for s, m, q in runs:
        steps[s + q] += 1
        steps[s + m] -= 1
    stay = (np.cumsum(steps)[:-1] == 0).tolist()
    return b" ".join([w for w, s in zip(words, stay, strict=True) if s])


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST, into: str = "runs") -> DataFrame:
    """docs with a struct column `into`: n_words, `runs` (start, length and period, by start and then period) and `kept`, the
    words joined by one space without those that a run holds after its first period.

    Words are [^\\x20\\x09-\\x0D]+, numbered from 0. A run is a stretch of words with smallest period q (words q apart are
    equal) and at least max(least, 2 q) words that neither neighbour continues. Null and empty texts have no words and no
    runs and keep "". Every row comes back, repeated ones too, with all columns as they were (a column itself named `into` is
    replaced); bytes that are not UTF-8 stay as they are; an empty table gives an empty table. A text is one row and so the
    work of one task, n log n for n words; nothing is shuffled.
    """

    @F.arrow_udf(f"struct<n_words:bigint,runs:{RUNS},kept:binary>")
    def of(texts: pa.Array) -> pa.Array:
        n_words, found, kept = [], [], []
        for t in texts.cast(pa.large_binary()).to_pylist():
            words = (t or b"").split()
            runs = runs_of(words, least)
            n_words.append(len(words))
            found.append([{"start": s, "length": m, "period": q} for s, m, q in runs])
            kept.append(collapsed(words, runs) if runs else b" ".join(words))
        run = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(found, pa.list_(run)), pa.array(kept, pa.binary())], ["n_words", "runs", "kept"])

    got = docs.withColumn(into, of.asNondeterministic()(F.col(text)))  # so that Spark evaluates it once, whatever reads its fields
    return got.withColumn(into, F.struct(F.col(f"{into}.n_words").alias("n_words"), F.col(f"{into}.runs").alias("runs"), F.col(f"{into}.kept").cast("string").alias("kept")))


def with_periods(text: Column, id: Column) -> Column:
    """The text of every tenth document, by the CRC of its id, with words that repeat from a place on; other texts as they are."""
    h = F.crc32(id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    trimmed = F.btrim(or_empty(text), F.lit(SPACE))
    words = F.split(trimmed, r"[\x20\x09-\x0D]+")
    n = F.size(words)
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    copies = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    return F.when((F.pmod(h, F.lit(10)) == 0) & (trimmed != ""), F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(copies, F.lit(1), n - a)), " ")).otherwise(text)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", with_periods(F.col("text"), F.col("doc_id")).alias("text"))
    runs = F.col("runs.runs")
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    found = periodic_runs(docs).select("doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("runs.kept"), 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return found.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


OP11_SQL = rf"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, {CRC32.format("doc_id::VARCHAR")} AS h FROM documents),
g AS (SELECT doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS hit, h // 10 AS g FROM t),
p AS (SELECT *, CASE WHEN hit THEN g % n END AS a, CASE WHEN hit THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM g),
d AS (SELECT doc_id, n, CASE WHEN hit THEN list_transform(range(0, n), lambda i: ws[(CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1)::INTEGER]) ELSE ws END AS ws FROM p),
u AS (SELECT doc_id, i, CASE WHEN i + 6 <= n THEN array_to_string(ws[i + 1:i + 6], ' ') END AS k, ws[i + 1] AS w FROM (SELECT *, unnest(range(0, n)) AS i FROM d)),
m AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.k = b.k AND a.i < b.i),
s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m),
x AS (SELECT doc_id, min(i) AS start, q + count(*) + 5 AS length, q FROM s GROUP BY doc_id, q, island HAVING count(*) + 5 >= q AND q + count(*) + 5 >= 12),
r AS (SELECT doc_id, start, length, min(q) AS period FROM x GROUP BY ALL),
f AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
  first({{'s': start, 'l': length, 'p': period}} ORDER BY length DESC, start, period) AS best FROM r GROUP BY doc_id),
e AS (SELECT doc_id, place, sum(step) AS step FROM (SELECT doc_id, start + period AS place, 1 AS step FROM r UNION ALL SELECT doc_id, start + length, -1 FROM r) GROUP BY ALL),
v AS (SELECT u.doc_id, u.i, w, coalesce(sum(e.step) OVER (PARTITION BY u.doc_id ORDER BY u.i), 0) = 0 AS stays FROM u LEFT JOIN e ON e.doc_id = u.doc_id AND e.place = u.i),
c AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) FILTER (stays) AS kept FROM v GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period, (1000 * best.l // best.p)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN f ON d.doc_id = f.doc_id LEFT JOIN c ON d.doc_id = c.doc_id
"""
